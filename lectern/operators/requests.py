"""Model requests: prompt text, request bodies and the choice of what to send again."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern import values as v
from lectern.config import JobConfig
from lectern.operators.sections import highlight_range

_FINDING = '{"summary": "", "location": "", "quote": "", "evidence": [{"summary": "", "location": "", "quote": ""}]}'
ANSWER_SHAPE = "{%s, \"highlights\": [{\"title\": \"\", \"description\": \"\", \"location\": \"\", \"quote\": \"\"}]}" % (
    ", ".join(f'"{c}": {_FINDING}' for c in v.CATEGORIES)
)
STRICTER = "\nYour previous answer could not be read as JSON. Answer with the JSON object alone."


def instructions(language: str, chars: Column, count: int = 0) -> Column:
    """Task text; the number of highlights follows the length sent unless ``count`` fixes it."""
    span = highlight_range(chars, count)
    wording = "Simplified Chinese" if language == "zh" else "English"
    wanted = F.concat_ws("-", F.array_distinct(F.array(span["low"].cast("string"), span["high"].cast("string"))))
    opening = (
        "Read the paper below and report what it says as one JSON object.\n"
        f"Write in {wording}. Use only the text given; do not add outside knowledge.\n"
        "Give every entry a location (section and page) and a quote of one or two whole sentences copied character "
        f"by character from the text. Lines such as {v.PAGE_MARKER_PREFIX}3] mark pages, are not part of the paper, "
        "and no quote may run across one.\n"
        f"When the paper does not cover an entry, its summary is \"{v.MISSING_SUMMARY}\" with empty location and quote.\n"
        f"Each of the four categories may carry up to {v.MAX_EVIDENCE} further pieces of evidence with other quotes.\n"
        "Number of highlights (passages worth reading closely): "
    )
    return F.concat(F.lit(opening), wanted, F.lit(f".\nAnswer with JSON only, in this shape:\n{ANSWER_SHAPE}"))


def prompt(task: Column, meta: Column, body: Column) -> Column:
    return F.concat(task, F.lit("\n\nPaper metadata:\n"), F.coalesce(meta, F.lit("")), F.lit("\n\nPaper text:\n"), body,
                    F.lit("\n\n---\nEnd of the text. Answer now with the JSON object only; copy quotes exactly."))


def request_body(model: str, message: Column, json_mode: Column) -> Column:
    """Chat request as JSON text; the response format is left out where JSON mode is off."""
    turn = F.struct(F.lit("user").alias("role"), message.alias("content"))
    fmt = F.when(json_mode, F.struct(F.lit("json_object").alias("type")))
    return F.to_json(F.struct(
        F.lit(model).alias("model"), F.array(turn).alias("messages"), F.lit(0.2).alias("temperature"),
        F.lit(True).alias("stream"), fmt.alias("response_format")))


def request_rows(docs: DataFrame, cfg: JobConfig, no_json_mode: DataFrame | None = None) -> DataFrame:
    """One request per document: doc_id, endpoint, model, attempt, json_mode, body.

    ``docs``: doc_id, meta_text, condensed. ``no_json_mode``: endpoints known to refuse JSON mode, one row each.
    """
    rows = docs.withColumn("endpoint", F.lit(cfg.endpoint)).withColumn("json_mode", F.lit(True))
    if no_json_mode is not None:
        known = no_json_mode.select("endpoint", F.lit(True).alias("_refuses"))
        rows = rows.join(known, "endpoint", "left").withColumn("json_mode", F.col("_refuses").isNull())
    text = F.col("condensed.text")
    message = prompt(instructions(cfg.language, F.length(text), cfg.highlight_count), F.col("meta_text"), text)
    return rows.select(
        "doc_id", "endpoint", F.lit(cfg.model).alias("model"), F.lit(1).alias("attempt"), "json_mode",
        request_body(cfg.model, message, F.col("json_mode")).alias("body"))


def refuses_json_mode(status: Column, body: Column) -> Column:
    """A 400/422 whose text points at an unsupported parameter."""
    return status.isin(400, 422) & body.rlike(v.RETRY_PARAMETER_PATTERN)


def retry_plan(log: DataFrame) -> DataFrame:
    """What to send next: request_id, endpoint, reason, attempt, json_mode, stricter.

    ``log``: request_id, endpoint, attempt, json_mode, status, body, error_kind; any number of attempts per request.
    Only a request's last attempt is looked at, so what was resent already is not sent again. A refusal of JSON mode is
    resent without it, with the text it had; a first unreadable answer is resent once with the stricter text. Unrelated
    errors are never resent.
    """
    last = log.groupBy("request_id").agg(
        F.max(F.struct("attempt", "endpoint", "json_mode", "status", "body", "error_kind")).alias("last"),
        F.count_if(F.col("error_kind") == "parse").alias("unread")).select("request_id", "last.*", "unread")
    refused = F.col("json_mode") & refuses_json_mode(F.col("status"), F.col("body"))
    unreadable = (F.col("error_kind") == "parse") & (F.col("unread") == 1)
    reason = F.when(refused, "json-mode").when(unreadable, "unreadable")
    return last.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(
        "request_id", "endpoint", "reason", (F.col("attempt") + 1).alias("attempt"),
        (F.col("json_mode") & (F.col("reason") != "json-mode")).alias("json_mode"), (F.col("unread") > 0).alias("stricter"))


def retry_requests(plan: DataFrame, docs: DataFrame, cfg: JobConfig) -> DataFrame:
    """The requests of a plan: request_id, endpoint, model, attempt, json_mode, body.

    ``plan``: output of ``retry_plan``. ``docs``: request_id, meta_text, condensed.
    """
    text = F.col("condensed.text")
    task = instructions(cfg.language, F.length(text), cfg.highlight_count)
    message = F.concat(prompt(task, F.col("meta_text"), text), F.when(F.col("stricter"), STRICTER).otherwise(""))
    return plan.join(docs.select("request_id", "meta_text", "condensed"), "request_id").select(
        "request_id", "endpoint", F.lit(cfg.model).alias("model"), "attempt", "json_mode",
        request_body(cfg.model, message, F.col("json_mode")).alias("body"))


def endpoints_without_json_mode(log: DataFrame) -> DataFrame:
    """Endpoints that refused JSON mode and sent content for the same request without it, readable or not."""
    refused = log.where(F.col("json_mode") & refuses_json_mode(F.col("status"), F.col("body")))
    kind = F.coalesce(F.col("error_kind"), F.lit(""))
    answered = log.where(~F.col("json_mode") & kind.isin("", "parse")).select("request_id")
    return refused.join(answered, "request_id", "left_semi").select("endpoint").distinct()
