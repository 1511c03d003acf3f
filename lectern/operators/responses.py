"""Reading model responses: stream assembly, plain bodies, error triage, tolerant JSON."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lectern import values as v
from lectern.functions import kernels
from lectern.functions import text as t
from lectern.functions.arrays import at, let


def _string_at(variant: Column, path: str) -> Column:
    """Text at a path; null when absent or JSON null."""
    return F.try_variant_get(variant, path, "string")


def event_piece(event: Column) -> Column:
    """Text carried by one stream event; only JSON strings count."""
    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(event, path, "variant"))

    delta, text = "$.choices[0].delta.content", "$.choices[0].text"
    has_delta = _string_at(event, delta).isNotNull()
    return (
        F.when(has_delta & (kind(delta) == "STRING"), _string_at(event, delta))
        .when(~has_delta & (kind(text) == "STRING"), _string_at(event, text))
        .otherwise(F.lit(""))
    )


def event_error(event: Column) -> Column:
    """Message of an error event, null when the event is none."""
    raw = F.try_variant_get(event, "$.error", "string")
    return F.when(raw.isNotNull() & ~raw.isin("", "false", "0"),
                  F.coalesce(F.nullif(_string_at(event, "$.error.message"), F.lit("")), F.substring(raw, 1, 200)))


def stream_answer(body: Column) -> Column:
    """struct(content, error) of an event-stream body; an error event fails the answer despite earlier content."""
    data_lines = F.filter(F.split(body, "\r?\n"), lambda line: line.startswith("data:"))
    payloads = F.filter(
        F.transform(data_lines, lambda line: t.trim_ws(F.substring(line, 6, 2_147_483_647))),
        lambda data: (data != "") & (data != "[DONE]"))
    events = F.filter(F.transform(payloads, t.strict_json), lambda e: e.isNotNull())
    return let(events, lambda es: F.struct(
        F.array_join(F.transform(es, event_piece), "").alias("content"),
        at(F.filter(F.transform(es, event_error), lambda m: m.isNotNull()), F.lit(0)).alias("error")))


def plain_answer(body: Column) -> Column:
    """struct(content, readable) of an ordinary JSON body; three places may hold the content."""
    return let(t.strict_json(body), lambda doc: F.struct(
        F.coalesce(_string_at(doc, "$.choices[0].message.content"), _string_at(doc, "$.choices[0].text"),
                   _string_at(doc, "$.content"), F.lit("")).alias("content"),
        doc.isNotNull().alias("readable")))


def error_detail(body: Column) -> Column:
    return let(t.strict_json(body), lambda doc: F.coalesce(
        F.nullif(_string_at(doc, "$.error.message"), F.lit("")), F.nullif(_string_at(doc, "$.message"), F.lit("")),
        F.substring(body, 1, v.ERROR_DETAIL_CHARS)))


def error_hint(status: Column, detail: Column) -> Column:
    return (
        F.when((status == 400) & detail.rlike(v.CONTENT_REVIEW_PATTERN), "content-review")
        .when(status == 401, "bad-key")
        .when((status == 402) | detail.rlike(v.NO_BALANCE_PATTERN), "no-balance")
        .when((status == 503) & detail.rlike(v.NO_CHANNEL_PATTERN), "model-unavailable")
        .when(status.isin(502, 504), "upstream-down")
    )


def read_answers(log: DataFrame) -> DataFrame:
    """Adds ``content, error_kind, detail, hint`` to response-log rows.

    ``log``: status, content_type, body, failure (``timeout``/``network`` when no response came, else null).
    """
    ok = F.col("status").between(200, 299)
    streamed = F.coalesce(F.col("content_type"), F.lit("")).rlike("(?i)event-stream")
    read = (
        log.withColumn("_streamed", F.when(ok & streamed, stream_answer(F.col("body"))))
        .withColumn("_plain", F.when(ok & ~streamed, plain_answer(F.col("body"))))
    )
    content = F.coalesce(F.col("_streamed.content"), F.col("_plain.content"))
    kind = (
        F.when(F.col("failure").isNotNull(), F.col("failure"))
        .when(~ok | F.col("_streamed.error").isNotNull() | ~F.col("_plain.readable"), "http")
        .when(content == "", "empty")
    )
    detail = F.when(~ok, error_detail(F.col("body"))).otherwise(F.col("_streamed.error"))
    return (
        read.withColumn("error_kind", kind)
        .withColumn("content", F.when(F.col("error_kind").isNull(), content))
        .withColumn("detail", F.when(F.col("error_kind") == "http", detail))
        .withColumn("hint", F.when((F.col("error_kind") == "http") & ~ok, error_hint(F.col("status"), F.col("detail"))))
        .drop("_streamed", "_plain")
    )


@F.pandas_udf(T.StringType())
def clean_json_udf(raw: pd.Series) -> pd.Series:
    return raw.map(kernels.clean_json, na_action="ignore")


def parse_answers(answers: DataFrame) -> DataFrame:
    """Adds ``answer_json`` (strict JSON text); answers without recoverable JSON get the error kind ``parse``."""
    parsed = answers.withColumn("answer_json", clean_json_udf(F.col("content")))
    lost = F.col("error_kind").isNull() & F.col("answer_json").isNull()
    return parsed.withColumn("error_kind", F.when(lost, "parse").otherwise(F.col("error_kind")))
