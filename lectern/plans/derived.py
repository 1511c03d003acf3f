"""Reading-engine inputs derived from general tables, so that every query grows with the tables it is given.

``documents`` become paged papers, quoted claims, model answers and response logs; ``events`` become result-store
entries and an inference log. Everything is row-local.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern import values as v
from lectern.functions import kernels
from lectern.functions.arrays import at, indexes, let
from lectern.functions.text import trim_ws

LINES_PER_PAGE = 5
LINES_PER_SECTION = 4
HEADINGS = ("Abstract", "1 Introduction", "2 Related Work", "3 Methods", "3.1 Details", "IV. Results",
            "Limitations:", "第六章 结论", "Acknowledgments", "References", "Appendix A")
SENTENCE = "[^.!?]+[.!?]?"
ANSWER_PIECE = 40
SPREAD = 16
CHARS_PER_LINE = 80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A file with fewer splits than cores (a small one) is spread over them; large tables are not moved."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def raw_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, text, raw_text (form feeds between pages), total_pages."""
    docs = table(spark, sf_dir, "documents")

    def pages(lines: Column) -> Column:
        count = F.ceil(F.size(lines) / LINES_PER_PAGE).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(
            F.slice(lines, i * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)), "\n"))

    paged = docs.withColumn("_pages", let(F.split("text", "\n"), pages))
    trailing = F.when(F.col("doc_id") % 3 == 0, F.lit("\f")).otherwise(F.lit(""))
    missing = F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    return paged.select(
        # a few documents are scans: form feeds and blanks alone
        "doc_id", "lang", "source", "text", F.when(F.col("doc_id") % 41 == 5, F.repeat(F.lit(" \f"), 150))
        .otherwise(F.concat(F.array_join("_pages", "\f"), trailing)).alias("raw_text"),
        (F.size("_pages") - missing).alias("total_pages"))


def sectioned_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, full_text: a heading line before every fourth line."""
    headings = F.array(*[F.lit(h) for h in HEADINGS])

    def with_headings(lines: Column) -> Column:
        return F.array_join(F.transform(lines, lambda line, i: F.when(
            i % LINES_PER_SECTION == 0,
            F.concat(at(headings, (i / LINES_PER_SECTION).cast("int") % len(HEADINGS)), F.lit("\n"), line),
        ).otherwise(line)), "\n")

    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", let(F.split("text", "\n"), with_headings).alias("full_text"))


def sentence_array(text: Column) -> Column:
    """All sentences of a text, line by line."""
    found = F.flatten(F.transform(F.split(text, "\n"), lambda line: F.regexp_extract_all(line, F.lit(SENTENCE), F.lit(0))))
    return F.filter(F.transform(found, trim_ws), lambda s: s != "")


def quote_array(text: Column, altered: str = "") -> Column:
    """array<struct<quote, location>>: sentences as a model might quote them, some with stretched spaces.

    ``altered``: ``typo`` puts one wrong character into every long sentence, ``mixed`` into some, and gives others a
    made-up ending.
    """
    def quoted(s: Column, j: Column) -> Column:
        kind = j % 4
        typo = F.concat(F.substring(s, 1, 14), F.lit("#"), F.substring(s, 16, 2_147_483_647))
        ending = F.concat(F.substring(s, F.lit(1), F.floor(F.length(s) / 2).cast("int")),
                          F.lit(" words that nobody wrote in this paper"))
        out = F
        if altered == "typo":
            out = out.when(F.length(s) >= 60, typo)
        if altered == "mixed":
            out = out.when((kind == 2) & (F.length(s) >= 60), typo).when(kind == 3, ending)
        return out.when(kind == 1, F.replace(s, F.lit(" "), F.lit("  "))).otherwise(s)

    def place(j: Column) -> Column:
        n = (j + 1).cast("string")
        return (F.when(j % 5 == 0, F.concat(F.lit("Section 2, Page "), n)).when(j % 5 == 1, F.concat(F.lit("p. "), n))
                .when(j % 5 == 2, F.concat(F.lit("第 "), n, F.lit(" 页"))).when(j % 5 == 3, F.lit("Page 99999"))
                .otherwise(F.lit("")))

    return F.transform(sentence_array(text), lambda s, j: F.struct(
        quoted(s, j).alias("quote"), place(j).alias("location")))


def claims(spark: SparkSession, sf_dir: str, altered: str = "") -> DataFrame:
    """doc_id, claim_no, quote, location: one row per quoted sentence."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(quote_array(F.col("text"), altered)).alias("claim_no", "q")).select(
        "doc_id", "claim_no", "q.quote", "q.location")


def spread_out(items: Column) -> Column:
    """All items, those that lie evenly over the whole list first."""
    step = F.greatest(F.lit(1), F.ceil(F.size(items) / SPREAD).cast("int"))
    order = F.array_sort(F.transform(items, lambda q, j: F.struct((j % step).alias("turn"), j.alias("at"), q.alias("item"))))
    return F.transform(order, lambda s: s["item"])


def answer_struct(text: Column, altered: str = "") -> Column:
    """A model's answer about a document, built from its own sentences (more evidence and highlights than are kept)."""
    def build(qs: Column) -> Column:
        def entry(q: Column, label: str) -> Column:
            return F.struct(
                F.when(q.isNotNull(), F.concat(F.lit(label + ": "), F.substring(q["quote"], 1, 30))).otherwise(
                    F.lit("")).alias("summary"),
                F.coalesce(q["location"], F.lit("")).alias("location"), F.coalesce(q["quote"], F.lit("")).alias("quote"))

        def category(c: int) -> Column:
            q = at(qs, F.lit(c))
            first = entry(q, v.CATEGORIES[c])
            more = F.array(*[entry(at(qs, F.lit(k)), f"more {i}") for i, k in enumerate((c + 4, c, c + 8, c + 12))])
            return F.struct(first["summary"].alias("summary"), first["location"].alias("location"),
                            first["quote"].alias("quote"), more.alias("evidence"))

        highlights = F.transform(qs, lambda q, j: F.struct(
            F.concat(F.lit("Point "), (j + 1).cast("string")).alias("title"),
            F.substring(q["quote"], 1, 20).alias("description"), q["location"].alias("location"),
            q["quote"].alias("quote")))
        return F.struct(*[category(i).alias(c) for i, c in enumerate(v.CATEGORIES)], highlights.alias("highlights"))

    return let(quote_array(text, altered), lambda qs: let(spread_out(qs), build))


def model_name(doc_id: Column) -> Column:
    return F.concat(F.lit("model-"), (doc_id % 4).cast("string"))


def answers(spark: SparkSession, sf_dir: str, altered: str = "") -> DataFrame:
    """doc_id, model, answer (JSON text)."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", model_name(F.col("doc_id")).alias("model"), F.to_json(answer_struct(F.col("text"), altered)).alias("answer"))


def chat_json(content: Column) -> Column:
    return F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))


def response_log(spark: SparkSession, sf_dir: str, altered: str = "") -> DataFrame:
    """request_id, doc_id, endpoint, model, attempt, json_mode, status, content_type, body, failure.

    Six answer forms: plain, fenced, inside prose, cut off, streamed, and no JSON at all.
    """
    form = F.col("doc_id") % 6
    answer = F.col("answer")
    content = (
        F.when(form == 1, F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
        .when(form == 2, F.concat(F.lit("Here it is:\n"), answer, F.lit("\nDone.")))
        .when(form == 3, F.substring(answer, F.lit(1), F.length(answer) - 2))
        .when(form == 5, F.lit("There is nothing to report.")).otherwise(answer))
    # one pass: a substring at each position would read the answer from its start again
    pieces = F.regexp_extract_all(answer, F.lit("(?s).{1,%d}" % ANSWER_PIECE), F.lit(0))
    lines = F.transform(pieces, lambda piece: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(
        piece.alias("content")).alias("delta"))).alias("choices")))))
    stream = F.concat(F.array_join(lines, "\n\n"), F.lit("\n\ndata: [DONE]\n"))
    return answers(spark, sf_dir, altered).select(
        F.col("doc_id").alias("request_id"), "doc_id",
        F.concat(F.lit("https://host-"), (F.col("doc_id") % 9).cast("string"), F.lit(".example/v1/chat/completions")).alias("endpoint"),
        "model", F.lit(1).alias("attempt"), F.lit(True).alias("json_mode"), F.lit(200).alias("status"),
        F.when(form == 4, "text/event-stream; charset=utf-8").otherwise("application/json").alias("content_type"),
        F.when(form == 4, stream).otherwise(chat_json(content)).alias("body"),
        F.lit(None).cast("string").alias("failure"))


def inference_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response log of all kinds of errors from ``events``: the event type decides what came back."""
    kind = F.col("event_type")

    def message(text: str) -> Column:
        return F.lit('{"error":{"message":"%s"}}' % text)

    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("https://host-"), (F.col("user_id") % 50).cast("string"), F.lit(".example/v1")).alias("endpoint"),
        F.lit(1).alias("attempt"), (F.col("user_id") % 2 == 0).alias("json_mode"),
        F.when(kind == "click", 400).when(kind == "signup", 401).when(kind == "error", 503).when(kind == "purchase", 400)
        .otherwise(200).alias("status"),
        F.lit("application/json").alias("content_type"),
        F.when(kind == "click", message("Unknown parameter: response_format"))
        .when(kind == "purchase", message("upstream rejected request"))
        .when(kind == "error", message("no available channel for this model"))
        .when(kind == "signup", F.lit("bad key")).when(F.col("value") < 5, F.lit('{"choices":[]}'))
        .when(F.col("value") < 10, F.lit("<html>")).when(F.col("value") < 15, F.lit('{"content":"{}"} and more')).otherwise(F.lit('{"content":"{}"}')).alias("body"),
        F.when((kind == "view") & (F.col("value") > 60), F.lit("timeout")).alias("failure"))


def store_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cache_key, title, model, created_at, result from ``events``; many entries per key."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("cache_key"), F.col("event_type").alias("title"),
        F.lit("m").alias("model"), F.col("ts").alias("created_at"), F.col("props").alias("result"))


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attachment_id, parent_id, ord, content_type, deleted, tags: three attachments per item."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        (n + 1_000_000_000).alias("attachment_id"), F.floor(n / 3).alias("parent_id"), n.alias("ord"),
        F.when(n % 4 == 0, "text/html").when(n % 4 == 1, "application/PDF").otherwise("application/pdf").alias("content_type"),
        (n % 5 == 0).alias("deleted"),
        F.when(n % 7 == 0, F.array(F.lit("lectern-export"))).otherwise(F.array().cast("array<string>")).alias("tags"))


def letters(text: Column) -> Column:
    """The characters of a page text, which are the units of its boxes."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def char_boxes(text: Column) -> Column:
    """Character boxes of a page text: rows of 80 characters, 6 x 12 each."""
    def box(c: Column, i: Column) -> Column:
        column, row = i % CHARS_PER_LINE, F.floor(i / CHARS_PER_LINE)
        x, y = (column * 6).cast("double"), (F.lit(700) - row * 12).cast("double")
        return F.struct(c.alias("c"), c.alias("u"), x.alias("x0"), y.alias("y0"), (x + 6).alias("x1"), (y + 12).alias("y1"),
                        F.lit(False).alias("ignorable"), (column == CHARS_PER_LINE - 1).alias("line_break_after"))

    return F.transform(letters(text), box)


def box_arrays(place: np.ndarray) -> kernels.Boxes:
    """The same boxes as arrays, for characters by their indexes in their page."""
    row, column = np.divmod(place, CHARS_PER_LINE)
    x, y = (column * 6).astype(float), (700 - row * 12).astype(float)
    return kernels.Boxes(x, y, x + 6, y + 12, np.zeros(len(place), bool), column == CHARS_PER_LINE - 1)


VIEW_TOP = 792.0


def page_chars(pages: DataFrame, text: str = "text") -> DataFrame:
    """View top and character boxes instead of the ``text`` column of page rows."""
    return pages.select(*[c for c in pages.columns if c != text], F.lit(VIEW_TOP).alias("view_top"), char_boxes(F.col(text)).alias("chars"))
