"""Readers and writers with explicit schemas."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EXTRACTED = "doc_id bigint, raw_text string, total_pages int"
READER_PAGES = "doc_id bigint, page_texts array<string>"
PAGE_CHARS = (
    "doc_id bigint, page_index int, view_top double, chars array<struct<c:string,u:string,x0:double,y0:double,x1:double,"
    "y1:double,ignorable:boolean,line_break_after:boolean>>"
)
RESPONSES = (
    "request_id bigint, doc_id bigint, endpoint string, model string, attempt int, json_mode boolean, status int, "
    "content_type string, body string, failure string"
)


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Parquet or JSON lines with a given schema; nothing is inferred."""
    return spark.read.schema(schema).format(fmt).load(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One whole text file per document, named ``<doc_id>.txt``; pages are separated by form feeds."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([0-9]+)\.txt$", 1)
    parts = F.split("value", "\f")
    return files.select(name.cast("long").alias("doc_id"), F.col("value").alias("raw_text"),
                        (F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)).alias("total_pages"))


def write_corpus(corpus: DataFrame, name: str, buckets: int) -> None:
    """Canonical corpus bucketed by document, so that grounding joins move the claims and not the texts."""
    corpus.write.bucketBy(buckets, "doc_id").sortBy("doc_id").mode("overwrite").saveAsTable(name)


def write_annotations(annotations: DataFrame, path: str, buckets: int = 256) -> None:
    """Append annotations, partitioned by a bucket of the document id."""
    annotations.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).write.mode("append").partitionBy(
        "doc_bucket").parquet(path)


def write_requests(requests: DataFrame, path: str) -> None:
    """Request bodies as JSON lines for a batch inference service."""
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("custom_id"), F.col("endpoint").alias("url"),
                              F.col("body")))
    requests.select(line.alias("value")).write.mode("errorifexists").text(path)


def guide_notes(guides: DataFrame, items: DataFrame) -> DataFrame:
    """Notes to store: html with the parent item, null for items that are no regular item.

    ``guides``: doc_id, html. ``items``: doc_id, parent_id, regular.
    """
    return guides.join(items, "doc_id").select(
        "doc_id", F.when(F.col("regular"), F.col("parent_id")).alias("parent_id"), "html")
