"""Continuous jobs: each micro-batch runs the batch operators and writes idempotently.

A micro-batch may be replayed after a failure. Output folders carry the batch id and are overwritten, so a replay
writes the same rows again instead of more rows.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.config import JobConfig
from lectern.operators.annotations import new_annotations
from lectern.operators.grounding import ground
from lectern.operators.requests import request_rows
from lectern.operators.selection import cache_key, pending


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def each_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None],
               available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def request_new_documents(stream: DataFrame, read_store: Callable[[], DataFrame], out: str, checkpoint: str,
                          cfg: JobConfig, prepare: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """New documents without a stored result become request rows. ``prepare`` adds meta_text and condensed."""
    def work(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("cache_key", cache_key(cfg))
        rows = request_rows(prepare(pending(keyed, read_store())), cfg)
        rows.write.mode("overwrite").parquet(batch_folder(out, batch_id))

    return each_batch(stream, checkpoint, work)


def read_batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows written by earlier micro-batches; ``before`` hides a batch's own earlier attempt."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch_id bigint").parquet(path)
    return (rows if before is None else rows.where(F.col("batch_id") < before)).drop("batch_id")


ANNOTATION_SCHEMA = (
    "doc_id bigint, type string, color string, sort_index string, page_index int, "
    "rects array<struct<x0:double,y0:double,x1:double,y1:double>>, text string, comment string, page_label string, "
    "tags array<string>"
)


def append_annotations(located: DataFrame, out: str, checkpoint: str, cfg: JobConfig) -> StreamingQuery:
    """Stream of located findings -> stored annotations without duplicates, whatever arrives twice."""
    def work(batch: DataFrame, batch_id: int) -> None:
        stored = read_batches(batch.sparkSession, out, ANNOTATION_SCHEMA, before=batch_id)
        new_annotations(batch, stored, cfg).write.mode("overwrite").parquet(batch_folder(out, batch_id))

    return each_batch(located, checkpoint, work)


def ground_stream(claims: DataFrame, corpus: DataFrame, out: str, checkpoint: str, spread_by: str) -> StreamingQuery:
    """Stream of claims against a static canonical corpus."""
    def work(batch: DataFrame, batch_id: int) -> None:
        ground(batch, corpus, F.col(spread_by)).write.mode("overwrite").parquet(batch_folder(out, batch_id))

    return each_batch(claims, checkpoint, work)
