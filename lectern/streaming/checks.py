"""Streaming queries run to completion over the given tables (file source, all available data)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.config import JobConfig
from lectern.operators import sections
from lectern.plans import derived
from lectern.plans.skew import shared_folder
from lectern.streaming import answers, jobs


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of part files; its own file system tells which."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", place.getName()).parquet(sf_dir)


REQUESTS = "doc_id bigint, endpoint string, model string, json_mode boolean, body string"
GROUNDED = ("doc_id bigint, claim_no int, quote string, location string, verified boolean, corrected boolean, similarity double, "
            "page int")


def event_line(content: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(
        F.struct(content.alias("content")).alias("delta"))).alias("choices"))))


def answers_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one streamed answer, each turn as one delta, an hour of event time apart.

    Conversations end by a done mark, an error event, or not at all, in turn; the last kind times out once event time
    has moved on, and so do those with a done mark whose second turn got lost (every fifteenth id) or which have a turn
    each minute for longer than the overall limit (every twenty-first).
    """
    counts = derived.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    turns = table_stream(spark, sf_dir, "conversations").join(counts, "conv_id")
    kind = F.col("conv_id") % 3
    ending = F.when(kind == 0, F.lit("data: [DONE]")).when(
        kind == 1, F.lit('data: {"error":{"message":"overloaded"}}')).otherwise(F.lit(": keep-alive"))
    lines = F.array(event_line(F.col("text")), F.when(F.col("turn") == F.col("last"), ending))
    rows = turns.select("conv_id", "turn", F.posexplode(lines).alias("part", "line")).where(F.col("line").isNotNull())
    rows = rows.where(~((F.col("conv_id") % 15 == 0) & (F.col("turn") == 1) & (F.col("part") == 0)))
    pause = F.when(F.col("conv_id") % 21 == 0, 55).otherwise(1)
    stamped = rows.select(
        F.col("conv_id").alias("request_id"), (F.col("turn") + F.col("part")).cast("long").alias("seq"), "line",
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 3600 + F.col("turn") * pause).alias("ts"))
    out = shared_folder(spark, "answers")
    answers.write_answers(stamped, out, f"{out}-progress", idle_ms=60_000, overall_ms=240_000).awaitTermination()
    return spark.read.schema(answers.OUTPUT).parquet(out)


def requests_for_new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_stream(spark, sf_dir, "documents")
    items = docs.select(
        "doc_id", F.concat(F.lit("K"), "doc_id").alias("item_key"), F.lit(None).cast("string").alias("file_path"),
        F.col("n_chars").alias("file_size"), F.lit(0).alias("modified_ms"), F.lit(1).alias("item_version"),
        F.col("text").alias("full_text"), F.lit("").alias("meta_text"))
    cfg = JobConfig(max_input_chars=1500)
    held = derived.table(spark, sf_dir, "labels").select(
        F.concat(F.lit("v3:K"), "doc_id", F.lit(f":v1:{cfg.model}:{cfg.language}:p4")).alias("cache_key"))
    out = shared_folder(spark, "requests")
    query = jobs.request_new_documents(
        items, lambda: held, out, f"{out}-progress", cfg, lambda d: sections.with_condensed(d, cfg.max_input_chars))
    query.awaitTermination()
    rows = spark.read.schema(REQUESTS).parquet(out)
    return rows.select("doc_id", "model", "json_mode", F.length("body").alias("body_chars"), F.md5("body").alias("body_md5"))


def annotations_written_twice(spark: SparkSession, sf_dir: str, located: DataFrame, cfg: JobConfig) -> DataFrame:
    """Located findings arrive twice, those of a document in one file; each annotation is stored once.

    A batch takes some of the files. If a document's rows lay in several, an earlier batch could store a later finding of a place.
    """
    source, out = shared_folder(spark, "located"), shared_folder(spark, "annotations")
    for _ in range(2):
        located.repartition("doc_id").write.mode("append").parquet(source)
    stream = spark.readStream.schema(located.schema).option("maxFilesPerTrigger", 8).parquet(source)
    jobs.append_annotations(stream, out, f"{out}-progress", cfg).awaitTermination()
    return jobs.read_batches(spark, out, jobs.ANNOTATION_SCHEMA).select("doc_id", "color", "sort_index", "text", "comment")


def claims_against_corpus(spark: SparkSession, sf_dir: str, corpus: DataFrame) -> DataFrame:
    quoted = table_stream(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(derived.quote_array(F.col("text"))).alias("claim_no", "q")).select(
        "doc_id", "claim_no", "q.quote", "q.location")
    out = shared_folder(spark, "grounded")
    jobs.ground_stream(quoted, corpus, out, f"{out}-progress", "claim_no").awaitTermination()
    return spark.read.schema(GROUNDED).parquet(out).drop("batch_id")
