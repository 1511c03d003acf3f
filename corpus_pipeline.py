"""A training corpus from ``documents``: filtered, de-duplicated, mixed and packed in five stages."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lectern.llm import mixing, ngram_join, packing, quality, queries, repeats
from lectern.llm.common import cut_lineage, documents, read_table


#: Repeated strings of this many bytes go: passages of 50 words have 280 and more, and texts share shorter ones by chance.
PASSAGE_BYTES = 200


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule classifier doesn't reject. Rows that repeat an id stand or fall together."""
    judged = quality.classify(docs, read_table(spark, sf_dir, "labels"))
    rejected = cut_lineage(judged.groupBy("doc_id").agg(F.max("predicted").alias("good")).where("good = 0").select("doc_id"))
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents whose 5-word sets have a similarity of 0.8: that with the least id.

    Of rows that repeat its id the longest is kept; rows without an id are kept.
    """
    found = ngram_join.linked_components(docs, 5, 80)
    gone = cut_lineage(found.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = cut_lineage(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    if repeated.isEmpty():
        return kept.select(docs.columns)
    row = F.col("row")
    others = [row.getField(c).asc_nulls_last() for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy(row.getField("doc_id")).orderBy(F.desc(F.length(row.getField("text"))), row.getField("text").asc_nulls_last(), *others)
    several = kept.join(repeated, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row")).withColumn("rank", F.row_number().over(first))
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).union(several.where("rank = 1").select("row.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of ``PASSAGE_BYTES``-byte strings that occur more than once; those with nothing left go."""
    return repeats.without_repeats(docs, PASSAGE_BYTES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix by source weights takes it."""
    return mixing.repeat_rows(docs, mixing.mix(docs, cut_last=False))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, queries.vocabulary_path())


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing to target weights", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each on what the one before has written."""
    rows = documents(spark, sf_dir)
    for _, stage in STAGES:
        rows = cut_lineage(stage(spark, rows, sf_dir))
    return rows


#: SQL cannot express the classifier, the rounding and the tokens; tests/llm holds each stage against brute force.
ORACLE_SQL = None
