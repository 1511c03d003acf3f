"""One registered query for each operator, with the SQL that it is held against where SQL can express it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm import (
    factors, mixing, neighbours, ngram_join, outliers, packing, quality, repeats, resampling, suffix_tree, url_filters, warc, whitening)
from lectern.llm.common import documents, read_table, remainder, shared_folder

PAGE_RULES = (
    url_filters.Rule("allow", "org/"), url_filters.Rule("block", "example.org/es/"), url_filters.Rule("block", "example.org/en/1"),
    url_filters.Rule("allow", "com/fr/"), url_filters.Rule("block", "com/de/"))


def vocabulary_path() -> str:
    """The public byte-level vocabulary, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back."""
    return warc.page_digests(spark, read_table(spark, sf_dir, "pages"), shared_folder(spark, "warc")).drop("uri")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by source weights takes of every document."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "part")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every row whose id is divisible by 50."""
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, 5)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word sets have a similarity of 0.85."""
    return ngram_join.linked_components(documents(spark, sf_dir), 4, 85)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(documents(spark, sf_dir), vocabulary_path())


def op6_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents judged by base rules and robust distance."""
    return outliers.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored for quality."""
    return quality.classify(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the rules, with blocks spread over its aliases."""
    return url_filters.judge(read_table(spark, sf_dir, "pages"), PAGE_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 400-byte strings that repeat."""
    return repeats.remove_repeats(documents(spark, sf_dir), 400)


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a probabilistic suffix tree, next to the unigram base."""
    return suffix_tree.score_documents(documents(spark, sf_dir), remainder(F.col("doc_id"), 7) == 2)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 32 first principal components, scaled to variance one."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 13-word windows that documents with smaller ids hold."""
    return factors.remove_passages(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents drawn towards the words of the benchmark."""
    return resampling.resample(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_warc, op2_mixing, op3_neighbours, op4_ngram_join, op5_packing, op6_outliers, op7_quality, op8_url_filters,
        op9_repeats, op10_suffix_tree, op11_whitening, op12_factors, op13_resampling)}
