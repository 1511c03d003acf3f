"""Checking quotes against their source document: exact, near match, correction, page."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lectern import values as v
from lectern.functions import kernels
from lectern.functions import text as t
from lectern.plans.skew import hot_keys, spread_join

MATCH_TYPE = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("canon", T.StringType()),
    T.StructField("exact", T.BooleanType()), T.StructField("similarity", T.DoubleType()),
])


@F.pandas_udf(MATCH_TYPE)
def source_match_udf(sources: pd.Series, needles: pd.Series) -> pd.DataFrame:
    """Source wording for a canonical needle; null sources are skipped.

    Claims of one document follow each other, with null sources between, so its canonical form is made once and its text is read once for all of them.
    """
    rows = [(None, None, None, None)] * len(sources)
    asked = [(i, source, needle) for i, (source, needle) in enumerate(zip(sources, needles)) if source is not None and needle is not None]
    for source, group in groupby(asked, lambda row: row[1]):
        wanted = [(i, needle) for i, _, needle in group]
        held = kernels.Source(source, [needle for _, needle in wanted])
        for i, needle in wanted:
            if hit := held.match(needle):
                rows[i] = hit[0], kernels.canon_text(hit[0]), hit[1], hit[2]
    return pd.DataFrame(rows, columns=["text", "canon", "exact", "similarity"])


def _seed_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seed votes of every needle that its document's text does not hold; the text is read once for all of them."""
    for batch in batches:
        asked = batch.column("asked")
        firsts, ids = asked.offsets.to_pylist(), asked.values.field("id")
        rows, ranks, buckets, votes = [], [], [], []
        for k in range(len(batch)):
            hay = batch.column("hay")[k].as_py()
            needles = asked.values.field("needle").slice(firsts[k], firsts[k + 1] - firsts[k]).to_pylist()
            missed = [(i, needle) for i, needle in enumerate(needles, firsts[k]) if needle not in hay]
            places = kernels.seed_places(hay, [needle for _, needle in missed])
            for i, needle in missed:
                found = kernels.seed_votes(hay, needle, places).most_common()
                rows.extend([i] * len(found))
                ranks.extend(range(1, len(found) + 1))
                buckets.extend(b for b, _ in found)
                votes.extend(n for _, n in found)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(rows, pa.int64())), pa.array(ranks, pa.int32()), pa.array(buckets, pa.int64()), pa.array(votes, pa.int64())],
            names=["id", "rank", "bucket", "votes"])


def verify(hay: Column, needle: Column) -> Column:
    """Exact containment of canonical texts; very short needles never verify."""
    return (F.length(needle) >= v.MIN_MATCH_CHARS) & F.contains(hay, needle)


def occurrence(hay: Column, needle: Column) -> Column:
    """struct(start, repeated): 0-based first occurrence (-1 when absent) and whether another, maybe overlapping, follows."""
    first = F.call_function("locate", needle, hay)
    # whether one follows is told by bytes, which is quicker than its place
    again = F.contains(F.substring(hay, first + 1, F.lit(2_147_483_647)), needle)
    usable = F.length(needle) >= v.MIN_MATCH_CHARS
    return F.struct(F.when(usable, first - 1).otherwise(-1).alias("start"),
                    (usable & (first > 0) & again).alias("repeated"))


def canonical_corpus(docs: DataFrame) -> DataFrame:
    """Adds ``canon_pages`` and ``hay``. Compute once per document, before any join with claims.

    The canonical form works per character, so the full text's form is the concatenation of its pages' forms with the
    markers' form in between.
    """
    canon_pages = t.canon_array(F.transform("pages", lambda p: p["text"]))
    return with_hay(docs.withColumn("canon_pages", canon_pages))


def with_hay(docs: DataFrame) -> DataFrame:
    """Adds ``hay`` to rows that hold ``canon_pages`` and ``marked``: it need not be stored beside the pages it is made of."""
    marked = F.array_join(F.transform("canon_pages", lambda p, i: F.concat(
        F.lit("[pdfpage"), (i + 1).cast("string"), F.lit("]"), p)), "")
    return docs.withColumn("hay", F.when(F.col("marked"), marked).otherwise(F.array_join("canon_pages", "")))


def pages_holding(canon_pages: Column, needle: Column) -> Column:
    """1-based numbers of the pages that contain the needle."""
    return F.filter(F.transform(canon_pages, lambda p, i: F.when(F.contains(p, needle), (i + 1).cast("int"))),
                    lambda n: n.isNotNull())


def ground(claims: DataFrame, corpus: DataFrame, spread_by: Column) -> DataFrame:
    """Verify, correct and page every claim.

    ``claims``: doc_id, quote, location and any other columns. ``corpus``: output of ``canonical_corpus``. Adds
    ``verified, corrected, similarity, page`` and rewrites ``quote`` (near match -> source wording) and ``location``
    (page resolved). Exact hits never leave the JVM; only misses long enough for a near match, and hits across a page
    marker, carry the document text to the kernel.
    """
    carried = [c for c in claims.columns if c not in ("quote", "location")]
    quoted = claims.withColumn("_needle", t.canon(F.coalesce(F.col("quote"), F.lit(""))))
    dims = corpus.select("doc_id", "full_text", "hay", "canon_pages", "has_page_info")
    needle = F.col("_needle")
    exact = F.coalesce(verify(F.col("hay"), needle), F.lit(False))
    doubtful = (~exact & (F.length(needle) >= v.MIN_FUZZY_CHARS)) | (exact & needle.rlike(v.CANON_PAGE_MARKER_PATTERN))
    looked_up = spread_join(quoted, dims, ["doc_id"], spread_by, "left", hot_keys(claims, ["doc_id"], stored=True)).select(
        *carried, "quote", "location", "_needle", "has_page_info", "full_text", "canon_pages",
        exact.alias("_exact"), doubtful.alias("_doubtful"))
    joined = looked_up.select(
        *carried, "quote", "location", "_needle", "has_page_info", "_exact", "_doubtful",
        # inline is a barrier: the kernel's operator sees these columns only, not the document's texts; what it holds is
        # computed at every mention, so the search itself stands before it
        F.inline(F.array(F.struct(
            F.when(F.col("_doubtful"), F.col("full_text")).alias("_source"),
            F.when(F.col("_doubtful"), F.col("canon_pages")).alias("_pages"),
            F.when(F.col("_exact") & F.col("has_page_info"), pages_holding(F.col("canon_pages"), needle)).alias("_exact_on"),
        ))))
    match = joined.withColumn("_match", source_match_udf("_source", "_needle"))
    shown = t.display_quote(F.col("_match.text"))
    crosses = shown.rlike(v.PAGE_MARKER_PATTERN)
    verified = F.when(F.col("_doubtful"), F.coalesce(~crosses, F.lit(False))).otherwise(F.col("_exact"))
    corrected = F.col("verified") & ~F.col("_exact")
    on = F.when(F.col("corrected"), pages_holding(F.col("_pages"), F.col("_match.canon"))).otherwise(F.col("_exact_on"))
    resolves = F.col("verified") & F.coalesce(F.col("has_page_info"), F.lit(False))
    page = F.when(resolves, F.when(F.size("_on") == 1, F.element_at("_on", 1)).otherwise(0)).otherwise(
        t.location_page(F.coalesce(F.col("location"), F.lit(""))))
    prefix, suffix = v.RESOLVED_LOCATION
    return (
        match.withColumn("verified", verified).withColumn("corrected", corrected)
        .withColumn("similarity", F.when(F.col("verified"), F.coalesce(F.col("_match.similarity"), F.lit(1.0))))
        .withColumn("_on", F.when(resolves, on))
        .withColumn("page", page)
        .select(
            *carried,
            F.when(F.col("corrected"), shown).otherwise(F.col("quote")).alias("quote"),
            F.when(resolves & (F.col("page") > 0),
                   F.concat(F.lit(prefix), F.col("page").cast("string"), F.lit(suffix)))
            .otherwise(F.col("location")).alias("location"),
            "verified", "corrected", "similarity", "page")
    )


def seed_votes(claims: DataFrame, corpus: DataFrame, spread_by: Column) -> DataFrame:
    """Seed votes per diagonal for claims that miss exactly: claim columns, rank, bucket, votes (best first)."""
    carried = [c for c in claims.columns if c != "quote"]
    quoted = claims.withColumn("_needle", t.canon(F.col("quote"))).where(F.length("_needle") >= v.MIN_FUZZY_CHARS)
    hot = F.broadcast(hot_keys(claims, ["doc_id"], stored=True))
    slot = F.pmod(F.xxhash64(spread_by), F.coalesce("_slots", F.lit(1)).cast("long"))
    one = F.struct(F.struct(*carried).alias("id"), F.col("_needle").alias("needle"))
    # a document's needles travel to its text together, those of one with very many to several copies of it
    asked = quoted.join(hot, "doc_id", "left").withColumn("_slot", slot).groupBy("doc_id", "_slot").agg(F.collect_list(one).alias("asked"))
    schema = T.StructType([T.StructField("id", T.StructType([quoted.schema[c] for c in carried])), T.StructField("rank", T.IntegerType()),
                           T.StructField("bucket", T.LongType()), T.StructField("votes", T.LongType())])
    texts = corpus.select("doc_id", "hay").where(F.col("hay").isNotNull())
    voted = asked.join(texts, "doc_id").select("hay", "asked").mapInArrow(_seed_votes, schema)
    return voted.select("id.*", "rank", "bucket", "votes")
