"""Looking one quote up in every document: exact passages and near passages.

No document is compared with every quote. Documents and quotes meet on text fingerprints (exact search) or seed grams
(near search); only pairs that share one are checked on the text.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lectern import values as v
from lectern.functions import kernels
from lectern.functions import text as t
from lectern.operators.grounding import source_match_udf
from lectern.plans.skew import cut_lineage, spread_join

# Quotes of at most this many canonical characters in total may be broadcast: their anchors then carry at most this
# much text, their seeds at most a quarter as many rows. Larger quote sets are shuffled.
BROADCAST_CHARS = 16_000_000

MARK_TYPE = T.StructType([
    T.StructField("hash", T.ArrayType(T.LongType())), T.StructField("pos", T.ArrayType(T.LongType()))])


def fingerprint_udf(window: int, first_only: bool = False, wanted: list[int] | None = None):
    """Winnowing fingerprints of canonical texts as two parallel arrays; ``first_only`` keeps the first window's.

    ``wanted``: the only hashes that are asked for, a set of bounded size; others are left out at once.
    """
    asked = None if wanted is None else np.array(sorted(wanted), dtype=np.int64)
    seed = min(v.SEED_CHARS, window)

    @F.pandas_udf(MARK_TYPE)
    def marks(texts: pd.Series) -> pd.DataFrame:
        found = [kernels.fingerprints(s[:window] if first_only else s, window, seed) for s in texts.fillna("")]
        if asked is not None:
            found = [(p[keep], h[keep]) for p, h in found for keep in [np.isin(h, asked)]]
        return pd.DataFrame({"hash": [h for _, h in found], "pos": [p for p, _ in found]})

    return marks


def exploded_marks(marks: Column) -> Column:
    """One struct(hash, pos) per fingerprint."""
    return F.explode(F.arrays_zip(marks["hash"].alias("hash"), marks["pos"].alias("pos")))


def corpus_hay(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", t.canon(F.col(text)).alias("hay"))


def distinct_needles(quotes: DataFrame, min_chars: int) -> DataFrame:
    """Each canonical quote once, with a 64-bit id; quotes below ``min_chars`` are outside the search."""
    needles = quotes.select(t.canon(F.col("quote")).alias("needle")).where(F.length("needle") >= min_chars)
    return needles.distinct().withColumn("needle_id", F.xxhash64("needle"))


def fits_broadcast(needles: DataFrame, limit: int) -> bool:
    size = needles.agg(F.coalesce(F.sum(F.length("needle")), F.lit(0)).alias("chars")).first()
    return size.chars <= limit


def find_passages(quotes: DataFrame, corpus: DataFrame, min_chars: int = v.MIN_MATCH_CHARS,
                  broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Exact occurrences of quotes anywhere in the corpus: needle, doc_id, start (first, 0-based), occurrences.

    ``quotes``: quote; those of at least ``min_chars`` canonical characters are looked for. ``corpus``: doc_id, hay;
    store it, it is read several times. Long quotes meet the corpus by sparse fingerprints, short ones by those of a
    narrower window.
    """
    needles = cut_lineage(distinct_needles(quotes, min_chars))
    size, found = F.length("needle"), None
    for window, upto in ((v.MIN_FUZZY_CHARS, None), (min_chars, v.MIN_FUZZY_CHARS)):
        part = needles.where(size >= window) if upto is None else needles.where(size < upto)
        if window < (upto or window + 1) and not part.isEmpty():
            hits = _find_by_window(part, corpus, window, broadcast_chars)
            found = hits if found is None else found.unionByName(hits)
    return _find_by_window(needles, corpus, v.MIN_FUZZY_CHARS, broadcast_chars) if found is None else found


def _find_by_window(needles: DataFrame, corpus: DataFrame, min_chars: int, broadcast_chars: int) -> DataFrame:
    """Occurrences of needles of at least ``min_chars`` characters.

    The fingerprint of a needle's first ``min_chars`` characters is also kept by every document that contains it, so
    one equi join of fingerprints finds all pairs; these few numbers are stored and go back to their documents for the
    check. Both joins broadcast the small side when its measured size allows and spread hot keys otherwise.
    """
    anchors = needles.select("needle_id", fingerprint_udf(min_chars, first_only=True)("needle").alias("f")).select(
        "needle_id", exploded_marks(F.col("f")).alias("a")).select(
        "needle_id", F.col("a.hash").alias("hash"), F.col("a.pos").alias("offset"))
    small = fits_broadcast(needles, broadcast_chars)
    wanted = [r.hash for r in anchors.select("hash").distinct().collect()] if small else None
    marks = corpus.select("doc_id", fingerprint_udf(min_chars, wanted=wanted)("hay").alias("f")).select(
        "doc_id", exploded_marks(F.col("f")).alias("m")).select("doc_id", "m.hash", "m.pos")
    met = marks.join(F.broadcast(anchors), "hash") if small else spread_join(
        marks, anchors, ["hash"], F.xxhash64("doc_id", "pos"))
    pairs = cut_lineage(met.select("doc_id", "needle_id", (F.col("pos") - F.col("offset")).cast("int").alias("start"))
                        .where("start >= 0"))
    wanted = (pairs.join(F.broadcast(needles), "needle_id") if small
              else spread_join(pairs, needles, ["needle_id"], F.col("doc_id")))
    texts = corpus.select("doc_id", "hay")
    chars = wanted.agg(F.coalesce(F.sum(F.length("needle")), F.lit(0)).alias("n")).first().n
    checked = (texts.join(F.broadcast(wanted), "doc_id") if chars <= broadcast_chars
               else spread_join(wanted, texts, ["doc_id"], F.xxhash64("needle_id", "start")))
    found = checked.where(F.substring("hay", F.col("start") + 1, F.length("needle")) == F.col("needle"))
    return found.groupBy("needle", "doc_id").agg(
        F.min("start").alias("start"), F.count_distinct("start").alias("occurrences"))


# --- near passages -------------------------------------------------------------------------------------------

GRAM_TYPE = T.ArrayType(T.LongType())


@F.pandas_udf(GRAM_TYPE)
def gram_hashes_udf(texts: pd.Series) -> pd.Series:
    """Distinct seed-gram hashes of a canonical text."""
    return texts.map(lambda s: kernels.gram_hashes(s, 1), na_action="ignore")


@F.pandas_udf(GRAM_TYPE)
def seed_hashes_udf(texts: pd.Series) -> pd.Series:
    """Distinct hashes of the grams that seed a needle, one every ``SEED_STRIDE`` characters."""
    return texts.map(lambda s: kernels.gram_hashes(s, v.SEED_STRIDE), na_action="ignore")


def find_near_passages(quotes: DataFrame, docs: DataFrame, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Near and exact matches of quotes in all documents: needle, doc_id, matched, exact, similarity.

    ``docs``: doc_id, text (whole source text). A match within the similarity floor has at most 10 % edits and one edit
    spoils at most two seed grams of different hash, so a pair must share at least ``seeds - 2 * edits`` of them (and
    one): an exact filter that loses no match. What passes is checked by the same kernel as in-document grounding.
    """
    needles = distinct_needles(quotes, v.MIN_FUZZY_CHARS)
    seeded = needles.withColumn("seeds", seed_hashes_udf("needle"))
    edits = F.floor(F.length("needle") * F.lit(1 - v.MIN_SIMILARITY) + 1e-6)
    need = F.greatest(F.lit(1), F.size("seeds") - 2 * edits)
    seeds = seeded.select("needle_id", need.alias("need"), F.explode("seeds").alias("hash"))
    hay = docs.select("doc_id", t.canon(F.col("text")).alias("hay"))
    grams = hay.select("doc_id", F.explode(gram_hashes_udf("hay")).alias("hash"))
    if fits_broadcast(needles, broadcast_chars):
        met = grams.join(F.broadcast(seeds), "hash")
    else:
        met = spread_join(grams, seeds, ["hash"], F.col("doc_id"))
    pairs = (
        met.groupBy("needle_id", "doc_id", "need")
        .agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= F.col("need")).select("needle_id", "doc_id")
    )
    pairs = cut_lineage(pairs)
    with_needle = spread_join(pairs, needles, ["needle_id"], F.col("doc_id"))
    with_text = spread_join(with_needle, docs.select("doc_id", "text"), ["doc_id"], F.col("needle_id"))
    # explode keeps the filter below from running the kernel a second time
    checked = with_text.select("needle", "doc_id", source_match_udf("text", "needle").alias("found")).select(
        "needle", "doc_id", F.explode(F.array("found")).alias("m"))
    return checked.where(F.col("m.text").isNotNull()).select(
        "needle", "doc_id", t.display_quote(F.col("m.text")).alias("matched"), F.col("m.exact").alias("exact"),
        F.col("m.similarity").alias("similarity"))
