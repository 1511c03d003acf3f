"""Importance resampling of documents towards a target distribution of hashed n-grams.

In each batch of texts every n-gram is interned in an open-addressed NumPy table: its xxhash64 gives the slot where probing
starts, and equal hashes are trusted only after the bytes are compared. A slot stores the n-gram's bucket and its count, so
a bucket is computed once for each distinct n-gram; occurrences remember their slot and gather the bucket's gain by it.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import cut_lineage, text_batches

GRAMS, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024

#: Fixed values of xxhash64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: N-grams of this many bytes and more are hashed one by one.
_LONG = 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def xxhash64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of each stretch of ``data``; short ones in lanes of 8, 4 and 1 bytes, all at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    fours = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    h = _P5 + lengths.astype(np.uint64)
    at, left = starts.copy(), np.where(lengths < _LONG, lengths, 0)
    while (rows := np.flatnonzero(left >= 8)).size:
        h[rows] = _turned(h[rows] ^ _turned(eights[at[rows]] * _P2, 31) * _P1, 27) * _P1 + _P4
        at[rows] += 8
        left[rows] -= 8
    rows = np.flatnonzero(left >= 4)
    h[rows] = _turned(h[rows] ^ fours[at[rows]].astype(np.uint64) * _P1, 23) * _P2 + _P3
    at[rows] += 4
    left[rows] -= 4
    while (rows := np.flatnonzero(left > 0)).size:
        h[rows] = _turned(h[rows] ^ padded[at[rows]].astype(np.uint64) * _P5, 11) * _P1
        at[rows] += 1
        left[rows] -= 1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(lengths >= _LONG).tolist():
        h[k] = xxhash.xxh64_intdigest(data[starts[k]:starts[k] + lengths[k]])
    return h


def occurrences(data: np.ndarray, bounds: np.ndarray, grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, text, start, length) of every run of 1 to ``grams`` words in texts that lie one after another in ``data``.

    The buffer holds the lower-cased words with one space between, so each run is a stretch of it.
    """
    low = _LOWER[data]
    inside = _LETTER[low]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    begins = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | edge[1:-1]])) if len(data) else np.empty(0, np.int64)
    ends = np.flatnonzero(inside & np.concatenate([~inside[1:] | edge[1:-1], [True]])) + 1 if len(data) else begins
    lengths = ends - begins
    owner = np.searchsorted(bounds, begins, side="right") - 1
    stops = np.cumsum(lengths + 1) - 1
    buffer = np.full(int(stops[-1]) + 1 if len(stops) else 0, 0x20, dtype=np.uint8)
    letters = np.ones(len(buffer), dtype=bool)
    letters[stops] = False
    buffer[letters] = low[inside]
    starts, parts = stops - lengths, []
    for n in range(1, grams + 1):
        first = np.flatnonzero(owner[:len(owner) - n + 1] == owner[n - 1:])
        parts.append((owner[first], starts[first], stops[first + n - 1] - starts[first]))
    texts, starts, lengths = (np.concatenate(p) for p in zip(*parts, strict=True))
    return buffer, texts, starts, lengths


def same_bytes(data: np.ndarray, first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the stretches that begin at ``first`` and ``second`` and have ``lengths`` (none 0) are equal."""
    if not len(lengths):
        return np.empty(0, dtype=bool)
    begins = np.cumsum(lengths) - lengths
    inner = np.arange(int(lengths.sum())) - np.repeat(begins, lengths)
    equal = data[np.repeat(first, lengths) + inner] == data[np.repeat(second, lengths) + inner]
    return np.logical_and.reduceat(equal, begins)


class Interned:
    """Distinct n-grams of a batch in an open-addressed table, at most half full; ``slots`` names each occurrence's slot."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, buckets: int):
        size = 1 << max(4, (2 * len(starts)).bit_length())
        holder = np.full(size, -1, dtype=np.int64)  # the occurrence whose bytes stand for the slot
        self.slots = (hashes & np.uint64(size - 1)).astype(np.int64)
        open_ = np.arange(len(starts))
        while open_.size:
            at = self.slots[open_]
            free = holder[at] < 0
            holder[at[free]] = open_[free]
            held = holder[at]
            alike = (hashes[held] == hashes[open_]) & (lengths[held] == lengths[open_])
            rows = np.flatnonzero(alike)
            alike[rows] = same_bytes(data, starts[held[rows]], starts[open_[rows]], lengths[open_[rows]])
            open_ = open_[~alike]
            self.slots[open_] = self.slots[open_] + 1 & size - 1
        self.used = np.flatnonzero(holder >= 0)
        self.count = np.bincount(self.slots, minlength=size)
        self.bucket = np.zeros(size, dtype=np.int64)
        whole = data.tobytes()
        spans = zip(starts[holder[self.used]].tolist(), lengths[holder[self.used]].tolist(), strict=True)
        self.bucket[self.used] = [zlib.crc32(whole[a:a + n]) % buckets for a, n in spans]


def _batches(batches: Iterator[pa.RecordBatch], grams: int, buckets: int):
    for rows, data, bounds in text_batches(batches):
        buffer, texts, starts, lengths = occurrences(data, bounds, grams)
        yield rows, texts, Interned(buffer, starts, lengths, xxhash64(buffer, starts, lengths), buckets)


def _count(grams: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, dtype=np.int64)
        for _, _, table in _batches(batches, grams, buckets):
            np.add.at(totals, table.bucket[table.used], table.count[table.used])
        found = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(totals[found])], names=["bucket", "features"])
    return count


def bucket_counts(texts: DataFrame, grams: int, buckets: int) -> list[int]:
    """How many n-grams of all texts fall in each bucket: ``buckets`` numbers, the only ones that reach the driver."""
    rows = texts.select("text").mapInArrow(_count(grams, buckets), "bucket int, features bigint").groupBy("bucket").agg(F.sum("features").alias("n"))
    counts = [0] * buckets
    for r in rows.collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the logarithm by which a bucket is likelier in the target than in the source, rounded down."""
    buckets, all_source, all_target = len(source), sum(source), sum(target)
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(all_source + buckets)) / (float(s + 1) * float(all_target + buckets))))
                     for s, t in zip(source, target, strict=True)], dtype=np.int64)


def _weigh(grams: int, gain: np.ndarray):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, table in _batches(batches, grams, len(gain)):
            by_slot = gain[table.bucket]
            sums = np.concatenate([[0], np.cumsum(by_slot[table.slots[np.argsort(texts, kind="stable")]])])
            found = np.bincount(texts, minlength=rows.num_rows)
            last = np.cumsum(found)
            # Runs of n words are fewer by one with each n, down to none.
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found), pa.array(_words(found, grams)), pa.array(sums[last] - sums[last - found])],
                                             names=["doc_id", "n_features", "n_words", "weight"])
    return weigh


def _words(features: np.ndarray, grams: int) -> np.ndarray:
    """How many words give that many runs of 1 to ``grams`` words."""
    few = np.cumsum(np.arange(grams))  # runs of up to grams - 1 words
    return np.where(features <= few[-1], np.searchsorted(few, features), (features + few[-1]) // grams)


def ranked(rows: DataFrame, order: list, quota: int) -> DataFrame:
    """``rows`` (a written table) with ``rank``: the place in the total order, from 1, null beyond ``quota``.

    Rows are dealt by ranges and sorted there; only the number of rows in each range reaches the driver.
    """
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part, inner = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((r["part"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, "part bigint, before bigint")
    rank = inner + F.col("before") + 1
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= quota, rank)).drop("part", "before", "place")


def resample(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
             percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight, score, rank for each row of ``docs`` (doc_id, text), towards ``target`` (text).

    Of the documents with at least ``min_words`` words the ``percent`` of a hundred with the highest scores are drawn: the
    score is the document's weight plus Gumbel noise from a hash of ``seed`` and its id, so this draws without replacement
    in proportion to the exponential weights, and reruns agree. Ties go to the smaller id, null ids last; rows that repeat
    id and text are documents of their own with equal scores, ranked one after another. A null id has the noise of an
    empty one. A null or empty text, or one without words, has no features and weight 0. Empty tables give no rows or,
    as target, counts of 0. Other columns are ignored.

    ``buckets`` bounds what reaches the driver; texts are read twice and never shuffled.
    """
    gain = gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    weights = docs.select("doc_id", "text").mapInArrow(
        _weigh(grams, gain), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_features bigint, n_words bigint, weight bigint")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    chance = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 32))
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(chance)))
    scored = cut_lineage(weights.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()))
    eligible = F.col("n_words") >= min_words
    quota = percent * scored.where(eligible).count() // 100
    order = [F.when(eligible, 0).otherwise(1), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    return ranked(scored, order, quota).select("doc_id", "n_features", "n_words", "weight", "score", "rank")
