"""Repeated passages removed by relative Lempel-Ziv parsing.

Every window of words has a least run of ``ANCHOR`` words (by hash); neighbouring windows with the same one are a stretch, so
equal windows of different documents lie in stretches with one anchor. Equal stretches need no parse: all but those of the
least document go. The unlike stretches of an anchor form a reference block in the order of their documents: each is
factored greedily against the index of those before it, factors of a window's length and more become spans, and windows
that cross a factor's end are looked up on their own, as the greedy cut may have split them.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import cut_lineage, text_batches
from lectern.llm.hashing import MULTIPLIER, Prefixes, mixed, sliding
from lectern.plans.skew import HOT_SHARE, spread_join

WINDOW, ANCHOR = 13, 6
#: Unlike stretches that one reference block holds; those of an anchor with more are compared window by window instead.
BLOCK = 1000

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
Batches = Iterator[pa.RecordBatch]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word of texts that lie one after another in ``data``."""
    if not len(data):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    starts = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1] | edge[1:-1]]))
    stops = np.flatnonzero(solid & np.concatenate([~solid[1:] | edge[1:-1], [True]])) + 1
    return np.searchsorted(bounds, starts, side="right") - 1, Prefixes(data).of(starts, stops)


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` words in a row, by their first."""
    count = max(len(hashes) - n + 1, 0)
    total = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        factor = mixed(np.array([n * 1000 + k], dtype=np.uint64) * np.uint64(MULTIPLIER))[0] | np.uint64(1)
        total += hashes[k:k + count] * factor
    return mixed(total)


def stretches(owner: np.ndarray, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, first word, windows, anchor hash, body hash) of all stretches.

    A stretch has at most ``window - anchor + 1`` windows, so its first and last one cover all its words.
    """
    whole, runs, span = runs_of(hashes, window), runs_of(hashes, anchor), window - anchor + 1
    n = len(whole)
    if not n:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    least = sliding(runs, span)
    place = np.zeros(n, dtype=np.int64)
    for k in reversed(range(span)):  # the leftmost of equal ones is set last
        place = np.where(runs[k:k + n] == least, np.arange(k, k + n), place)
    inside = owner[:n] == owner[window - 1:]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(fresh)
    last = np.flatnonzero(inside & np.concatenate([fresh[1:] | ~inside[1:], [True]]))
    body = mixed(whole[first] * np.uint64(MULTIPLIER) + mixed(whole[last] + (last - first).astype(np.uint64)))
    return owner[first], first, last - first + 1, least[first], body


def _emit_stretches(window: int, anchor: int):
    def emit(batches: Batches) -> Batches:
        for rows, data, bounds in text_batches(batches):
            owner, hashes = word_hashes(data, bounds)
            texts, first, windows, anchors, bodies = stretches(owner, hashes, window, anchor)
            begins = np.searchsorted(owner, np.arange(rows.num_rows))
            at = pa.array(texts)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(at), rows.column("text_key").take(at), pa.array(anchors.view(np.int64)), pa.array(bodies.view(np.int64)),
                 pa.array((first - begins[texts]).astype(np.int32)), pa.array(windows.astype(np.int16))],
                names=["doc_id", "text_key", "anchor", "body", "start", "windows"])
    return emit


class ReferenceBlock:
    """An index of word sequences: a trie of all their suffixes whose first edge is a whole window."""

    def __init__(self, window: int):
        self.window, self.edges = window, {}

    def add(self, words: list[bytes]) -> None:
        for p in range(len(words) - self.window + 1):
            node = self._child((b" ".join(words[p:p + self.window]),))
            for word in words[p + self.window:]:
                node = self._child((node, word))

    def _child(self, edge: tuple) -> int:
        return self.edges.setdefault(edge, len(self.edges))

    def longest(self, words: list[bytes], p: int) -> int:
        """Words of the longest match that begins at word ``p``; 0 below a window's length."""
        node, end = self.edges.get((b" ".join(words[p:p + self.window]),)), p + self.window
        if node is None or end > len(words):
            return 0
        while end < len(words) and (node := self.edges.get((node, words[end]))) is not None:
            end += 1
        return end - p

    def factors(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(begin, end) of the words that matches cover: greedy factors, and windows across the factors' ends."""
        spans, p, last = [], 0, len(words) - self.window
        while p <= last:
            length = self.longest(words, p)
            if not length:
                p += 1
                continue
            spans.append((p, p + length))
            for q in range(p + length - self.window + 1, min(p + length - 1, last) + 1):
                if found := self.longest(words, q):
                    spans.append((q, q + found))
            p += length
        return spans


def _cut(window: int):
    """One row per stretch with its words; stretches of crowded anchors give a row for each window instead."""
    def cut(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for lo, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                words = text.encode().split()
                for w in wanted:
                    start, n = w["start"], w["windows"]
                    sides = [(k, 1) for k in range(n)] if w["crowded"] else [(0, n)]
                    for at, count in sides:
                        out.append((w["anchor"], w["body"], w["crowded"], lo, at, b" ".join(words[start + at:start + at + count + window - 1])))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.bool_(), batch.schema.field("doc_id").type, pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             names=["anchor", "body", "crowded", "lo", "at", "words"])
    return cut


def _factor(window: int):
    """Factors stretches, sorted by anchor and document, against those of the same anchor in earlier documents."""
    def factor(batches: Batches) -> Batches:
        anchor = block = lo = None
        waiting: list[list[bytes]] = []
        for batch in batches:
            out = []
            for a, body, doc, text in zip(*[batch.column(c).to_pylist() for c in ("anchor", "body", "lo", "words")], strict=True):
                if a != anchor:
                    anchor, block, lo, waiting = a, ReferenceBlock(window), doc, []
                elif doc != lo:  # what one document holds is no reference for itself
                    for words in waiting:
                        block.add(words)
                    lo, waiting = doc, []
                words = text.split(b" ")
                out += [(a, body, begin, end) for begin, end in block.factors(words)]
                waiting.append(words)
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)],
                                             names=["anchor", "body", "begin", "stop"])
    return factor


def _keep(batches: Batches) -> Batches:
    for batch in batches:
        total, removed, kept, spans = [], [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
            words = (text or "").encode().split()
            gone = np.zeros(len(words) + 2, dtype=np.int8)
            for s in found or ():
                gone[s["begin"] + 1:s["stop"] + 1] = 1
            edges = np.flatnonzero(np.diff(gone)).tolist()
            mine = list(zip(edges[::2], edges[1::2], strict=True))
            at, parts = 0, []
            for begin, stop in mine:
                parts += words[at:begin]
                at = stop
            total.append(len(words))
            removed.append(sum(b - a for a, b in mine))
            kept.append(b" ".join(parts + words[at:]).decode())
            spans.append([{"begin": a, "stop": b} for a, b in mine])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
             pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())])))],
            names=["doc_id", "n_words", "n_removed", "kept", "spans"])


def _hot(counted: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Keys of a counted table (column ``n``) with more than a thousandth of ``rows``, hence at most a thousand."""
    limit = max(rows * HOT_SHARE, 10_000)
    return counted.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("_slots"))


def remove_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept, spans for each row of ``docs`` (doc_id, text).

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id; ``kept`` are the
    others joined by one space, ``spans`` (begin, stop) the maximal runs of removed words. Windows are judged on the
    input. Words are what blanks separate; a null, empty or blank text has none, one shorter than a window loses nothing. Rows
    that repeat an id are one document: none is smaller than the other. A null id is neither smaller nor larger than
    others, so its rows lose nothing and cost others nothing. An empty table gives no rows; other columns are ignored.

    Anchors and bodies are 64-bit hashes that meet together as 128 bits; blocks compare words themselves. Texts are
    shuffled to meet the stretches that need a parse and the spans found; before that only hashes travel.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = docs.where("doc_id is not null and text is not null").mapInArrow(
        _emit_stretches(window, anchor), f"doc_id {id_type}, text_key bigint, anchor bigint, body bigint, start int, windows smallint")
    n = F.count(F.lit(1)).alias("n")
    shared = cut_lineage(found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), n).where("lo < hi").select("anchor", "n"))
    rows = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hits = cut_lineage(spread_join(found, shared.select("anchor"), ["anchor"], F.col("doc_id"), hot=_hot(shared, ["anchor"], rows)))
    first = F.min(F.struct("doc_id", "text_key", "start", "windows"))
    bodies = cut_lineage(hits.groupBy("anchor", "body").agg(first.alias("first"), F.max("doc_id").alias("hi"), n))
    kinds = bodies.groupBy("anchor").agg(F.min("first.doc_id").alias("least"), F.max("first.doc_id").alias("most"), n).where("least < most")
    kinds = cut_lineage(kinds.select("anchor", (F.col("n") > block).alias("crowded"), "n"))
    parsed = cut_lineage(spread_join(bodies.drop("n"), kinds.select("anchor", "crowded"), ["anchor"], F.col("body"), hot=_hot(kinds, ["anchor"], rows)))

    # Copies of a stretch in other documents than its least go whole.
    copied = bodies.where("first.doc_id < hi").select("anchor", "body", F.col("first.doc_id").alias("lo"), "n")
    later = spread_join(hits, copied.drop("n"), ["anchor", "body"], F.col("doc_id"), hot=_hot(copied, ["anchor", "body"], rows)).where("doc_id > lo")
    later = later.select("doc_id", "text_key", F.col("start").alias("begin"), (F.col("start") + F.col("windows") + (window - 1)).alias("stop"))

    # In its least document a stretch goes as far as stretches of smaller documents cover it.
    wanted = parsed.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")).agg(
        F.collect_list(F.struct("anchor", "body", "crowded", "first.start", "first.windows")).alias("wanted"))
    cut = cut_lineage(docs.join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text", "wanted").mapInArrow(
        _cut(window), f"anchor bigint, body bigint, crowded boolean, lo {id_type}, at int, words binary"))
    factors = cut.where("not crowded").select("anchor", "body", "lo", "words").repartition("anchor").sortWithinPartitions("anchor", "lo").mapInArrow(
        _factor(window), "anchor bigint, body bigint, begin int, stop int")
    single = cut.where("crowded").select("anchor", "body", "lo", "at", "words")
    least = cut_lineage(single.groupBy("words").agg(F.min("lo").alias("least"), F.max("lo").alias("most"), n).where("least < most").select("words", "least", "n"))
    windows = spread_join(single, least.drop("n"), ["words"], F.col("body"), hot=_hot(least, ["words"], rows)).where("lo > least")
    factors = cut_lineage(factors.union(windows.select("anchor", "body", F.col("at").alias("begin"), (F.col("at") + window).alias("stop"))))
    covered = factors.groupBy("anchor", "body").agg(F.collect_list(F.struct("begin", "stop")).alias("parts"))
    own = covered.join(parsed.select("anchor", "body", F.col("first.doc_id").alias("lo")), ["anchor", "body"])
    here = hits.join(own, ["anchor", "body"]).where("doc_id = lo").select("doc_id", "text_key", "start", F.explode("parts").alias("part"))
    here = here.select("doc_id", "text_key", (F.col("start") + F.col("part.begin")).alias("begin"), (F.col("start") + F.col("part.stop")).alias("stop"))

    spans = cut_lineage(later.union(here).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("begin", "stop")).alias("found")))
    return docs.join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "found").mapInArrow(
        _keep, f"doc_id {id_type}, n_words bigint, n_removed bigint, kept string, spans array<struct<begin:int,stop:int>>")
