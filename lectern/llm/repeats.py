"""Removal of long byte strings that repeat anywhere, by suffix arrays of shards.

Every window of ``LENGTH`` bytes is put with all equal windows by its least gram: neighbouring windows with the same
least gram are one *stretch*, and equal windows always lie in stretches of the same gram. Stretches whose gram occurs
once are settled by a count; equal stretches are settled by their digests. The others go to shards by gram. A shard's
suffix array is induced from its sorted leftmost-smaller substrings, and permuted common prefixes say which windows
repeat. A stretch holds each window once, so a window never meets itself.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lectern.llm.common import cut_lineage, text_batches
from lectern.llm.hashing import BASES, Prefixes, sliding
from lectern.llm.suffixes import common_prefixes, suffix_array
from lectern.session import bounded_batches

LENGTH, GRAM = 400, 32
#: Bytes of a shard, and bytes of one gram's stretches from which their windows are counted by fingerprints instead.
SHARD_BYTES, HOT_BYTES = 1 << 20, 4 << 20
#: Stands between stretches; UTF-8 has no such byte.
BORDER = 0xFF

_STRETCHES = "gram bigint, digest binary, text_key string, start bigint, n bigint, twice boolean"


def _stretches(length: int, gram: int):
    width = length - gram + 1

    def found(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, start in the part, windows, least gram, gram occurs twice) of the stretches of texts in one array."""
        n = len(data)
        grams = Prefixes(data).every(gram)
        least = sliding(grams, width)
        ends = np.repeat(bounds[1:], np.diff(bounds))
        valid = np.arange(n) + length <= ends
        valid = valid[:len(least)]
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:len(least)]
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(fresh)
        if not len(starts):
            return (np.empty(0, dtype=np.int64),) * 5
        last = valid.copy()
        last[:-1] &= ~valid[1:] | fresh[1:]
        sizes = np.flatnonzero(last) - starts + 1
        value = least[starts]
        # Places of grams that are the least of a window; two of them with a stretch's value make it worth a look inside.
        reach = sliding(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
        places = np.flatnonzero(reach[:len(grams)] == grams)
        first = np.searchsorted(places, starts)
        count = np.searchsorted(places, starts + sizes - 1 + width) - first
        at = np.repeat(np.arange(len(starts)), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        equal = grams[places[inside]] == value[at]
        twice = np.bincount(at[equal], minlength=len(starts)) >= 2
        return owner[starts], starts, sizes, value, twice

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in text_batches(batches):
            if len(data) < length:
                continue
            owner, starts, sizes, value, twice = found(data, bounds)
            raw = data.tobytes()
            digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest()
                       for a, b in zip(starts.tolist(), (starts + sizes + length - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(value.view(np.int64) if len(value) else value.astype(np.int64)), pa.array(digests, pa.binary()),
                rows.column("text_key").take(pa.array(owner)),
                pa.array(starts - bounds[owner]), pa.array(sizes), pa.array(twice.astype(bool))],
                names=["gram", "digest", "text_key", "start", "n", "twice"])
    return emit


def repeated_starts(stretches: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each stretch, the offsets of its windows that some window of any of them equals."""
    border = np.array([BORDER], dtype=np.uint8)
    parts = [x for s in stretches for x in (np.frombuffer(s, dtype=np.uint8), border)]
    text = np.concatenate(parts)
    previous, shared = common_prefixes(text, suffix_array(text))
    sizes = np.array([len(s) for s in stretches])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    # A prefix may run over a border into another stretch that continues in the same way; windows end before it.
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    whole = np.arange(len(text)) + length <= (begins + sizes)[owner]
    hit = np.zeros(len(text), dtype=bool)
    both = np.flatnonzero((shared >= length) & whole)
    hit[both] = True
    hit[previous[both]] = True
    return [np.flatnonzero(hit[b:b + s]) for b, s in zip(begins.tolist(), sizes.tolist(), strict=True)]


def _runs(offsets: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Covered byte ranges of window starts in ascending order; ranges that touch are one."""
    if not len(offsets):
        return []
    gaps = np.flatnonzero(np.diff(offsets) > length)
    return list(zip(offsets[np.concatenate([[0], gaps + 1])].tolist(), (offsets[np.concatenate([gaps, [len(offsets) - 1]])] + length).tolist(), strict=True))


_SPANS = "text_key string, first bigint, last bigint"


def _shard(length: int):
    def spans(table: pa.Table) -> pa.Table:
        keys, starts, texts = (table.column(c).to_pylist() for c in ("text_key", "start", "piece"))
        out = [(key, start + a, start + b) for key, start, offsets in zip(keys, starts, repeated_starts(texts, length), strict=True)
               for a, b in _runs(offsets, length)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)]
                        if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())], names=["text_key", "first", "last"])
    return spans


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted stretches of each text."""
    for batch in batches:
        out: list[tuple] = []
        for key, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("text_key", "text", "wanted")), strict=True):
            raw = text.encode()
            out += [(key, w["gram"], w["start"], w["hot"], raw[w["start"]:w["start"] + w["size"]]) for w in wanted]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)],
            names=["text_key", "gram", "start", "hot", "piece"])


def _fingerprints(length: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, start, piece in zip(*(batch.column(c).to_pylist() for c in ("text_key", "start", "piece")), strict=True):
                data = np.frombuffer(piece, dtype=np.uint8)
                a, b = (Prefixes(data, base).every(length).view(np.int64) for base in BASES)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(a), pa.string()), pa.array(np.arange(len(a)) + start), pa.array(a), pa.array(b)],
                                                 names=["text_key", "first", "a", "b"])
    return emit


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """text_key, first, last: byte ranges of ``texts`` (text_key, text) covered by windows that occur more than once.

    Rows with the same key hold the same text; each counts as an occurrence. Ranges of one text may overlap.
    """
    found = cut_lineage(texts.select("text_key", "text").where("text is not null")
                        .mapInArrow(_stretches(length, gram), _STRETCHES))
    # Equal stretches: one row a digest, with how often it occurs and one place of it. Partial sums run before the shuffle.
    kinds = cut_lineage(found.groupBy("gram", "digest").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("text_key", "start")).alias("place"), F.max("n").alias("n"), F.max("twice").alias("twice")))
    whole = (found.join(kinds.where("times > 1").select("gram", "digest"), ["gram", "digest"], "left_semi")
             .select("text_key", F.col("start").alias("first"), (F.col("start") + F.col("n") + length - 1).alias("last")).distinct())
    size = F.col("n") + length - 1
    grams = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.max("twice").alias("twice"), F.sum(size).alias("bytes"))
    open_grams = cut_lineage(grams.where("kinds > 1 or twice").select("gram", (F.col("bytes") > HOT_BYTES).alias("hot"), "bytes"))
    wanted = (kinds.join(open_grams.select("gram", "hot"), "gram").select("place.*", "gram", "hot", size.alias("size"))
              .groupBy("text_key").agg(F.collect_list(F.struct("gram", "start", "hot", "size")).alias("wanted")))
    # At most one row for each text, and as many stretches as the text has.
    pieces = cut_lineage(texts.join(cut_lineage(wanted), "text_key").select("text_key", "text", "wanted")
                         .mapInArrow(_cut_pieces, "text_key string, gram bigint, start bigint, hot boolean, piece binary"))
    total = open_grams.where("not hot").agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    # Rows that repeat a text gave the same piece again.
    once = pieces.where("not hot").dropDuplicates(["text_key", "gram", "start"])
    sorted_out = once.withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards))).groupBy("shard").applyInArrow(_shard(length), _SPANS)
    out = whole.union(sorted_out)
    hot = pieces.where("hot").dropDuplicates(["text_key", "gram", "start"])
    if not open_grams.where("hot").isEmpty():
        # The windows of a gram that would overfill a shard are counted by 128-bit fingerprints, with partial sums.
        prints = cut_lineage(hot.mapInArrow(_fingerprints(length), "text_key string, first bigint, a bigint, b bigint"))
        again = prints.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("a", "b")
        out = out.union(prints.join(again, ["a", "b"], "left_semi").select("text_key", "first", (F.col("first") + length).alias("last")))
    return out


def _remove(keep_text: bool):
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, digests, texts = [], [], [], [], []
            for text, spans in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                raw, at, kept, count = (text or "").encode(), 0, [], 0
                for first, last in merged(spans or []):
                    kept.append(raw[at:first])
                    at, count = last, count + 1
                kept.append(raw[at:])
                rest = b"".join(kept)
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(rest))
                n_spans.append(count)
                digests.append(hashlib.sha256(rest).hexdigest())
                if keep_text:
                    texts.append(text if not count else rest.decode("utf-8", "ignore"))
            drop = [c for c in batch.schema.names if c not in ("_text", "_spans")]
            columns = [*(batch.column(c) for c in drop), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                       pa.array(digests, pa.string())]
            names = [*drop, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return removed


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal ranges of a text: ranges that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, columns: tuple[str, ...] = ("doc_id",),
                   keep_text: bool = False) -> DataFrame:
    """``columns``, n_bytes, n_removed, n_spans, kept_sha256 (and the rest as _text) for every row of ``docs``.

    A byte goes if a string of ``length`` bytes around it starts at another place too, in any row, the same one
    included. Bytes are UTF-8; matches never cross rows; everything is judged on the input. Null and empty texts have
    no bytes; texts shorter than ``length`` lose nothing; rows that repeat a text lose all of it if it is long enough;
    an empty table gives no rows; other columns are ignored. With ``keep_text`` a character that is cut through is
    dropped from the text. ``length`` must exceed ``gram``.
    """
    found = _cut_out(docs, length, gram, columns, keep_text)
    return found.select("row.*", *[c for c in found.columns if c != "row"])


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The columns of ``docs`` (text and any others), the text without its repeats; rows of which nothing is left go.

    Rows that had no text stay as they were; ``n_chars``, if there is one, follows the text. Columns may have any names.
    """
    found = _cut_out(docs, length, gram, tuple(docs.columns), True).where("n_removed = 0 or n_removed < n_bytes")
    size = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None

    def kept(name: str) -> Column:
        own = F.col("row").getField(name)
        if name == "n_chars":
            own = F.when(F.col("n_removed") > 0, F.length("_text").cast(size)).otherwise(own)
        return (F.col("_text") if name == "text" else own).alias(name)

    return found.select(*map(kept, docs.columns))


def _cut_out(docs: DataFrame, length: int, gram: int, columns: tuple[str, ...], keep_text: bool) -> DataFrame:
    """row (a struct of ``columns``, whose names thus meet no others), n_bytes, n_removed, n_spans, kept_sha256, _text."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*columns).alias("row"), F.col("text").alias("_text"), F.md5(F.coalesce("text", F.lit(""))).alias("_key"))
    long_enough = F.octet_length("text") >= length
    spans = repeated_spans(docs.select("text", F.md5(F.coalesce("text", F.lit(""))).alias("text_key")).where(long_enough), length, gram)
    per_text = cut_lineage(spans.groupBy(F.col("text_key").alias("_key")).agg(F.collect_set(F.struct("first", "last")).alias("_spans")))
    schema = T.StructType([rows.schema["row"]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    return rows.join(per_text, "_key", "left").select("row", "_text", "_spans").mapInArrow(
        _remove(keep_text), schema.add("_text", "string") if keep_text else schema)
