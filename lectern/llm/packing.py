"""Packing documents into token sequences by order-preserving dynamic programming.

The tokens of a partition's documents, in order, are one stream. Windows of at most ``LENGTH`` tokens are cut from it
so that padding and truncation penalties are least in total: a cut costs nothing after a document, little after a
sentence and more elsewhere. A window is padded to ``LENGTH`` unless its length is a power of two. The best window that
ends at a place is found by a monotone queue over the places before it.
"""
from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LENGTH = 1024
SEPARATOR = 0
#: What a cut costs, in padding tokens, after a sentence and inside one.
SENTENCE_CUT, INNER_CUT = 1.0, 4.0
#: Inside sentences, cuts are looked for at multiples of this.
GRID = 64
#: Tokens that are cut in one go; the windows of one go are settled before the next begins.
HORIZON = 1 << 20
#: Words whose ids a task remembers.
REMEMBERED = 300_000
#: Fixed value: how the public byte-level vocabulary splits text before merging.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Words(dict):
    """Ids (little-endian uint32 bytes) of a word with a blank before it."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(" " + word)
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids


class Encoder:
    """Ids of a byte-level vocabulary file (JSON of the ``tokenizers`` library); special tokens' strings are plain text.

    A single blank between two other characters always begins a new piece of the vocabulary's split, so texts are
    encoded word by word and words are remembered; texts with other white space beside a blank are encoded whole.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        to_byte = {c: b for b, c in _byte_letters().items()}
        special = {t["content"] for t in model.get("added_tokens", [])}
        vocabulary = {k: i for k, i in model["model"]["vocab"].items() if k not in special}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in vocabulary.items()}
        self.encoding = tiktoken.Encoding("packing", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self.ends = np.zeros(max(size, 1), dtype=bool)  # ids after which a sentence may end
        for token, i in ranks.items():
            self.ends[i] = token.rstrip(b" ").endswith((b".", b"!", b"?")) or b"\n" in token
        self.words = _Words(self._whole)

    def _whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def __call__(self, text: str) -> np.ndarray:
        if _odd(text):
            return np.frombuffer(self._whole(text), dtype="<u4")
        first, *rest = text.split(" ")
        head = self._whole(first) if first else b""
        return np.frombuffer(head + b"".join(map(self.words.__getitem__, rest)), dtype="<u4")


def _odd(text: str) -> bool:
    """Whether white space may stand beside a blank. Other white space than blanks and line breaks isn't printable."""
    return ("  " in text or " \n" in text or "\n " in text or text.endswith(" ")
            or not text.replace("\n", "").isprintable())


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in such files: printable ones stand for themselves, the others follow."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(places: np.ndarray, penalties: np.ndarray, length: int = LENGTH) -> list[int]:
    """The best cut places of a stream: ``places`` ascend from 0 to its end, a gap is at most ``length``.

    cost(j) = penalty(j) + min over i in [j - length, j) of cost(i) + padding(j - i), where padding is length - (j - i)
    but 0 for a power of two. ``cost(i) + i`` in a monotone queue gives the first kind. The second kind is looked up
    one power at a time, and only within the last ``length``: elsewhere full windows have no padding either.
    """
    at, costs = places.tolist(), penalties.tolist()
    where = {0: 0}
    best, back = [0.0] * len(at), [0] * len(at)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (cost + place, index), ascending in both
    tail = at[-1] - length
    powers = [1 << k for k in range(length.bit_length()) if 1 << k <= length]
    for n in range(1, len(at)):
        j = at[n]
        while at[queue[0][1]] < j - length:
            queue.popleft()
        value, source = queue[0]
        value += length - j
        for p in powers if j > tail else ():
            i = where.get(j - p)
            if i is not None and best[i] < value:
                value, source = best[i], i
        value += costs[n]
        best[n], back[n] = value, source
        where[j] = n
        key = value + j
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, n))
    out, n = [], len(at) - 1
    while n:
        out.append(at[n])
        n = back[n]
    return out[::-1]


def _places(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, with penalties; so many near its end that the rest can be powers of two."""
    size = len(ids)
    known = ids < len(ends)
    sentence = np.flatnonzero(known & ends[np.where(known, ids, 0)]) + 1
    tail = np.arange(max(0, size - length), size + 1)
    places = np.unique(np.concatenate([[0], sentence, doc_ends, np.arange(0, size, min(GRID, length)), tail]))
    penalties = np.full(len(places), INNER_CUT)
    penalties[np.searchsorted(places, sentence)] = SENTENCE_CUT
    penalties[np.searchsorted(places, doc_ends)] = 0.0
    return places, penalties


_DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
_NAMES = [part.split()[0] for part in _DDL.split(", ")]


def _packer(path: str, length: int, with_ids: bool, horizon: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        sequence = 0
        held: list[tuple] = []      # (partition, doc_id, start of the part, tokens of the document, ids)
        tokens = 0

        def settle() -> pa.RecordBatch:
            nonlocal sequence, held, tokens
            sizes = np.array([len(h[4]) for h in held])
            ends = np.cumsum(sizes)
            stream = np.concatenate([h[4] for h in held])
            whole = np.array([h[2] + len(h[4]) == h[3] for h in held])
            bounds = cuts(*_places(stream, ends[whole], encode.ends, length), length)
            windows = np.array([0, *bounds])
            rows: list[tuple] = []
            edges = np.unique(np.concatenate([windows, [0], ends]))
            owner = np.searchsorted(ends, edges[:-1], side="right")
            window = np.searchsorted(windows, edges[:-1], side="right") - 1
            firsts = ends - sizes
            for a, b, k, w in zip(edges[:-1].tolist(), edges[1:].tolist(), owner.tolist(), window.tolist(), strict=True):
                partition, doc, start, total, _ = held[k]
                piece = stream[a:b].tobytes()
                row = (doc, start + a - int(firsts[k]), b - a, zlib.crc32(piece), total, (partition << 33) + sequence + w, a - int(windows[w]))
                rows.append((*row, stream[a:b]) if with_ids else row)
            sequence += len(bounds)
            held, tokens = [], 0
            columns = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:7]]
            if with_ids:
                columns.append(pa.array([r[7] for r in rows], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(columns, names=_NAMES + ["ids"] * with_ids)

        for batch in batches:
            for partition, doc, text in zip(*(batch.column(c).to_pylist() for c in ("partition", "doc_id", "text")), strict=True):
                ids = np.append(encode(text or ""), np.uint32(SEPARATOR))
                at = 0
                while at < len(ids):
                    part = ids[at:at + horizon - tokens]
                    held.append((partition, doc, at, len(ids), part))
                    at, tokens = at + len(part), tokens + len(part)
                    if tokens >= horizon:
                        yield settle()
        if held:
            yield settle()
    return pack


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, with_ids: bool = False, horizon: int = HORIZON) -> DataFrame:
    """The pieces of all ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Documents keep the order of their partition; nothing is shuffled, and a partition's unfinished windows are not
    carried into another's. A null text is empty: its one piece is the separator. Very long texts run through as many
    windows and horizons as they need, so a task holds ``horizon`` tokens and one text. Repeated rows and a null doc_id
    are packed as they are; no rows give no pieces; other columns are ignored. ``vocabulary`` is the path of the
    vocabulary file, which every executor has; ``length`` is a power of two, as the end of a stream is cut into such.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = docs.select(F.spark_partition_id().cast("long").alias("partition"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_packer(vocabulary, length, with_ids, horizon), _DDL + (", ids array<long>" if with_ids else ""))
