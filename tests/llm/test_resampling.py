"""Importance resampling against a plain version."""
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from helpers import documents, lower
from lectern.llm import resampling

RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, grams):
    w = RUN.findall(lower(text))
    return w, [" ".join(w[i:i + n]) for n in range(1, grams + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, grams, buckets, least, percent):
    def counts(texts):
        c = [0] * buckets
        for t in texts:
            for f in features(t, grams)[1]:
                c[zlib.crc32(f.encode()) % buckets] += 1
        return c

    s, t = counts(r[1] for r in rows), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for k, text, *_ in rows:
        w, f = features(text, grams)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[2] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize(("grams", "buckets", "percent"), [(1, 10_000, 10), (3, 64, 50), (2, 500, 100)])
def test_against_brute_force(spark, grams, buckets, percent):
    rnd = random.Random(grams)
    kinds = ["the", "THE", "Straße", "été", "x9", "中文", "a", "longer-word_here", "w" * 40, "É"] + [f"k{i}" for i in range(30)]
    rows = [(k, rnd.choice([" ", ", ", "\n"]).join(rnd.choice(kinds) for _ in range(rnd.randint(0, 45))), "s") for k in range(150)]
    rows += [(200, None, "s"), (201, "", "s"), (202, " .,;", "s"), (7, rows[7][1], "s"), (7, rows[7][1], "s"), (None, "a b " * 20, "s"), (203, "z " * 3000, "s")]
    target = [" ".join(rnd.choice(kinds[:6]) for _ in range(20)) for _ in range(5)] + [None]
    docs = documents(spark, rows, extra=True).selectExpr("*", "1 AS bucket", "2 AS features", "3 AS weight", "4 AS score", "5 AS rank", "6 AS place", "7 AS part")
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs, wanted, grams, buckets, 20, percent).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, target, grams, buckets, 20, percent)


def test_hashes_equal_the_library():
    rnd = np.random.default_rng(3)
    data = rnd.integers(0, 256, 4000).astype(np.uint8)
    starts = rnd.integers(0, 3900, 500)
    lengths = rnd.integers(1, 100, 500)
    lengths[:300] = rnd.integers(1, 32, 300)
    got = resampling.xxhash64(data, starts, lengths)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:a + n].tobytes()) for a, n in zip(starts, lengths, strict=True)]


def test_equal_hashes_of_unlike_bytes_stay_apart():
    words = [b"aa", b"bb", b"aa", b"cc", b"bb", b"ddd"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths + 1) - lengths - 1
    table = resampling.Interned(data, starts, lengths, np.full(6, 9, np.uint64), 1 << 32)
    assert len(set(table.slots.tolist())) == 4 and table.count[table.slots].tolist() == [2, 2, 2, 1, 2, 1]
    assert table.bucket[table.slots].tolist() == [zlib.crc32(w) for w in words]


def test_no_rows(spark):
    docs = documents(spark, {1: "some words", 2: None})
    target = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(docs.where("false"), target).collect() == []
    assert [r.rank for r in resampling.resample(docs, target, min_words=1, percent=100).collect()].count(1) == 1
