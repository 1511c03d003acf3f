import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import documents
from lectern.llm import hashing, repeats, suffixes


def brute(texts, length):
    raw = {k: (t or "").encode() for k, t in texts.items()}
    count = Counter(r[i:i + length] for r in raw.values() for i in range(len(r) - length + 1))
    out = {}
    for k, r in raw.items():
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        rest = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out[k] = (len(r), sum(gone), sum(1 for i in range(len(r)) if gone[i] and (not i or not gone[i - 1])), hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4 << 20, 500])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_BYTES", hot)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 4000)
    rnd = random.Random(3)
    kinds = ["".join(rnd.choices("abcdefgh", k=rnd.randint(1, 7))) for _ in range(30)]
    passage = " ".join(rnd.choices(kinds, k=30))
    texts = {}
    for k in range(120):
        t = " ".join(rnd.choices(kinds, k=rnd.randint(0, 60)))
        t = t[:40] + passage + t[40:] if k % 3 == 0 else t
        t = t + "ab" * rnd.randint(0, 60) if k % 7 == 0 else t
        texts[k] = "é" * rnd.randint(0, 90) + t if k % 11 == 0 else t
    texts |= {200: None, 201: "", 202: texts[3], 203: "x" * 700, 204: "y" * 59, 205: "y" * 61}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(documents(spark, texts, extra=True), 60, 8).collect()}
    assert got == brute(texts, 60)


def test_repeated_rows_and_no_rows(spark):
    rows = [(1, "q" + "w" * 3 + "r" * 100, "s"), (1, "q" + "w" * 3 + "r" * 100, "s"), (None, "z" * 20, "s")]
    got = sorted((r.n_bytes, r.n_removed) for r in repeats.remove_repeats(documents(spark, rows), 60, 8).collect())
    assert got == [(20, 0), (104, 104), (104, 104)]
    assert repeats.remove_repeats(documents(spark, rows).where("false"), 60, 8).collect() == []


def test_suffix_arrays_and_prefixes():
    for trial in range(400):
        r = random.Random(trial)
        n, k = r.randint(1, 80), r.choice([1, 2, 3, 5, 200])
        s = np.array([r.randrange(k) for _ in range(n)], dtype=np.uint8)
        s = np.tile(s, 3)[:100] if r.random() < 0.3 else s
        text = bytes(s)
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffixes.suffix_array(s).tolist() == order
        previous, shared = suffixes.common_prefixes(s, np.array(order))
        for a, b in zip(order, order[1:], strict=False):
            same = 0
            while max(a, b) + same < len(text) and text[a + same] == text[b + same]:
                same += 1
            assert (previous[b], shared[b]) == (a, same)
        values, width = np.array([r.randrange(50) for _ in range(n)], dtype=np.uint64), r.randint(1, n)
        assert hashing.sliding(values, width).tolist() == [min(values[i:i + width]) for i in range(n - width + 1)]


def test_batches_for_python_end_by_bytes(spark):
    """pipeline and op10: 10,000 texts, 34 MB, went to a worker at once; an executor took more than 3000 MB."""
    from lectern.llm import ngram_join, suffix_tree

    docs, key = documents(spark, {1: "a b c", 2: None}), "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for run in (lambda: repeats.remove_repeats(docs), lambda: ngram_join.linked_components(docs), lambda: suffix_tree.score_documents(docs, F.lit(False))):
        spark.conf.unset(key)
        run()
        assert int(spark.conf.get(key).rstrip("b")) <= 8 << 20
    spark.conf.set(key, before)
