import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import documents, words
from lectern.llm import mixing


def targets_by_hand(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        left = {s: w for s, w in weight.items() if s not in stopped}
        share = (total - sum(stopped.values())) / max(sum(left.values()), 1)
        over = [s for s in left if share * weight[s] > most * sizes[s] + 1e-9]
        if not over:
            return stopped | {s: share * w for s, w in left.items()}
        stopped |= {s: float(most * sizes[s]) for s in over}


def test_targets_and_words_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    rnd = random.Random(5)
    rows = [(k, " ".join("w" * rnd.choice([1, 5, 40])), rnd.choice(["a"] * 60 + ["b", "c", "É", "𐐀", "￮", None])) for k in range(700)]
    rows += [(900, None, "a"), (901, "", None), (902, " \t\n", "b"), (None, "x y z", "a"), (7, rows[7][1], rows[7][2])]
    got = mixing.mix(documents(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    want = targets_by_hand(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 2
    again = mixing.mix(documents(spark, rows).repartition(7)).collect()
    key = lambda r: (repr(r.doc_id), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    sevens = [r.taken for r in got if r.doc_id == 7]
    assert len(sevens) == 2 and sevens[0] == sevens[1]


def test_trade_keeps_mass_and_chances():
    rnd = np.random.default_rng(1)
    ends = []
    for _ in range(3000):
        share, held = mixing._trade(np.arange(4), np.array([3.0, 1.0, 2.0, 5.0]), np.array([0.5, 0.25, 0.75, 0.3]), rnd.random(4))
        assert (share * [3, 1, 2, 5]).sum() == pytest.approx(1.5 + 0.25 + 1.5 + 1.5)
        assert sum(0 < s < 1 for s in share) == (held >= 0)
        ends.append(share)
    assert np.mean(ends, axis=0) == pytest.approx([0.5, 0.25, 0.75, 0.3], abs=0.03)


def test_repeated_rows_of_the_mix(spark):
    docs = documents(spark, [(k, "a b c d", "s" if k % 2 else "t") for k in range(40)])
    mixed = mixing.mix(docs, cut_last=False)
    rows = mixing.repeat_rows(docs, mixed)
    assert rows.columns == docs.columns
    assert rows.count() == mixed.agg(F.sum("copies")).first()[0]
    assert mixed.where("part > 0").count() == 0
    assert mixing.mix(docs.where("false")).collect() == []
