"""Whitening against exact fractions and a plain covariance."""
from fractions import Fraction
import math
import random

import numpy as np
import pytest

from lectern.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.selectExpr("*", "1 AS component", "2 AS n", "3 AS i", "4 AS j", "5 AS whitened", "'x' AS length", "0 AS d0") if extra else df


def exact(rows):
    """Per row (id, integers), exact covariance and deviations by the definition."""
    kept = [(k, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for k, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    s = [sum(x[i] for _, x in kept) for i in range(d)]
    z = [[n * x[i] - s[i] for i in range(d)] for _, x in kept]
    cov = [[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(d)] for i in range(d)]
    return kept, n, z, np.array(cov)


def check(spark, rows, most=32):
    kept, n, z, cov = exact(rows)
    values, axes = np.linalg.eigh(cov)
    got = {}
    for r in whitening.whiten(table(spark, rows, extra=True), most).collect():
        got.setdefault((r.vec_id, int(r.deviation)), []).append(r)
    count = min(most, len(cov))
    assert sum(map(len, got.values())) == n * count
    for (k, _), row in zip(kept, z, strict=True):
        mine = sorted(got[k, sum(v * v for v in row)], key=lambda r: r.component)
        for r in mine[:count]:
            e, axis = values[-r.component], axes[:, -r.component]
            want = sum(v / n * a for v, a in zip(row, axis, strict=True)) / math.sqrt(e)
            assert r.n == n and abs(abs(r.whitened) - abs(want)) < 1e-8
            assert abs(r.explained - e / np.trace(cov)) < 1e-10 and r.identity_error < 1e-9
    return got


@pytest.mark.parametrize(("d", "n", "spread"), [(5, 60, 1.0), (40, 90, 0.1), (3, 50, 5000.0)])
def test_against_exact_fractions(spark, d, n, spread):
    rnd = random.Random(d)
    rows = [(k, [rnd.gauss(0.3, spread) for _ in range(d)]) for k in range(n)]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (900, None), (901, [1.0] * (d - 1) + [None]), (902, [float("nan")] * d),
             (903, [float("inf")] + [0.0] * (d - 1)), (904, [])]
    check(spark, rows)


def test_large_entries_are_exact(spark):
    rnd = random.Random(5)
    check(spark, [(k, [rnd.gauss(0, 1) * 2.0**40, rnd.gauss(0, 1) * 2.0**41]) for k in range(40)])


def test_limbs_equal_plain_integers():
    rnd = np.random.default_rng(2)
    z = rnd.integers(-whitening.SPLIT_LIMIT + 1, whitening.SPLIT_LIMIT, (whitening.ROWS, 3))
    plain = z.astype(object)
    assert whitening.square_sums(z, 0).tolist() == (plain**2).sum(axis=0).tolist()
    assert whitening.square_sums(z[:, 1:], 0, z[:, :1]).tolist() == ((plain[:, 1:] + plain[:, :1])**2).sum(axis=0).tolist()
    assert whitening.square_sums(z, 1).tolist() == (plain**2).sum(axis=1).tolist()


def test_constant_single_and_no_vectors(spark):
    same = whitening.whiten(table(spark, [(k, [1.0, 2.0]) for k in range(4)])).collect()
    assert len(same) == 8 and {(int(r.deviation), r.whitened, r.explained, r.identity_error) for r in same} == {(0, None, None, None)}
    one = whitening.whiten(table(spark, [(3, [0.5])])).collect()
    assert [(r.vec_id, r.component, r.n, int(r.deviation), r.whitened) for r in one] == [(3, 1, 1, 0, None)]
    flat = whitening.whiten(table(spark, [(k, [float(k), 1.0]) for k in range(5)])).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)}
    empty = whitening.whiten(table(spark, [(1, [1.0])]).where("false"))
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_other_lengths_are_left_out(spark):
    rows = [(k, [float(k % 7), float(k % 5)]) for k in range(30)] + [(100, [1.0]), (101, [1.0, 2.0, 3.0])]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r.vec_id for r in got} == set(range(30)) and {r.n for r in got} == {30}
