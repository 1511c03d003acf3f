import numpy as np
from pyspark.sql import functions as F

from lectern.llm import neighbours


def test_against_brute_force_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 100)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 5)
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((700, 24))
    vectors[50:90] = vectors[0]                   # a common vector, ties by id
    vectors[100] = vectors[0] * 7
    rows = [(k, [float(x) for x in v], k) for k, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1050, [0.0] * 24, 1), (1001, [float("nan")] * 24, 1), (1002, [None] + [1.0] * 23, 1), (None, [1.0] * 24, 1),
             (1100, [1.0, 2.0], 1), (1103, [float("inf")] * 24, 1), (3, rows[3][1], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int")
    got = {}
    for r in neighbours.nearest(df, F.pmod("vec_id", F.lit(50)) == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    hits = 0
    assert sorted(got) == list(range(0, 700, 50))
    for q, found in got.items():
        score = unit @ unit[q]
        score[q] = -9
        best = np.lexsort((np.arange(700), -score.round(12)))[:5]
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        for _, v, s in found:
            assert abs(s - score[v]) < 1e-12
    assert hits >= 0.95 * 5 * len(got)
    assert [v for _, v, _ in sorted(got[50])] == [0, 51, 52, 53, 54]


def test_few_candidates_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id, round(r.score, 12)) for r in got] == [(1, 1, round(0.5**0.5, 12))]
    assert neighbours.nearest(df.where("false"), F.lit(True)).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(4)
    vectors, queries = rng.standard_normal((3000, 64)), neighbours.unit(rng.standard_normal((20, 64)))
    guess, error = neighbours.estimate(*neighbours.encode(vectors), queries)
    assert (np.abs(guess - queries @ neighbours.unit(vectors).T) > error).mean() < 0.02
