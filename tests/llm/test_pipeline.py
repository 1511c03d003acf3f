"""Each stage on its own small input, and the whole of them."""
import random

import pytest
from helpers import documents

import corpus_pipeline as pipeline


@pytest.fixture
def folder(spark, tmp_path):
    rnd = random.Random(9)
    make = lambda n: " ".join("".join(rnd.choices(["the", "an", "or", "ti", "wh"], k=rnd.randint(1, 4))) for _ in range(n))
    passage = make(120)
    texts = {}
    for k in range(200):
        texts[k] = make(rnd.randint(60, 150))
    for k in range(200, 240):
        texts[k] = texts[k - 200].upper() + " !!"
    texts[300], texts[301] = texts[5], texts[6] + " end"
    texts[302], texts[303] = make(80) + " " + passage, make(90) + " " + passage + " " + make(40)
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 200), 0) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), texts


def test_stages(spark, folder):
    path, texts = folder
    rows = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = rows.columns, {}
    for name, stage in pipeline.STAGES:
        rows = stage(spark, rows, path)
        path_out = f"{path}/{len(kept)}"
        rows.write.parquet(path_out)
        rows = spark.read.parquet(path_out)
        kept[name] = rows.collect()
        assert rows.columns == columns or name == "packing"
    first = {r.doc_id for r in kept["quality classifier"]}
    assert first == set(texts) - set(range(200, 240))
    assert {r.doc_id for r in kept["n-gram Jaccard join"]} == first - {300, 301}
    left = {r.doc_id: r for r in kept["suffix-array dedup"]}
    assert set(left) == first - {300, 301}
    assert all(left[k].text == texts[k] for k in left if k < 300)
    assert all(len(left[k].text) < len(texts[k]) - 400 and left[k].n_chars == len(left[k].text) for k in (302, 303))
    mixed = [r.doc_id for r in kept["mixing to target weights"]]
    assert set(mixed) <= set(left) and max(mixed.count(k) for k in set(mixed)) <= 3
    assert sum(r.length for r in kept["packing"]) == sum(r.doc_tokens for r in kept["packing"] if r.start == 0)
    assert pipeline.run(spark, path).count() == len(kept["packing"])


def test_empty_and_repeated_rows(spark, folder):
    path, _ = folder
    for table in (documents(spark, {}).where("false"), documents(spark, [(1, None, None), (1, "", None), (None, None, "s"), (None, "", "s")])):
        rows = table
        for _, stage in pipeline.STAGES:
            rows = stage(spark, rows, path)
        rows.collect()


@pytest.mark.parametrize("empty", [False, True])
def test_clashing_columns(spark, folder, empty):
    """The later stages keep columns of whatever names they use inside themselves."""
    path, _ = folder
    rows = spark.read.parquet(f"{path}/documents.parquet").where("false" if empty else "doc_id < 12")
    rows = rows.unionByName(rows.where("doc_id = 3")).selectExpr(
        "*", "1 AS _text", "2 AS _key", "3 AS _spans", "4 AS copies", "5 AS copy", "6 AS `row`", "7 AS rank", "8 AS _rank", "9 AS n_bytes", "10 AS n_removed", "'a' AS m_id", "11 AS `count`")
    columns = rows.columns
    for _, stage in pipeline.STAGES[1:4]:
        rows = stage(spark, rows, path)
        assert rows.columns == columns
    found = rows.collect()
    assert not found if empty else {tuple(r[5:]) for r in found} == {(1, 2, 3, 4, 5, 6, 7, 8, 9, 10, "a", 11)}
