import random
import zlib

from helpers import documents
from lectern.llm import quality


def test_held_out_accuracy_and_odd_texts(spark):
    rnd = random.Random(6)
    make = lambda: " ".join("".join(rnd.choices(["the", "an", "or", "ti"], k=rnd.randint(1, 3))) for _ in range(rnd.randint(20, 80)))
    texts, labels = {}, []
    for k in range(300):
        good = rnd.random() < 0.7
        t = make()
        texts[k] = t if good else rnd.choice([t.upper() + "!!", " ".join(x + "###" for x in t.split()), (t.split()[0] + " ") * 40])
        labels.append((k, int(good), 0))
    texts |= {900: None, 901: "", 902: "x" * 100_000}
    table = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (77_777, 1, 0)], "doc_id long, quality int, score int")
    got = {r.doc_id: r for r in quality.classify(documents(spark, texts, extra=True), table).collect()}
    assert set(got) == set(texts)
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(got[k].predicted, q) for k, q, _ in labels if got[k].held_out]
    assert len(held) > 50 and sum(p == q for p, q in held) >= 0.97 * len(held)
    swapped = [(k, q if zlib.crc32(str(k).encode()) % 3 != 1 else 1 - q, 0) for k, q, _ in labels]
    again = quality.classify(documents(spark, texts), spark.createDataFrame(swapped, "doc_id long, quality int, toxic int")).collect()
    assert {r.doc_id: r.score for r in again} == {k: r.score for k, r in got.items()}


def test_no_labels_one_class_and_no_rows(spark):
    docs = documents(spark, {1: "a b", 2: None})
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.classify(docs, none).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "doc_id long, quality int")
    assert {r.predicted for r in quality.classify(documents(spark, {k: "t" for k in range(1, 5)}), one).collect()} == {1}
    assert quality.classify(docs.where("false"), one).collect() == []


def test_rules_of_printed_trees():
    text = """model
  Tree 0 (weight 1.0):
    If (feature 1 <= 0.5)
     If (feature 0 <= 2.0)
      Predict: 0.0
     Else (feature 0 > 2.0)
      Predict: 1.0
    Else (feature 1 > 0.5)
     Predict: 1.0
"""
    t = quality.Test
    assert quality.tree_rules(text, ("a", "b")) == [
        (t("b", False, 0.5),), (t("b", True, 0.5),), (t("a", False, 2.0), t("b", False, 0.5)), (t("a", True, 2.0), t("b", False, 0.5))]
