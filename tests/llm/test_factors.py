"""Removal of repeated passages against a plain version over all windows."""
import random

import pytest

from helpers import documents, words
from lectern.llm import factors


def brute(rows, window):
    seen = {}
    for k, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            if k is not None:
                key = tuple(w[i:i + window])
                seen[key] = min(k, seen.get(key, k))
    out = []
    for k, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if k is not None and seen[tuple(w[i:i + window])] < k:
                gone[i:i + window] = [True] * window
        out.append((k, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def random_rows(seed, count=160):
    rnd = random.Random(seed)
    kinds = [f"w{i}" for i in range(12)] + ["é", "É", "--", "x y"]
    bases = [[rnd.choice(kinds) for _ in range(rnd.randint(5, 80))] for _ in range(5)]
    rows = []
    for k in range(count):
        w = []
        for _ in range(rnd.randint(0, 4)):
            base = rnd.choice(bases)
            a = rnd.randrange(len(base))
            w += base[a:a + rnd.randint(1, 60)]
            w += [rnd.choice(kinds) for _ in range(rnd.randint(0, 6))]
        rows.append((k * 7 % count, rnd.choice([" ", "\n", "\t \r"]).join(w), "s"))
    return rows


@pytest.mark.parametrize(("seed", "window", "anchor", "block"), [(1, 13, 6, 1000), (2, 7, 3, 1000), (3, 13, 6, 2), (4, 5, 2, 1), (5, 4, 4, 3)])
def test_against_brute_force(spark, seed, window, anchor, block):
    rows = random_rows(seed)
    rows += [(900, None, "s"), (901, "", "s"), (902, " \n", "s"), (903, "w1 " * 400, "s"), (904, "w1 " * 30, "s"), (None, rows[3][1], "s"),
             (3, rows[9][1], "s"), (3, rows[11][1], "s"), (3, rows[11][1], "s"), (5, rows[12][1] + " " + rows[12][1], "s")]
    docs = documents(spark, rows, extra=True).selectExpr("*", "1 AS anchor", "2 AS body", "3 AS text_key", "4 AS found", "5 AS lo", "6 AS windows", "7 AS _slot")
    got = factors.remove_passages(docs, window, anchor, block).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute(rows, window)
    for r in got:
        assert sum(s.stop - s.begin for s in r.spans) == r.n_removed


def test_one_passage_in_many_contexts(spark):
    """The windows that leave the passage differ in nearly all documents; all of them share its anchors."""
    passage = [f"p{k}" for k in range(20)]
    rows = [(k, " ".join([*[f"a{k}-{i}" for i in range(9)], *passage, *[f"z{k % 7}-{i}" for i in range(9)]]), "s") for k in range(120)]
    for block in (1000, 10):
        got = factors.remove_passages(documents(spark, rows), block=block).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute(rows, 13)


def test_factors_are_greedy_and_checked_at_their_ends():
    block = factors.ReferenceBlock(3)
    block.add(b"a b c d".split())
    block.add(b"d e f".split())
    block.add(b"c d e".split())
    assert block.longest(b"a b c d e f".split(), 0) == 4
    assert block.factors(b"a b c d e f".split()) == [(0, 4), (2, 5), (3, 6)]
    assert block.factors(b"x a b".split()) == []


def test_no_rows(spark):
    docs = documents(spark, {1: "some words"})
    assert factors.remove_passages(docs.where("false")).collect() == []
    assert [tuple(r)[:4] for r in factors.remove_passages(docs).collect()] == [(1, 2, 0, "some words")]
