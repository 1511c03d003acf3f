import random

import numpy as np
import pytest

from helpers import documents, lower, words
from lectern.llm import ngram_join


def brute(texts, n, percent):
    sets = {}
    for k, t in texts.items():
        w = words(lower(t))
        sets[k] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    low = {k: k for k in texts}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in texts}


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 3, 60), (3, 5, 80)])
def test_against_brute_force(spark, seed, n, percent):
    rnd = random.Random(seed)
    kinds = [f"W{i}" for i in range(40)]
    bases = [[rnd.choice(kinds) for _ in range(rnd.randint(1, 60))] for _ in range(6)]
    texts = {}
    for k in range(220):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rnd.randrange(len(w))] = rnd.choice(kinds)
        texts[k] = " ".join(w) if k % 2 else " ".join(w).lower() + "\n"
    texts |= {300: None, 301: "", 302: " \t", 303: "a b", 304: "A  b", 305: "x " * 500, 306: "É b c d e", 307: "é b c d e"}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(documents(spark, texts, extra=True), n, percent).collect()}
    assert got == brute(texts, n, percent)


def test_repeated_null_and_no_rows(spark):
    rows = [(5, "a b c d e", "s"), (5, "v w x y z", "s"), (9, "v w x y z", "s"), (2, "a b c d e", "s"), (None, "a b c d e", "s"), (7, "other words", "s")]
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.linked_components(documents(spark, rows)).collect()), key=repr)
    assert got == sorted([(5, 2), (5, 2), (9, 2), (2, 2), (None, None), (7, 7)], key=repr)
    assert ngram_join.linked_components(documents(spark, rows).where("false")).collect() == []


def test_a_member_links_where_its_representative_does_not(spark):
    """g and m differ in common n-grams only, so they have one prefix and g stands for both; x links with m alone."""
    m = [f"w{k}" for k in range(63)]
    g, x = list(m), list(m)
    g[50], x[10] = "changed", "other"
    texts = {1: " ".join(g), 2: " ".join(m), 3: " ".join(x)}
    texts |= {100 + k: " ".join([*[m, g][k % 2][44:57], *[f"f{k}-{i}" for i in range(30)]]) for k in range(20)}
    want = brute(texts, 4, 85)
    assert [want[k] for k in (1, 2, 3)] == [(60, 1)] * 3
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(documents(spark, texts)).collect()}
    assert got == want


def test_signatures_differ_in_no_more_bits_than_sets_differ_in_members():
    rnd = np.random.default_rng(6)
    for size in (3, 80, 900):
        a = np.unique(rnd.integers(0, 2**63, size).astype(np.uint64))
        b = np.concatenate([a[size // 3:], rnd.integers(0, 2**63, size // 5 + 1).astype(np.uint64)])
        texts = np.repeat([0, 2], [len(a), len(b)])
        x, empty, y = ngram_join.signatures(texts, np.concatenate([a, b]), 3)
        differ = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert differ <= len(set(a.tolist()) ^ set(b.tolist())) and not empty.any()


def test_a_group_of_copies_around_the_threshold(spark):
    """Every document changes its own words of one base, so about half of all pairs link and no bucket is settled at once."""
    rnd = random.Random(12)
    base = [f"b{k}" for k in range(80)]
    texts = {}
    for k in range(150):
        w = list(base)
        for place in rnd.sample(range(80), rnd.choice([1, 2, 2, 3])):
            w[place] = f"own{k}-{place}"
        texts[k] = " ".join(w)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(documents(spark, texts)).collect()}
    assert got == brute(texts, 4, 85)


def test_a_pair_of_near_copies_meets_once_not_for_each_shared_gram(spark):
    """Two sets that share 60 of 70 n-grams meet in one row, two that share a few in at least one, at whatever places these are."""
    rnd = random.Random(4)
    shared = sorted(rnd.sample(range(1000), 60))
    sets = {1: sorted([*shared, *range(2000, 2010)]), 2: sorted([*shared, *range(3000, 3010)])}
    sets |= {k: sorted(rnd.sample(range(10_000, 10_100), 30)) for k in range(3, 30)}
    rows = spark.createDataFrame([(g, k, 1000, at) for k, grams in sets.items() for at, g in enumerate(grams)], "bucket bigint, doc_id bigint, n bigint, at bigint")
    rows = ngram_join.with_earlier(rows, spark.createDataFrame([(29,)], "doc_id bigint"))
    other = rows.withColumnsRenamed({"doc_id": "d2", "n": "n2", "at": "at2", "before": "before2"})
    met = [(r.doc_id, r.d2) for r in rows.join(other, "bucket").where("doc_id < d2").where(ngram_join.first_meeting(50)).select("doc_id", "d2").collect()]
    assert met.count((1, 2)) == 1
    assert set(met) == {(a, b) for a in sets for b in sets if a < b and set(sets[a]) & set(sets[b])}
    assert max(r.most for r in rows.selectExpr("size(before) as most").collect()) == ngram_join.EARLIER
    assert rows.where("doc_id = 29 and size(before) > 0").count() == 0
