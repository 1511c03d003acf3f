import math
import random
from collections import Counter

from pyspark.sql import functions as F

from helpers import documents, lower, words
from lectern.llm import suffix_tree
from lectern.llm.common import remainder


def corpus():
    rnd = random.Random(8)
    two = [[f"a{k}" for k in range(12)], [f"B{k}" for k in range(12)]]
    texts = {}
    for k in range(300):
        kinds = rnd.choice(two)
        texts[k] = " ".join(rnd.choice(kinds) if rnd.random() < 0.95 else f"rare{rnd.randrange(3000)}" for _ in range(rnd.randint(5, 60)))
    return texts | {900: None, 901: "", 902: " \n", 903: "a1 " * 3000, 904: "never-seen É", 905: texts[0]}


def test_base_and_counts(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "HEAD_WORDS", 20)
    texts = corpus()
    held = F.pmod("doc_id", F.lit(7)) == 2
    got = {r.doc_id: r for r in suffix_tree.score_documents(documents(spark, texts, extra=True), held).collect()}
    assert set(got) == set(texts)
    count = Counter(w for k, t in texts.items() if k % 7 != 2 for w in [*words(lower(t)), "\n"])
    total = sum(count.values())
    better = 0
    for k, t in texts.items():
        tokens = [*words(lower(t)), "\n"]
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k % 7 == 2, len(tokens), sum(count[w] > 0 for w in tokens), total)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in tokens), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
        better += r.held_out and r.score > r.base_score
    assert better > 0.8 * sum(r.held_out for r in got.values())


def plain_tree(texts, depth, least, divergence, listed):
    """chance(words before, symbol), contexts and (symbol, chance) of a word by a tree of plain dictionaries."""
    streams = [["START", *words(lower(t)), "\n"] for t in texts]
    unigrams = Counter(w for s in streams for w in s[1:])
    whole = sum(unigrams.values()) + len(unigrams) + 1
    after = {}

    def symbol(w):
        return w if unigrams[w] >= least else "RARE"

    root = {"RARE": 1 / whole}
    for w, c in unigrams.items():
        root[symbol(w)] = root.get(symbol(w), 0) + (c + 1) / whole
    for s in streams:
        for k in range(1, len(s)):
            for d in range(1, min(depth, k) + 1):
                after.setdefault(tuple(s[k - d:k]), Counter())[symbol(s[k])] += 1
    after = {c: n for c, n in after.items() if sum(n.values()) >= least}

    def ratio(context, w):
        if not context:
            return root[w]
        return after[context][w] / sum(after[context].values())

    kept = {c for c, n in after.items() if sum(k * math.log(ratio(c, w) / ratio(c[1:], w)) for w, k in n.items()) - len(n) / 2 >= divergence}
    kept |= {c[k:] for c in kept for k in range(1, len(c))}

    def chance(context, w):
        while context and context not in kept:
            context = context[1:]
        if not context:
            return root[w]
        n, own = after[context], {}
        below = {x: chance(context[1:], x) for x, k in n.items() if k >= listed}
        for x, q in below.items():
            own[x] = (n[x] + suffix_tree.PRIOR * q) / (sum(n.values()) + suffix_tree.PRIOR)
        if w in own:
            return own[w]
        return chance(context[1:], w) * (1 - sum(own.values())) / (1 - sum(below.values()))

    return chance, kept, root, lambda w: (symbol(w), (unigrams[w] + 1) / whole)


def test_scores_are_those_of_a_plain_tree(spark, monkeypatch):
    # Some words and entries are broadcast and some joined.
    monkeypatch.setattr(suffix_tree, "HEAD_WORDS", 20)
    monkeypatch.setattr(suffix_tree, "HEAD_ENTRIES", 20)
    rnd = random.Random(3)
    texts = {}
    for k in range(150):
        s = [rnd.choice("abcd"), rnd.choice("abcd")]
        while len(s) < 30:  # the next word often follows from the two before it
            s.append("abcd"["abcd".index(s[-2]) ^ "abcd".index(s[-1])] if rnd.random() < 0.8 else rnd.choice("abcd"))
        texts[k] = " ".join(w.upper() if rnd.random() < 0.3 else w if rnd.random() < 0.9 else f"x{rnd.randrange(40)} {w}" for w in s)
    texts |= {500: None, 501: "", 502: "a"}
    got = suffix_tree.score_documents(documents(spark, texts), F.pmod("doc_id", F.lit(7)) == 2, 3, 10, 4.0, 3).collect()
    chance, kept, root, word = plain_tree([t for k, t in texts.items() if k % 7 != 2], 3, 10, 4.0, 3)
    assert {len(c) for c in kept} == {1, 2, 3}
    for context in list(kept)[:20] + [()]:
        assert math.isclose(sum(chance(context, w) for w in root), 1, rel_tol=1e-6)
    for r in got:
        s = ["START", *words(lower(texts[r.doc_id])), "\n"]
        want = 0.0
        for k in range(1, len(s)):
            own, base = word(s[k])
            want += math.log10(base * chance(tuple(s[max(0, k - 3):k]), own) / root[own])
        assert math.isclose(r.score, want, rel_tol=1e-9), (r.doc_id, r.score, want)


def test_no_training_and_no_rows(spark):
    docs = documents(spark, {2: "a b", 3: None})
    got = suffix_tree.score_documents(docs, F.lit(True)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    assert suffix_tree.score_documents(docs.where("false"), remainder(F.col("doc_id"), 7) == 2).collect() == []
