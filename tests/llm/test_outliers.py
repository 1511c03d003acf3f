import random
from collections import Counter

from helpers import documents, words
from lectern.llm import outliers


def statistics_by_hand(text):
    w = words(text)
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_statistics_and_verdicts(spark):
    rnd = random.Random(4)
    syllables = ["the", "an", "or", "ti", "on", "éa", "wh"]
    texts = {}
    for k in range(400):
        w = ["".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(rnd.randint(25, 200))]
        texts[k] = "\n".join(" ".join(w[i:i + 9]) for i in range(0, len(w), 9))
    for k in range(400, 412):
        texts[k] = " ".join(x + "&&&" for x in texts[k - 400].split())
    texts |= {500: None, 501: "", 502: "few words", 503: "a b c d e f g h " * 9, 504: "same line here\n" * 8, 505: " \t\n", 506: texts[1], 507: "𐐀 x|y <z>"}
    got = {r.doc_id: r for r in outliers.judge(documents(spark, texts, extra=True)).collect()}
    assert len(got) == len(texts)
    for k, t in texts.items():
        r = got[k]
        n, chars, symbols, lines, repeats = statistics_by_hand(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats), k
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (r.base_failed and r.kept)
    assert all(got[k].kept for k in range(400))
    assert not any(got[k].kept for k in range(400, 412))


def test_few_rows_null_groups_and_no_rows(spark):
    text = " ".join(f"word{k}" for k in range(30))
    rows = [(1, text, None), (2, text + " &&&", "s"), (None, text, "t"), (2, text, "s")]
    assert sorted(r.kept for r in outliers.judge(documents(spark, rows)).collect()) == [True] * 4
    assert outliers.judge(documents(spark, rows).where("false")).collect() == []
