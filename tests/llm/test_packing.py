import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helpers import documents
from lectern.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, "a  b", " x", "x ", "<|endoftext|> hi", "don't  \n\n stop", "\n \n", "é　 ü", "a  b", "tab\t c", "𐐀 and it's"]


def ids_by_library(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_are_the_librarys():
    encode = packing.encoder(PATH)
    assert [encode(x or "").tolist() for x in ODD] == ids_by_library(ODD)


@pytest.mark.parametrize("horizon", [1 << 20, 700])
def test_round_trip(spark, horizon):
    rnd = random.Random(2)
    texts = {k: " ".join(rnd.choice(["the", "Of.", "thing", "a\nb", "!"]) for _ in range(rnd.choice([0, 3, 50, 900]))) for k in range(120)}
    texts |= {1000 + k: t for k, t in enumerate(ODD)} | {2000: "word " * 3000}
    want = {k: [*ids, 0] for k, ids in zip(texts, ids_by_library(list(texts.values())), strict=True)}
    rows = packing.pack(documents(spark, texts, extra=True), PATH, with_ids=True, horizon=horizon).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and len(r.ids) == r.length
    assert set(pieces) == set(want)
    for k, own in pieces.items():
        own.sort(key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == want[k] and {r.doc_tokens for r in own} == {len(want[k])}
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
        total = sum(r.length for r in own)
        assert total <= 1024
        padding += 0 if total & (total - 1) == 0 else 1024 - total
    assert padding <= 0.02 * 1024 * len(sequences)
    assert packing.pack(documents(spark, {1: "x"}).where("false"), PATH).collect() == []


def test_cuts_are_the_best(spark):
    for trial in range(200):
        r = random.Random(trial)
        length, n = r.choice([4, 8, 16]), r.randint(1, 60)
        places = sorted({0, n, *[x for x in range(n + 1) if r.random() < .6], *range(0, n, length), *range(max(0, n - length), n + 1)})
        penalty = [r.choice([0.0, 1.0, 4.0]) for _ in places]
        at = dict(zip(places, penalty, strict=True))

        def padding(i, j):
            short = j - i
            return 0 if short & (short - 1) == 0 and (j > n - length or short == length) else length - short

        best = {0: 0.0}
        for j in places[1:]:
            best[j] = at[j] + min(best[i] + padding(i, j) for i in places if j - length <= i < j)
        found = [0, *packing.cuts(np.array(places), np.array(penalty), length)]
        assert found[-1] == n
        assert sum(padding(a, b) + at[b] for a, b in zip(found, found[1:], strict=False)) == pytest.approx(best[n])
