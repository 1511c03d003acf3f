import random

from pyspark.sql import functions as F

from lectern.functions import kernels as k
from lectern.operators import corpus, findings, grounding, pages
from lectern.plans.skew import hot_keys, spread_join

PAGES = ["Opening words here. " + "k" * 200, "The ledger lists nine bar-\nrels of salt sold at the autumn fair. Rest."]


def corpus_of(spark, raw, total):
    df = spark.createDataFrame([(1, raw, total)], "doc_id long, raw_text string, total_pages int")
    return grounding.canonical_corpus(pages.parse_documents(df)[0])


def ground(spark, raw, total, claims):
    df = spark.createDataFrame([(i, 1, q, loc) for i, (q, loc) in enumerate(claims)], "i int, doc_id long, quote string, location string")
    return {r.i: r for r in grounding.ground(df, corpus_of(spark, raw, total), F.col("i")).collect()}


def test_correction_and_pages(spark):
    got = ground(spark, "\f".join(PAGES), 2, [
        ("The ledger lists nine barrels of fine salt sold at the autumn fair.", "Page 9"),
        ("nothing of this kind was ever printed on either page", "p. 4"), ("OPENING   words\nhere.", ""), ("ry", "")])
    assert got[0].verified and got[0].corrected and got[0].page == 2 and got[0].location == "PDF 第 2 页"
    assert got[0].quote.startswith("The ledger lists nine barrels of salt")
    assert not got[1].verified and got[1].page == 4
    assert got[2].verified and not got[2].corrected and got[2].quote == "OPENING   words\nhere." and got[2].page == 1
    assert not got[3].verified


def test_two_pages_and_markers(spark):
    same = "Both leaves carry this identical remark. "
    got = ground(spark, same * 5 + "last words of a leaf\f" + "first words of the next " + same * 5, 2, [
        ("Both leaves carry this identical remark.", "Page 1"),
        ("last words of a leaf [PDF Page 2] first words of the next", "")])
    assert got[0].verified and got[0].page == 0 and got[0].location == "Page 1"
    assert not got[1].verified


def test_no_page_info_keeps_the_named_page(spark):
    got = ground(spark, "\f".join(PAGES), 5, [("Opening words here.", "Page 7")])
    assert got[0].verified and got[0].page == 7 and got[0].location == "Page 7"


def test_hot_keys_are_spread_and_nothing_is_lost(spark):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    hot = hot_keys(facts, ["k"], share=0.01, min_rows=10)
    assert [(r.k, r._slots > 1) for r in hot.collect()] == [(1, True)]
    dims = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    joined = spread_join(facts, dims, ["k"], F.col("id"), hot=hot)
    assert joined.count() == 3000 and joined.where("w <> k * 2").count() == 0


def texts(rng, n):
    letters = "abcdefghij "
    return ["".join(rng.choice(letters) for _ in range(400)) for _ in range(n)]


def test_exact_passages_equal_brute_force_with_and_without_broadcast(spark):
    rng = random.Random(11)
    docs = texts(rng, 12)
    quotes = [docs[i][j:j + n] for i, j, n in [(0, 5, 40), (1, 100, 60), (2, 300, 90), (3, 0, 30)]] + ["never written anywhere at all"]
    docs[5] = docs[5][:100] + quotes[0] + docs[5][100:] + quotes[0]
    want = {(k.canon_text(q), i): k.canon_text(d).find(k.canon_text(q)) for q in quotes for i, d in enumerate(docs)
            if len(k.canon_text(q)) >= 20 and k.canon_text(q) in k.canon_text(d)}
    q = spark.createDataFrame([(x,) for x in quotes], "quote string")
    hay = corpus.corpus_hay(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    for limit in (corpus.BROADCAST_CHARS, 0):
        got = corpus.find_passages(q, hay, broadcast_chars=limit).collect()
        assert {(r.needle, r.doc_id): r.start for r in got} == want
    assert {r.occurrences for r in got if r.doc_id == 5} == {2}


def test_near_passages_equal_brute_force(spark):
    rng = random.Random(13)
    docs = texts(rng, 10)
    quotes = []
    for i in range(6):
        chars = list(docs[i][50:50 + 40 + 15 * i])
        for _ in range(1 + i % 4):
            chars[rng.randrange(len(chars))] = "#"
        quotes.append("".join(chars))
    want = set()
    for q in quotes:
        for i, d in enumerate(docs):
            hit = k.source_match(d, k.canon_text(q))
            if len(k.canon_text(q)) >= 20 and hit:
                want.add((k.canon_text(q), i, round(hit[2], 9)))
    q = spark.createDataFrame([(x,) for x in quotes], "quote string")
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for limit in (corpus.BROADCAST_CHARS, 0):
        got = corpus.find_near_passages(q, d, broadcast_chars=limit).collect()
        assert {(r.needle, r.doc_id, round(r.similarity, 9)) for r in got} == want and want


def test_normalised_results(spark):
    rows = ["{}", '{"results":null}', '{"highlights":[%s]}' % ",".join(['{"title":"x"}'] * 30),
            '{"method":{"summary":"M","quote":"q1","evidence":[{"quote":"q2"},{"quote":"q1"},{"quote":"q3"},{"quote":"q4"}]}}',
            '{"method":{"quote":"","evidence":"none"},"results":{"quote":"ok"}}']
    df = spark.createDataFrame(list(enumerate(rows)), "i int, j string")
    got = {r.i: r.r for r in df.select("i", findings.normalise_result(F.col("j")).alias("r")).collect()}
    assert got[0].method.summary == "未在正文中找到" and got[1].results.quote == ""
    assert len(got[2].highlights) == 12
    assert [e.quote for e in got[3].method.evidence] == ["q2", "q3"]
    assert got[4].results.quote == "ok" and got[4].method.evidence == []


def test_stored_pages_hold_no_second_copy_of_their_text(spark):
    from lectern.plans import catalog

    folder = "/root/testdata/sf0.001"
    assert not {"full_text", "hay"} & set(catalog._paper_pages(spark, folder).columns + catalog._canon_pages(spark, folder).columns)
    straight = grounding.canonical_corpus(pages.parse_documents(catalog.derived.raw_papers(spark, folder))[0])
    columns = ["doc_id", "pages", "full_text", "canon_pages", "hay", "has_page_info", "marked"]
    assert catalog._corpus(spark, folder).select(*columns).exceptAll(straight.select(*columns)).isEmpty()
    assert straight.select(*columns).exceptAll(catalog._corpus(spark, folder).select(*columns)).isEmpty()
    reader = pages.parse_reader_pages(spark.createDataFrame([(1, ["one", "two"])], "doc_id long, page_texts array<string>"))
    assert pages.with_full_text(reader.drop("full_text")).select("full_text").collect() == reader.select("full_text").collect()


def test_seed_votes_read_a_document_once(spark, monkeypatch):
    text = " ".join(f"The {i}th ledger lists {i * 7} barrels of salt sold at fair {i % 9}." for i in range(80))
    docs = spark.createDataFrame([(1, k.canon_text(text)), (2, None)], "doc_id long, hay string")
    quotes = [f"The {i}th ledger lists {i * 7} barrels of sugar sold at fair {i % 9}." for i in range(30)] + ["barrels of salt sold at fair", "short"]
    claims = spark.createDataFrame([(d, i, q) for d in (1, 2, 3) for i, q in enumerate(quotes)], "doc_id long, n int, quote string")
    voted = grounding.seed_votes(claims, docs, F.col("n"))
    got = {}
    for r in voted.collect():
        assert r.doc_id == 1
        got.setdefault(r.n, []).append((r["rank"], r.bucket, r.votes))
    want = {i: [(place, b, n) for place, (b, n) in enumerate(k.seed_votes(k.canon_text(text), k.canon_text(q)).most_common(), 1)]
            for i, q in enumerate(quotes[:30])}
    assert {i: sorted(rows) for i, rows in got.items()} == want
    assert "seed_votes_udf" not in voted._jdf.queryExecution().toString()  # that one took the text along with every needle


def test_a_claim_is_searched_once_in_its_document(spark):
    claims = spark.createDataFrame([(1, 1, "Opening words here.", "")], "i int, doc_id long, quote string, location string")
    plan = grounding.ground(claims, corpus_of(spark, "\f".join(PAGES), 2), F.col("i"))._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate inline" in line)
    assert "_exact" in generate and "contains(hay" not in generate.lower()


def test_batches_for_python_end_by_bytes(spark):
    from lectern.session import BATCH_BYTES, bounded_batches

    bounded_batches(spark)
    texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 40_000).alias("text"))
    size = F.pandas_udf(lambda s: s.map(lambda _: len(s)), "long")
    assert texts.select(size("text").alias("n")).agg(F.max("n")).first()[0] <= 2 * BATCH_BYTES // 40_000
