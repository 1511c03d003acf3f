import json

from pyspark.sql import functions as F

from lectern.operators import requests, responses
from lectern.sources.store import ResultStore, evict
from lectern.streaming import answers

STORE = "cache_key string, title string, model string, created_at timestamp, result string"


def log(spark, rows):
    return spark.createDataFrame(rows, "request_id long, endpoint string, attempt int, json_mode boolean, status int, content_type string, body string, failure string")


def test_answers_and_triage(spark):
    sse = "text/event-stream"
    piece = lambda s: 'data: {"choices":[{"delta":{"content":%s}}]}' % json.dumps(s)
    rows = [
        (1, sse, 200, "\r\n".join([piece('{"a"'), ": ping", "data: {broken", piece(":1}"), "data: [DONE]"])),
        (2, sse, 200, "\n".join([piece("partial"), 'data: {"error":{"message":"overloaded"}}'])),
        (3, "application/json", 200, '{"choices":[{"text":"T"}]}'), (4, "application/json", 200, '{"content":""}'),
        (5, "application/json", 200, "<html>"), (6, "application/json", 400, '{"error":{"message":"upstream rejected request"}}'),
        (7, "application/json", 401, "no"), (8, "application/json", 503, "No available channel"), (9, "application/json", 504, "x"),
        (10, sse, 200, 'data: {"choices":[{"delta":{"content":5}}]}')]
    df = log(spark, [(i, "e", 1, True, s, c, b, None) for i, c, s, b in rows] + [(11, "e", 1, True, None, None, None, "timeout")])
    got = {r.request_id: r for r in responses.read_answers(df).collect()}
    assert got[1].content == '{"a":1}' and got[1].error_kind is None
    assert (got[2].error_kind, got[2].detail, got[2].content) == ("http", "overloaded", None)
    assert got[3].content == "T" and got[4].error_kind == "empty" and got[5].error_kind == "http" and got[10].error_kind == "empty"
    assert [got[i].hint for i in (6, 7, 8, 9)] == ["content-review", "bad-key", "model-unavailable", "upstream-down"]
    assert got[11].error_kind == "timeout"


def test_text_after_a_json_value_makes_a_body_unreadable(spark):
    bodies = ['{"content":"a"}', ' {"content":"a"}\n ', '{"content":"a"} junk', '{"content":"a"},{"content":"b"}', '{"content":"a"}]', '', '[{"content":"a"}',
              '{"content":"a"} {"content":"b"}', '{"content":"b]\\"["}']
    df = log(spark, [(i, "e", 1, True, 200, "application/json", b, None) for i, b in enumerate(bodies)])
    got = {r.request_id: (r.content, r.error_kind) for r in responses.read_answers(df).collect()}
    unread = (None, "http")
    assert [got[i] for i in range(9)] == [("a", None), ("a", None), unread, unread, unread, unread, unread, unread, ('b]"[', None)]
    lines = ['data: {"choices":[{"text":"x"}]} junk', 'data: {"choices":[{"text":"y"}]}', "data: [DONE]"]
    sse = log(spark, [(1, "e", 1, True, 200, "text/event-stream", "\n".join(lines), None)])
    assert responses.read_answers(sse).first().content == "y"


def test_retries(spark):
    df = log(spark, [
        (1, "a", 1, True, 400, "", "Unknown parameter", None), (1, "a", 2, False, 200, "", "{}", None),
        (2, "b", 1, True, 400, "", "upstream rejected request", None), (3, "b", 1, True, 200, "", "no", None),
        (4, "b", 2, True, 200, "", "no", None), (5, "c", 1, True, 422, "", "unsupported", None),
        (6, "d", 1, True, 400, "", "Unknown parameter", None), (6, "d", 2, False, 200, "", "no", None),
        (7, "e", 1, True, 200, "", "no", None), (7, "e", 2, True, 200, "", "{}", None),
        (8, "f", 1, True, 200, "", "no", None), (8, "f", 2, True, 422, "", "unsupported", None)]).withColumn(
        "error_kind", F.when(F.col("request_id").isin(3, 4, 6, 8) & (F.col("status") == 200)
                             | (F.col("request_id") == 7) & (F.col("attempt") == 1), "parse").when(F.col("status") != 200, "http"))
    plan = requests.retry_plan(df)
    got = {r.request_id: (r.reason, r.attempt, r.json_mode, r.stricter) for r in plan.collect()}
    # 1 and 7 are answered; 4 was sent again before this log begins and gets its one stricter try
    assert got == {3: ("unreadable", 2, True, True), 4: ("unreadable", 3, True, True), 5: ("json-mode", 2, False, False),
                   6: ("unreadable", 3, False, True), 8: ("json-mode", 3, False, True)}
    assert sorted(r.endpoint for r in requests.endpoints_without_json_mode(df).collect()) == ["a", "d"]
    from lectern.config import JobConfig
    from lectern.operators.sections import with_condensed
    docs = with_condensed(spark.createDataFrame([(k, "some text", "meta") for k in (3, 5)], "request_id long, full_text string, meta_text string"), 1000)
    sent = {r.request_id: r for r in requests.retry_requests(plan, docs, JobConfig()).collect()}
    stricter = {k: requests.STRICTER.strip() in json.loads(r.body)["messages"][0]["content"] for k, r in sent.items()}
    assert stricter == {3: True, 5: False} and "response_format" not in json.loads(sent[5].body) and sent[5].attempt == 2


def test_requests_drop_json_mode_where_it_is_refused(spark):
    from lectern.config import JobConfig
    from lectern.operators.sections import with_condensed
    docs = with_condensed(spark.createDataFrame([(1, "x" * 40000, "meta")], "doc_id long, full_text string, meta_text string"), 100000)
    cfg = JobConfig(endpoint="e", highlight_count=0)
    body = json.loads(requests.request_rows(docs, cfg).first().body)
    assert body["response_format"] == {"type": "json_object"} and "5-8" in body["messages"][0]["content"] and len(body["messages"]) == 1
    known = spark.createDataFrame([("e",)], "endpoint string")
    row = requests.request_rows(docs, JobConfig(endpoint="e", highlight_count=4), known).first()
    assert "response_format" not in json.loads(row.body) and not row.json_mode and "worth reading closely): 4." in row.body


def test_store(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"), STORE)
    assert store.read().count() == 0
    rows = lambda *xs: spark.createDataFrame([(k, "t", "m", None, r) for k, r in xs], STORE).withColumn(
        "created_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    store.upsert(rows(("a", "1"), ("b", "1")))
    store.upsert(rows(("a", "2"), ("c", "1")))
    assert {r.cache_key: r.result for r in store.read().collect()} == {"a": "2", "b": "1", "c": "1"}
    assert store.clear() == 3 and store.read().count() == 0
    many = spark.range(505).select(F.col("id").cast("string").alias("cache_key"), F.timestamp_seconds("id").alias("created_at"))
    assert {int(r.cache_key) for r in evict(many).collect()} == set(range(5, 505))


def test_two_writers_lose_no_update_and_old_versions_go(spark, tmp_path):
    import threading
    path = str(tmp_path / "store")
    rows = lambda *xs: spark.createDataFrame([(k, "t", "m", None, "1") for k in xs], STORE).withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    stores = [ResultStore(spark, path, STORE) for _ in range(3)]
    threads = [threading.Thread(target=store.upsert, args=(rows(f"k{n}", "shared"),)) for n, store in enumerate(stores)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert sorted(r.cache_key for r in stores[0].read().collect()) == ["k0", "k1", "k2", "shared"]
    assert stores[0].upsert(rows("k9"), capacity=2) == 4
    assert len(list((tmp_path / "store").glob("data-*"))) == 2 and stores[1].read().count() == 2


def test_a_claimed_version_is_not_claimed_again(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"), STORE)
    assert store._claim(1, "first") and not store._claim(1, "second") and store._folder(1) == "first"
    assert not list((tmp_path / "store" / "aside").glob("[!.]*"))


def test_text_files_and_page_rows(spark, tmp_path):
    from lectern.operators import pages
    from lectern.sources import tables
    (tmp_path / "12.txt").write_text("one\ftwo\f")
    (tmp_path / "7.txt").write_text("only")
    got = {r.doc_id: (r.raw_text, r.total_pages) for r in tables.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {12: ("one\ftwo\f", 2), 7: ("only", 1)}
    rows = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 0, "a"), (2, 5, None)], "doc_id long, page_index int, text string")
    assert {r.doc_id: r.page_texts for r in pages.from_page_rows(rows).collect()} == {1: ["a", "c"], 2: [None]}


def piece(text):
    return 'data: {"choices":[{"delta":{"content":"%s"}}]}' % text


DONE = "data: [DONE]"


def stream(spark, folder, batches, idle_ms=60_000, overall_ms=600_000, delay="0 seconds"):
    """Answers after each batch of (request, seq, line, second); each batch is a run of the stream that goes on from the last."""
    out, told = f"{folder}/out", []
    for rows in batches:
        spark.createDataFrame(rows, "request_id long, seq long, line string, t long").select(
            "request_id", "seq", "line", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        lines = spark.readStream.schema("request_id long, seq long, line string, ts timestamp").parquet(f"{folder}/in")
        answers.write_answers(lines, out, f"{folder}/progress", idle_ms, overall_ms, delay).awaitTermination()
        found = spark.read.schema(answers.OUTPUT).parquet(out).collect()
        told.append({r.request_id: (r.content, r.error_kind, r.detail) for r in found})
        assert len(found) == len(told[-1])
    return told


def test_streamed_answers_end_fail_or_time_out(spark, tmp_path):
    got = stream(spark, tmp_path, [
        [(1, 0, piece("He"), 1000), (2, 0, piece("cut"), 1000), (3, 0, piece("x"), 1000)],
        [(1, 1, piece("llo"), 1010), (1, 2, DONE, 1010), (3, 1, 'data: {"error":{"message":"bad"}}', 1010)],
        [(1, 3, piece("late"), 1020), (4, 0, piece("y"), 5000)]])
    assert got == [{}, {1: ("Hello", None, None), 3: (None, "http", "bad")},
                   {1: ("Hello", None, None), 2: (None, "timeout", None), 3: (None, "http", "bad")}]


def test_streamed_answers_wait_for_lines_before_the_end_mark(spark, tmp_path):
    empty = (None, "empty", None)
    got = stream(spark, tmp_path, [
        [(1, 0, piece("a"), 1000), (1, 3, DONE, 1003), (1, 4, piece("after"), 1003), (2, 0, piece("x"), 1000), (2, 2, DONE, 1001), (3, 0, DONE, 1000),
         (4, 0, ": only a comment", 1000)],
        [(1, 2, piece("c"), 990), (1, 0, piece("a"), 1000)],
        [(1, 1, ": keep-alive", 1001)],
        [(9, 0, piece("y"), 5000)]], delay="60 seconds")
    assert got == [{3: empty}, {3: empty}, {3: empty, 1: ("ac", None, None)}, {3: empty, 1: ("ac", None, None), 2: (None, "timeout", None)}]


def test_streamed_answers_have_an_overall_limit(spark, tmp_path):
    """Request 1 gets a piece each 50 seconds and is never idle; 2 ends just in time."""
    dribble = [[(1, k, piece("x"), 1000 + 50 * k)] for k in range(7)]
    dribble[0] += [(2, 0, piece("b"), 1000)]
    dribble[3] += [(2, 1, piece("e"), 1150)]
    dribble[4] += [(2, 2, DONE, 1199)]
    got = stream(spark, tmp_path, dribble, overall_ms=200_000)
    # 2 has no event for longer than the idle limit
    assert got[3] == {2: (None, "timeout", None)} and got[6] == {2: (None, "timeout", None), 1: (None, "timeout", None)}
    late = [(3, 0, piece("c"), 1000), (3, 1, DONE, 1201), (4, 0, piece("d"), 1000), (4, 1, DONE, 1200), (9, 0, piece("y"), 5000)]
    (once,) = stream(spark, f"{tmp_path}/once", [late], overall_ms=200_000)
    assert once == {3: (None, "timeout", None), 4: ("d", None, None)}


def test_streams_read_files_and_folders_alike(spark, tmp_path):
    from lectern.plans.catalog import QUERIES
    for name in ("conversations", "documents", "labels"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        rows.repartition(5).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("streamed_answers", "stream_requests", "stream_grounding"):
        one, other = (sorted(map(str, QUERIES[name](spark, folder).collect())) for folder in ("/root/testdata/sf0.001", str(tmp_path)))
        assert one and one == other


def test_every_sql_has_its_query():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_odd_list_elements_do_not_spoil_a_list(spark):
    from lectern.operators import findings
    answers = ['{"method":{"summary":"s","quote":"q","evidence":[7,null,{"quote":"e1","summary":5},["x"],{"quote":"q"},{"quote":"e2"},{"quote":"e3"}]},'
               '"highlights":["plain",{"title":"t","quote":3},null]}', '{"method":7,"results":{"evidence":5,"quote":"z"},"highlights":{"a":1}}']
    rows = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, a string")
    first, second = [r.r for r in rows.select("k", findings.normalise_result(F.col("a")).alias("r")).orderBy("k").collect()]
    assert [(e.quote, e.summary) for e in first.method.evidence] == [("e1", "5"), ("e2", first.results.summary)]
    assert [(h.title == "t", h.quote) for h in first.highlights] == [(False, ""), (True, "3"), (False, "")]
    assert second.results.quote == "z" and second.results.evidence == [] and second.highlights == []


def test_an_annotation_that_comes_in_several_files_is_that_of_the_first_finding(spark):
    """with more files than a batch takes, a later finding of a place used to be stored first."""
    from lectern.config import JobConfig
    from lectern.streaming import checks

    located = spark.range(20).selectExpr("id AS doc_id", "explode(sequence(0, 31)) AS ord").selectExpr(
        "doc_id", "ord", "'highlight' AS category", "'00000|000000|00000' AS sort_index", "0 AS page_index",
        "array(named_struct('x0', 0D, 'y0', 0D, 'x1', 6D, 'y1', 12D)) AS rects", "'same words' AS quote", "concat('summary ', ord) AS summary")
    rows = checks.annotations_written_twice(spark, "", located.repartition(32, "ord"), JobConfig()).collect()
    assert len(rows) == 20 and all(r.comment.endswith("summary 0") for r in rows)


def test_the_store_of_the_query_has_its_whole_capacity(spark, tmp_path):
    """the query kept 100 of the entries."""
    from lectern.plans.catalog import QUERIES

    spark.range(700).selectExpr("id AS user_id", "'view' AS event_type", "timestamp_seconds(id) AS ts", "'{}' AS props").write.parquet(
        f"{tmp_path}/events.parquet")
    assert {int(r.cache_key) for r in QUERIES["cache_evict"](spark, str(tmp_path)).collect()} == set(range(200, 700))


def test_streams_are_cut_in_one_pass_and_hold_the_whole_answer(spark):
    from lectern.plans import derived

    log = derived.response_log(spark, "/root/testdata/sf0.001").where("doc_id % 6 = 4")
    whole = derived.answers(spark, "/root/testdata/sf0.001").select("doc_id", "answer")
    rows = log.join(whole, "doc_id").select("body", "answer").collect()
    for r in rows:
        events = [json.loads(line[6:])["choices"][0]["delta"]["content"] for line in r.body.split("\n\n")[:-1]]
        assert "".join(events) == r.answer and {len(e) for e in events[:-1]} <= {derived.ANSWER_PIECE}
    assert rows
