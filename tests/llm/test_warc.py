import base64
import hashlib

from lectern.llm import warc
from lectern.llm.common import shared_folder

PAGES = "page_id long, url string, html string, size int"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def run(spark, rows, least=0):
    df = spark.createDataFrame([(*r, 1) for r in rows], PAGES).coalesce(1)
    return sorted(map(tuple, warc.page_digests(spark, df, shared_folder(spark, "warc"), least).drop("uri").collect()), key=repr)


def test_round_trip_with_magic_in_payloads_and_small_splits(spark):
    bad = "x" + warc.END + warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 2\r\n\r\nab" + warc.END + "tail"
    rows = [(1, "http://a", bad), (2, "http://b", bad), (3, None, None), (4, "u", ""), (5, "u\r\nX: y", "é\r\n\r\n"), (None, "n", "zz"),
            (6, "q", "zz"), (7, "k", bad + "\r\n" + bad), (8, "l", warc.MAGIC * 3), (9, "long", "ab\n" * 50_000)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        got = run(spark, rows[:9])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    size = lambda t: len((t or "").encode())
    latest = {2: 2, 1: 2, 3: 4, None: 6}
    want = [(p, size(h), digest(h), "revisit" if p in (1, 3, None) else "response", latest[p] if p in (1, 3, None) else None) for p, _, h in rows[:9]]
    assert got == sorted(want, key=repr)
    assert run(spark, rows[9:]) == [(9, 150_000, digest("ab\n" * 50_000), "response", None)]


def test_short_payloads_are_responses_and_repeated_rows_stay(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "a", "yyyy"), (4, "a", "yyyy"), (4, "a", "yyyy")]
    got = run(spark, rows, least=2)
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (4, "response", None)]


def test_no_pages(spark):
    assert run(spark, []) == []
