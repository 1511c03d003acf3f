import re

from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.functions.register import register


def one(spark, column, **values):
    schema = ", ".join(f"{n} string" for n in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_plain_canonical_form_equals_the_kernel_for_every_plain_character(spark):
    plain = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\U%08x" % int(m.group(1), 16), t.PLAIN_CLASS) + "]")
    rows = [("Ax" + chr(c) + "y",) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and plain.match(chr(c))]
    s = F.col("s")
    df = spark.createDataFrame(rows, "s string").select(t.canon_plain(s).alias("a"), t.canon_udf(s).alias("b"), t.needs_kernel(s).alias("odd"))
    assert len(rows) > 30000 and df.where("a <> b or odd").count() == 0


def test_canon_takes_odd_texts_to_the_kernel(spark):
    df = spark.createDataFrame([("ﬁxed — Σ",), ("Plain Text",), (None,), ("½",)], "s string")
    assert [r.x for r in df.select(t.canon(F.col("s")).alias("x")).collect()] == ["fixedσ", "plaintext", None, "1⁄2"]


def test_location_page(spark):
    cases = {"Section 3.2, Page 5": 5, "Sec. 2, p.7": 7, "第 12 页": 12, "Section 3.2": 0, "Page 99999": 0, "": 0,
             "sp. 9999, pp. 5": 5, "page 0, p. 3": 3}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", t.location_page(F.col("s")).alias("p"))
    assert {r.s: r.p for r in df.collect()} == cases


def test_display_forms(spark):
    assert one(spark, t.short_query(F.col("s")), s="We show that the meth- od reduces error by 12% on the held-out set of the benchmark.") \
        == "We show that the method reduces error by 12% on the"
    assert one(spark, t.short_query(F.col("s")), s="Short quote.") == "Short quote."
    assert one(spark, t.normalise_text(F.col("s")), s="\u00a0a\r\nb\tc\x1cd\n\n\n\ne \ufeff") == "a\nb c d\n\ne"
    assert one(spark, t.html_escape(F.col("s")), s='<a href="x">&') == "&lt;a href=&quot;x&quot;&gt;&amp;"
    assert one(spark, t.models_url(F.col("s")), s=" http://localhost:11434/v1/chat/completions/ ") == "http://localhost:11434/v1/models"
    assert one(spark, t.models_url(F.col("s")), s="https://example.test/custom") is None


def test_registered_names(spark):
    register(spark)
    row = spark.sql("SELECT canon('A-b') a, canon_map('ﬁx') m, best_substring('xxabcdyy', 'abd') b, extract_json('x {\"k\":1}') j").first()
    assert (row.a, row.m.text, row.m.map, row.b.distance, row.j) == ("ab", "fix", [0, 0, 1], 1, '{"k": 1}')
