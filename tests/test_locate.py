import pytest
from pyspark.sql import functions as F

from lectern.config import JobConfig
from lectern.operators import annotations, export, locate
from lectern.sources.tables import PAGE_CHARS

QUOTE = "Only one lantern kept burning."


def chars(text, gap_at=None, second_line_at=None):
    out = []
    for i, c in enumerate(text):
        x, y = i * 6.0 + (250 if gap_at is not None and i >= gap_at else 0), 700.0
        if second_line_at is not None and i >= second_line_at:
            x, y = 300.0 + 6 * (i - second_line_at), 680.0
        out.append((c, c, x, y, x + 6, y + 12, False, i == len(text) - 1))
    return out


def place(spark, quotes, pages):
    rows = [(1, i, 792.0, p if p is None or isinstance(p, list) else chars(p)) for i, p in enumerate(pages)]
    table = locate.with_page_text(spark.createDataFrame(rows, PAGE_CHARS))
    df = spark.createDataFrame([(1, i, q, hint) for i, (q, hint) in enumerate(quotes)], "doc_id long, n int, quote string, page int")
    return {r.n: r for r in locate.locate(df, table, ["n"]).collect()}


def test_boxes_cover_the_quote_only(spark):
    got = place(spark, [(QUOTE, 1)], ["ahead: " + QUOTE + " behind"])[0]
    assert got.page_index == 0 and got.rects[0].x0 == 42 and got.rects[-1].x1 == (7 + len(QUOTE)) * 6
    assert got.sort_index == "00000|000007|00080" and not got.fuzzy


def test_columns_and_lines_are_not_joined(spark):
    got = place(spark, [(QUOTE, 0)], [chars(QUOTE, gap_at=10)])[0]
    assert [(r.x0, r.x1) for r in got.rects] == [(0, 60), (310, 250 + 6 * len(QUOTE))]
    got = place(spark, [(QUOTE, 0)], [chars(QUOTE, second_line_at=20)])[0]
    assert [r.y0 for r in got.rects] == [700, 680]


def test_page_rules(spark):
    first = "The survey of the northern shore was broken off when the early storms came and"
    second = "resumed in the following spring with a smaller crew and two borrowed boats."
    tides = "For the corrected tide table T ∈ H0m×n, the observers kept one column for each slack hour."
    got = place(spark, [
        (QUOTE, 900), (QUOTE + " nobody wrote this", 0), (first + " " + second, 0),
        ("For the corrected tide table T0 ∈ Hm×n, the observers kept one column for each slack hour.", 4),
        ("second lamp on the final pier", 0), ("Said two times.", 0), ("Said two times.", 6)],
        [None, QUOTE, first, tides + " ", second, "Said two times. Said two times.",
         "The second la-mp on the ﬁnal pier there."])
    assert got[0].page_index == 1 and 1 not in got
    assert got[2].partial and got[2].page_index == 2
    assert got[3].fuzzy and got[3].page_index == 3
    assert got[4].page_index == 6 and not got[4].fuzzy
    assert 5 not in got and got[6].page_index == 5


def test_same_sentence_on_two_pages_and_malformed_boxes(spark):
    assert place(spark, [(QUOTE, 0)], [QUOTE, QUOTE]) == {}
    broken = [c[:2] + (float("nan"),) + c[3:] for c in chars(QUOTE)]
    assert place(spark, [(QUOTE, 0)], [broken, QUOTE])[0].page_index == 1


CFG = JobConfig()
LOCATED = ("doc_id long, ord int, category string, summary string, quote string, page_index int, sort_index string, "
           "rects array<struct<x0:double,y0:double,x1:double,y1:double>>")


@pytest.fixture(scope="module")
def located(spark):
    box = [(0.0, 700.0, 60.0, 712.0)]
    return spark.createDataFrame([
        (1, 0, "method", "m", "q0", 0, "s", box), (1, 1, "method", "other", "q0", 0, "s", box),
        (1, 2, "highlight", "h", "q1", 1, "s", box)], LOCATED)


def test_annotations_are_added_once(spark, located):
    nothing = annotations.as_annotations(located, CFG).limit(0)
    fresh = annotations.new_annotations(located, nothing, CFG)
    assert fresh.count() == 2 and {r.comment for r in fresh.collect()} == {"[LN·🔵 方法] m", "[LN·🟠 建议关注] h"}
    edited = fresh.withColumn("comment", F.concat("comment", F.lit(" my words")))
    assert annotations.new_annotations(located, edited, CFG).count() == 0
    manual = fresh.withColumn("tags", F.array(F.lit("mine")))
    assert annotations.new_annotations(located, manual, CFG).count() == 2
    kept, removed = annotations.clear_owned(edited.unionByName(manual), CFG)
    assert kept.count() == 2 and removed.first().removed == 2
    stats = annotations.annotation_stats(located, located, fresh).first()
    assert (stats.created, stats.existing, stats.skipped, stats.failed) == (2, 1, 0, 0)
    failures = spark.createDataFrame([(1, "disk full")], "doc_id long, message string")
    stats = annotations.annotation_stats(located, located, fresh, failures).first()
    assert (stats.created, stats.failed, stats.errors) == (1, 1, ["disk full"])


def test_export_checks_and_markup(spark, located):
    rows = export.export_rows(located)
    bad = rows.where("ord = 0")
    bad = (bad.withColumn("page", F.lit(-1)).unionByName(bad.withColumn("layer", F.lit("L1")))
           .unionByName(bad.withColumn("rects", F.slice("rects", 1, 0))).unionByName(bad.withColumn("category", F.lit("x"))))
    counts = spark.createDataFrame([(1, 2)], "doc_id long, page_count int")
    sound, rejected = export.check_export(rows.unionByName(bad), counts)
    assert sound.count() == 3 and sorted(r.reason for r in rejected.collect()) == ["category", "category", "no-rects", "page"]
    mark = {r.ord: r for r in export.markup_records(rows, "[x·").collect()}
    assert mark[2].subtype == "Underline" and mark[2].opacity == 1 and mark[0].opacity == 0.3
    assert mark[0].quad_points == [0, 712, 60, 712, 0, 700, 60, 700] and mark[0].rect == [0, 700, 60, 712]
    tree = export.bookmarks(rows, "root").orderBy("level", "group_ord", "ord").collect()
    assert [r.level for r in tree] == [0, 1, 1, 2, 2, 2] and tree[3].top == 724


def test_the_near_kernel_is_planned_once_a_pass(spark):
    pairs = spark.createDataFrame([(1, 1, "a needle that is long enough", 0, "page text")], "doc_id long, n int, needle string, page_index int, text string")
    plan = locate._page_spans(pairs, ["doc_id", "n"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_exact_on_an_unsound_page_leaves_near_matches_elsewhere(spark):
    long_quote = "the keeper wrote the same line in every book he was ever given to fill"
    broken = [c[:2] + (float("nan"),) + c[3:] for c in chars("xx " + long_quote)]
    near = long_quote.replace("same line", "sane line")
    got = place(spark, [(long_quote, 0), (long_quote, 1), (QUOTE, 0)], [broken, "yy " + near, near, QUOTE])
    assert (got[0].page_index, got[0].fuzzy, got[1].page_index, got[2].page_index) == (1, True, 1, 3)
    # the page with unsound boxes is no match, so one sound exact page is no tie
    got = place(spark, [(long_quote, 0)], [broken, near, long_quote])[0]
    assert (got.page_index, got.fuzzy) == (2, False)


def test_boxes_made_after_the_join_are_those_stored_before_it(spark):
    """F1 to F16: a table of boxes, a hundred times its text in memory, was written and shuffled."""
    from lectern.plans import catalog, derived

    texts = [QUOTE, "one page; " + QUOTE + " ﬁnal", "Said two times. Said two times.", "a long line of a hundred characters and more " * 3]
    flat = spark.createDataFrame([(i // 2, i % 2, x) for i, x in enumerate(texts)], "doc_id long, page_index int, text string")
    quotes = spark.createDataFrame([(d, n, q, hint) for d in (0, 1) for n, (q, hint) in enumerate(
        [(QUOTE, 1), (QUOTE, 0), ("pagE; " + QUOTE, 0), ("Said two times.", 0), ("characters and more a long line", 0), ("hundred characters", 2)])],
        "doc_id long, n int, quote string, page int")
    stored = locate.with_page_text(derived.page_chars(flat))
    small = stored.select("doc_id", "page_index", "text").join(flat.withColumnRenamed("text", "letters"), ["doc_id", "page_index"])
    want = sorted(map(str, locate.locate(quotes, stored, ["n"]).collect()))
    assert sorted(map(str, locate.locate(quotes, small, ["n"], catalog._boxed).collect())) == want and len(want) > 2
    assert catalog._page_texts(spark, "/root/testdata/sf0.001").columns == ["doc_id", "page_index", "letters", "text"]


def test_rows_that_wait_for_python_hold_no_boxes(spark):
    """F2 to F15: pages waited for Python with their boxes or units, and plain pages, which send nothing there, in any number."""
    from lectern.plans import catalog, derived

    flat = spark.createDataFrame([(0, 0, QUOTE), (0, 1, "ﬁnal"), (0, 2, None), (0, 3, "")], "doc_id long, page_index int, letters string")
    for made in (catalog._boxed(flat), locate.with_page_text(flat, derived.letters(F.col("letters")))):
        waiting = made._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")[1].split("\n", 1)[1]
        assert "x0" not in waiting and "transform(" not in waiting
    got = {r.page_index: r for r in locate.with_page_text(flat, derived.letters(F.col("letters"))).collect()}
    stored = locate.with_page_text(derived.page_chars(flat, "letters"))
    assert {r.page_index: (r.text, r.offsets) for r in stored.collect()} == {i: (r.text, r.offsets) for i, r in got.items()}
    assert set(got) == {0, 1, 3} and got[1].text == "final" and got[1].offsets == [0, 0, 1, 2, 3] and got[3].offsets == []
    plain = stored.where("page_index = 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plain.count("ArrowEvalPython") == 1 and "Union" in plain
