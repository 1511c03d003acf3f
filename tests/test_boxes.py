import random

import numpy as np
from pyspark.sql import functions as F

from lectern import values as v
from lectern.functions import kernels
from lectern.operators import locate
from lectern.plans import catalog, derived


def folded(boxes):
    """The rule read box by box; None where no rectangle can be made."""
    done, cur, broke = [], None, False
    for x0, y0, x1, y1, skip, ends in boxes:
        if not skip and not all(map(np.isfinite, (x0, y0, x1, y1))):
            return None
        x0, x1, y0, y1 = *sorted((x0, x1)), *sorted((y0, y1))
        if not skip and x0 != x1 and y0 != y1:
            if (cur and not broke and abs(cur[1] - y0) < v.RECT_LINE_TOLERANCE and abs(cur[3] - y1) < v.RECT_LINE_TOLERANCE
                    and x0 >= cur[0] and x0 - cur[2] <= v.RECT_MAX_GAP):
                cur[2] = max(cur[2], x1)
            else:
                cur = [x0, y0, x1, y1]
                done.append(cur)
        broke = ends
    return done or None


def test_rectangles_of_many_runs_are_those_of_the_fold():
    rng = random.Random(3)
    odd = [float("nan"), float("inf")]
    runs = []
    for _ in range(600):
        x, run = 0.0, []
        for _ in range(rng.randint(0, 25)):
            x = rng.choice([x + 6, x + 6, x + 6, x - 3, x - 300, x + 6 + v.RECT_MAX_GAP, x + 400, x])
            y = 700 - 12 * (rng.random() < 0.1) + rng.choice([0, 0, 0, v.RECT_LINE_TOLERANCE / 2, v.RECT_LINE_TOLERANCE])
            corners = [x, y, x + rng.choice([6, 6, 20, 0, -6]), y + 12]
            if rng.random() < 0.01:
                corners[rng.randrange(4)] = rng.choice(odd)
            run.append((*corners, rng.random() < 0.1, rng.random() < 0.05))
        runs.append(run)
    flat = [box for run in runs for box in run]
    fields = [np.array([box[i] for box in flat], float if i < 4 else bool) for i in range(6)]
    counts, rects = kernels.merged_rects(kernels.Boxes(*fields), np.array([len(run) for run in runs]))
    got, at = [], 0
    for n in counts:
        got.append([[float(r[i]) for r in rects] for i in range(at, at + n)] or None)
        at += n
    assert got == [folded(run) for run in runs] and at == len(rects[0]) and any(n > 2 for n in counts)


def test_boxes_as_arrays_are_those_of_the_column(spark):
    text = "a ﬁne 😀 text of more than eighty characters, " * 4
    rows = spark.createDataFrame([(text,)], "text string").select(F.explode(derived.char_boxes(F.col("text"))).alias("b")).select("b.*").collect()
    made = derived.box_arrays(np.arange(len(text)))
    assert [[r[c] for c in kernels.Boxes._fields] for r in rows] == [list(box) for box in zip(*(a.tolist() for a in made), strict=True)]


def test_pages_are_taken_in_parts_and_none_is_left_out(monkeypatch):
    monkeypatch.setattr(locate, "CHARS_AT_ONCE", 10)
    assert [*locate._pages_at_once([4, 4, 4, 30, 0])] == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert [*locate._pages_at_once([0])] == [(0, 1)]


def test_no_row_holds_boxes_of_texts(spark):
    """F2 to F17: every character of a page was a struct, and those of a span were folded one by one, 3 microseconds each."""
    spans = spark.createDataFrame([(0, 0, 0, "exact", 1, 4), (0, 1, 0, "ambiguous", 1, 4), (0, 2, 1, "exact", 0, 5), (0, 3, 1, "exact", 3, 99)],
                                  "doc_id long, n int, page_index int, mode string, start int, stop int")
    pages = spark.createDataFrame([(0, 0, "a b-c d"), (0, 1, "ﬁnal")], "doc_id long, page_index int, letters string")
    found = locate._with_rects(spans, locate.PageBoxes(pages, catalog._boxed), ["doc_id", "n"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "line_break_after" not in plan and "MapInArrow" in plan
    got = {r.n: (r.page_index, r["mode"], r.sort_index, r.rects and [tuple(b) for b in r.rects]) for r in found.collect()}
    # of "abcd" the last three; "fi" is one character of the page; positions beyond the text have no place
    assert got[0] == (0, "exact", "00000|000002|00080", [(12.0, 700.0, 42.0, 712.0)])
    assert got[1][3] is None and got[2] == (1, "exact", "00001|000000|00080", [(0.0, 700.0, 24.0, 712.0)]) and 3 not in got
