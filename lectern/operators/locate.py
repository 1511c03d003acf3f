"""Locating quotes on pages: page text from characters, rectangles, page choice.

Page input, one row per page: ``doc_id, page_index, view_top, chars array<struct<c, u, x0, y0, x1, y1, ignorable,
line_break_after>>``. Pages without character data are absent or have null ``chars``.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lectern import values as v
from lectern.functions import kernels
from lectern.functions import text as t
from lectern.functions.arrays import at, indexes, let
from lectern.plans.skew import cut_lineage, hot_keys, spread_join

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"


PAGE_TEXT_TYPE = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))])
DROPPED = "".join(sorted(v.DROP_CHARS))


@F.pandas_udf(PAGE_TEXT_TYPE)
def page_text_udf(pages: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if units is None else kernels.units_text(units) for units in pages]
    return pd.DataFrame(rows, columns=["text", "offsets"])


def char_units(chars: Column) -> Column:
    """What each character stands for; empty for ignorable ones."""
    return F.transform(chars, lambda ch: F.when(F.coalesce(ch["ignorable"], F.lit(False)), F.lit("")).otherwise(
        F.coalesce(ch["u"], ch["c"], F.lit(""))))


def _plain(units: Column) -> Column:
    """Pages of plain single characters stay in the JVM."""
    return ~t.needs_kernel(F.array_join(units, "")) & F.forall(units, lambda u: F.length(u) <= 1)


@F.pandas_udf(PAGE_TEXT_TYPE)
def letters_text_udf(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if text is None else (kernels.canon_text(text), kernels.canon_offsets(text)) for text in texts]
    return pd.DataFrame(rows, columns=["text", "offsets"])


def with_page_text(pages: DataFrame, units: Column | None = None, letters: Column | None = None) -> DataFrame:
    """Adds ``text`` (canonical page text) and ``offsets`` (canonical position -> character index).

    Store the texts: every quote of a document reads them. Either column is made on its own, so who reads one does not pay for
    the other. ``units``: what the characters stand for (``char_units``) where pages hold something smaller than ``chars``. Rows that
    wait for Python hold all their columns, so neither the units nor the boxes are a column while they wait. ``letters``: a text whose
    characters are the units; it is read as a whole instead of unit by unit.
    """
    if letters is not None:
        rows = pages.where(letters.isNotNull()).withColumn("_odd", letters_text_udf(F.when(t.needs_kernel(letters), letters)))
        kept = let(F.split(letters, ""), lambda us: F.filter(indexes(us), lambda i: ~at(us, i).isin("", *DROPPED)))
        return rows.select(*pages.columns, F.coalesce("_odd.text", t.canon_plain(letters)).alias("text"),
                           F.coalesce("_odd.offsets", kept).alias("offsets"))

    def finished(rows: DataFrame, each: Column, odd: bool) -> DataFrame:
        text = t.canon_plain(F.array_join(each, ""))
        kept = let(each, lambda us: F.filter(indexes(us), lambda i: ~at(us, i).isin("", *DROPPED)))
        return rows.select(*pages.columns, (F.coalesce("_odd.text", text) if odd else text).alias("text"),
                           (F.coalesce("_odd.offsets", kept) if odd else kept).alias("offsets"))

    if units is not None:
        sent = let(units, lambda us: F.when(~_plain(us), us))
        return finished(pages.where(units.isNotNull()).withColumn("_odd", page_text_udf(sent)), units, True)
    # Batches for Python end by the bytes that are sent, and plain pages send none: any number of them would wait with their boxes
    units = char_units(F.col("chars"))
    plain = let(units, _plain)
    odd = pages.where(~plain).withColumn("_odd", page_text_udf(units))
    return finished(pages.where(plain), units, False).unionByName(finished(odd, units, True))


def sort_index(page_index: Column, first: Column, view_top: Column, rects: Column) -> Column:
    """Reading-order key ``page|character|distance from top``."""
    top = F.greatest(F.lit(0).cast("long"), F.floor(view_top - F.array_max(F.transform(rects, lambda r: r["y1"]))))
    return F.concat_ws("|", t.zero_pad(page_index, 5), t.zero_pad(first, 6), t.zero_pad(top, 5))


SPAN_TYPE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])


@F.pandas_udf(SPAN_TYPE)
def near_span_udf(hays: pd.Series, needles: pd.Series) -> pd.DataFrame:
    spans = [kernels.fuzzy_span(hay, needle) if hay is not None and needle is not None else None
             for hay, needle in zip(hays, needles)]
    return pd.DataFrame({
        "start": pd.array([s[0] if s else None for s in spans], dtype="Int32"),
        "stop": pd.array([s[1] if s else None for s in spans], dtype="Int32")})


def _page_spans(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """Matches of needles on their hinted page: ``keep``, page_index, mode, start, stop (canonical positions)."""
    first = F.call_function("locate", F.col("needle"), F.col("text"))
    size = F.length("needle")
    missing = (first == 0) & (size >= v.MIN_FUZZY_CHARS)
    narrow = pairs.select(
        *keep, "needle", "page_index", first.alias("_first"), F.when(missing, F.col("text")).alias("_text"))
    # explode keeps the filter below from running the kernel a second time
    near = narrow.withColumn("_found", near_span_udf("_text", "needle")).withColumn("_near", F.explode(F.array("_found")))
    mode = F.when(F.col("_first") > 0, "exact").when(F.col("_near.start").isNotNull(), "fuzzy")
    exact = F.col("_first") > 0
    return near.withColumn("mode", mode).where(F.col("mode").isNotNull()).select(
        *keep, "page_index", "mode",
        F.when(exact, F.col("_first") - 1).otherwise(F.col("_near.start")).alias("start"),
        F.when(exact, F.col("_first") - 1 + size).otherwise(F.col("_near.stop")).alias("stop"))


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to as many tasks as shuffles have. Left to itself Spark joins small partitions by bytes, but these are read by costly work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


class TextBoxes(NamedTuple):
    """Boxes that follow from the plain text of a page, whose characters are their units.

    ``column``: holds the text. ``boxes``: it as ``chars``. ``arrays``: the same boxes as NumPy arrays by the characters' indexes in their
    page: x0, y0, x1, y1, ignorable, line_break_after. Called with page rows it adds view_top, chars and offsets.
    """
    column: str
    boxes: Callable[[Column], Column]
    arrays: Callable[[np.ndarray], kernels.Boxes]
    view_top: float

    def __call__(self, rows: DataFrame) -> DataFrame:
        return with_page_text(rows, letters=F.col(self.column)).select(
            "*", F.lit(self.view_top).alias("view_top"), self.boxes(F.col(self.column)).alias("chars")).drop("text")


class PageBoxes(NamedTuple):
    """Page rows that spans are joined to, and what makes their ``view_top``, ``chars`` and ``offsets`` if the rows don't hold them."""
    rows: DataFrame
    boxed: TextBoxes | Callable[[DataFrame], DataFrame] | None


#: Spans that meet one copy of a page's boxes.
PAGE_SPANS = 1000
#: Characters of pages whose boxes are arrays at once.
CHARS_AT_ONCE = 1 << 18


def _stored_boxes(chars: pa.ListArray) -> kernels.Boxes:
    """Boxes of a column of ``chars``; what is no number counts as NaN, what is no flag as false."""
    fields = dict(zip((f.name for f in chars.type.value_type), chars.flatten().flatten(), strict=True))
    numbers = [fields[c].to_numpy(zero_copy_only=False).astype(float) for c in ("x0", "y0", "x1", "y1")]
    return kernels.Boxes(*numbers, *[fields[c].fill_null(False).to_numpy(zero_copy_only=False) for c in ("ignorable", "line_break_after")])


def _pages_at_once(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """First and last + 1 of pages that hold ``CHARS_AT_ONCE`` characters together, or one page with more."""
    low, held = 0, 0
    for k, size in enumerate(sizes):
        if k > low and held + size > CHARS_AT_ONCE:
            yield low, k
            low, held = k, 0
        held += size
    yield low, k + 1


def _page_rects(texts: tuple[str, Callable[[np.ndarray], kernels.Boxes]] | None):
    """Rectangles of the spans of page rows: id, page_index, view_top, mode, first (character), rects. Spans without sound boxes are left out."""
    def rects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            held = batch.column("asked")
            ends = held.value_lengths().to_numpy(zero_copy_only=False).cumsum()
            begins = ends - held.value_lengths().to_numpy(zero_copy_only=False)
            asked = held.flatten()
            mode = asked.field("mode").to_numpy(zero_copy_only=False)
            start, stop = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
            page = np.repeat(np.arange(len(batch)), ends - begins)
            letters = batch.column(texts[0]).fill_null("").to_pylist() if texts else None
            sizes = map(len, letters) if texts else batch.column("chars").value_lengths().fill_null(0).to_pylist()
            for low, high in _pages_at_once(sizes):
                spans = slice(begins[low], ends[high - 1])
                if texts:
                    chars = kernels.PageChars.of_texts(letters[low:high], texts[1])
                else:
                    part = batch.slice(low, high - low)
                    offsets = part.column("offsets")
                    chars = kernels.PageChars(
                        _stored_boxes(part.column("chars")), *kernels.starts_of(part.column("chars").value_lengths().fill_null(0)),
                        offsets.flatten().to_numpy(zero_copy_only=False), *kernels.starts_of(offsets.value_lengths().fill_null(0)))
                ambiguous = mode[spans] == "ambiguous"
                first, counts, boxes = chars.rects(page[spans] - low, start[spans], stop[spans], ~ambiguous)
                kept = ambiguous | (counts > 0)
                at_span = np.flatnonzero(kept)
                rows = pa.array(at_span + spans.start)
                ids, no_place = asked.field("id").take(rows), pa.array(ambiguous[at_span])
                places = np.concatenate([[0], np.where(ambiguous, 0, np.maximum(counts, 0))[at_span].cumsum()]).astype(np.int32)
                listed = pa.ListArray.from_arrays(
                    pa.array(places), pa.StructArray.from_arrays([pa.array(b) for b in boxes], names=["x0", "y0", "x1", "y1"]))
                on = pa.array(page[spans][at_span])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(on), ids, batch.column("page_index").take(on), batch.column("view_top").take(on),
                    asked.field("mode").take(rows), pc.if_else(no_place, None, pa.array(first[at_span].astype(np.int32))),
                    pc.if_else(no_place, pa.scalar(None, listed.type), listed)],
                    names=["doc_id", "id", "page_index", "view_top", "mode", "first", "rects"])
    return rects


def _with_rects(spans: DataFrame, boxes: PageBoxes, keep: list[str]) -> DataFrame:
    """Rectangles for spans (a written table); spans without sound boxes disappear, ambiguous ones stay as they are.

    A page's row travels once for all its spans; those of a page with very many are dealt to several copies of it.
    """
    counts = spans.groupBy("doc_id", "page_index").agg(F.ceil(F.count(F.lit(1)) / PAGE_SPANS).cast("long").alias("_slots")).where("_slots > 1")
    slot = F.pmod(F.xxhash64(*keep), F.coalesce("_slots", F.lit(1)))
    one = F.struct(F.struct(*[c for c in keep if c != "doc_id"]).alias("id"), "mode", "start", "stop")
    page = ["doc_id", "page_index"]
    asked = _dealt(spans.join(counts, page, "left").withColumn("_slot", slot), *page, "_slot").groupBy(*page, "_slot").agg(F.collect_list(one).alias("asked"))
    copies = boxes.rows.join(counts, page, "left").withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_slots", F.lit(1)).cast("long") - 1))).drop("_slots")
    joined = asked.join(copies, [*page, "_slot"])
    texts = None
    if isinstance(boxes.boxed, TextBoxes):
        texts = boxes.boxed.column, boxes.boxed.arrays
        joined = joined.select(*page, "asked", F.lit(boxes.boxed.view_top).alias("view_top"), F.col(texts[0]))
    else:
        joined = (boxes.boxed(joined) if boxes.boxed else joined).select(*page, "asked", "view_top", "chars", "offsets")
    id_type = asked.schema["asked"].dataType.elementType["id"]
    schema = T.StructType([spans.schema["doc_id"], id_type, spans.schema["page_index"], T.StructField("view_top", T.DoubleType()),
                           T.StructField("mode", T.StringType()), T.StructField("first", T.IntegerType()),
                           T.StructField("rects", T._parse_datatype_string(f"array<{RECT}>"))])
    found = joined.mapInArrow(_page_rects(texts), schema)
    return found.select(
        "doc_id", *[F.col(f"id.{c}").alias(c) for c in keep if c != "doc_id"], "page_index", "mode", "rects",
        sort_index(F.col("page_index"), F.col("first"), F.col("view_top"), F.col("rects")).alias("sort_index"))


def document_pages(pages: DataFrame) -> DataFrame:
    """doc_id, pages array<struct<page_index, text>>: all page texts of a document in one row."""
    return pages.groupBy("doc_id").agg(F.collect_list(F.struct("page_index", "text")).alias("pages"))


def _page_hits(near: bool):
    """Spans of many needles of a document on all its pages: exact ones, and near ones of needles without any (or only near ones)."""
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pages, modes, starts, stops = [], [], [], [], []
            held = batch.column("asked")
            firsts = held.offsets.to_pylist()
            asked = held.flatten() if len(held) else held.values
            needles, without = asked.field("needle").to_pylist(), asked.field("without").to_pylist()
            base = firsts[0] if firsts else 0
            for k, document in enumerate(batch.column("pages").to_pylist()):
                at, to = firsts[k] - base, firsts[k + 1] - base
                index = kernels.PageIndex([(p["page_index"], p["text"]) for p in document])
                exact = [[]] * (to - at) if near else index.exact(needles[at:to])
                for i, places in zip(range(at, to), exact, strict=True):
                    spans = [(page, "ambiguous" if again else "exact", start, start + len(needles[i])) for page, start, again in places]
                    if not spans:
                        spans = [(page, "fuzzy", start, stop) for page, start, stop in index.near(needles[i], set(without[i] or ()))]
                    for page, mode, start, stop in spans:
                        rows.append(i)
                        pages.append(page)
                        modes.append(mode)
                        starts.append(start)
                        stops.append(stop)
            yield pa.RecordBatch.from_arrays(
                [asked.field("id").take(pa.array(rows, pa.int64())), pa.array(pages, pa.int32()), pa.array(modes, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())],
                names=["id", "page_index", "mode", "start", "stop"])
    return hits


def _all_page_spans(needles: DataFrame, documents: DataFrame, keep: list[str], hot: DataFrame, near: bool = False) -> DataFrame:
    """``keep``, page_index, mode, start, stop of every page of the document that holds the needle.

    Needles go to their document together, so its text travels once and is read once for all of them; those of a document
    with very many are dealt to several copies of it. ``near``: pages in ``without`` are left out and only near matches are looked for.
    """
    slot = F.pmod(F.xxhash64(*keep, "needle"), F.coalesce("_slots", F.lit(1)).cast("long"))
    one = F.struct(F.struct(*keep).alias("id"), "needle", F.col("without") if near else F.lit(None).cast("array<int>").alias("without"))
    asked = needles.join(F.broadcast(hot), "doc_id", "left").withColumn("_slot", slot)
    asked = _dealt(asked, "doc_id", "_slot").groupBy("doc_id", "_slot").agg(F.collect_list(one).alias("asked"))
    schema = T.StructType([T.StructField("id", T.StructType([needles.schema[c] for c in keep])), T.StructField("page_index", T.IntegerType()),
                           T.StructField("mode", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    found = asked.join(documents, "doc_id").select("pages", "asked").mapInArrow(_page_hits(near), schema)
    return found.select("id.*", "page_index", "mode", "start", "stop")


def _search(needles: DataFrame, texts: DataFrame, documents: DataFrame, boxes: PageBoxes, key: list[str], hot: DataFrame) -> DataFrame:
    """Location per needle: hinted page first, then the page rules over all pages of the document.

    Spans are stored before the boxes are joined: they are a few numbers per quote, and reading them is cheaper
    than matching again. Exact matches settle a needle before any near match is looked for; only where none of them has sound
    boxes the other pages are searched for near ones. ``hot``: documents with very many needles.
    """
    keep = ["doc_id", *key]
    hint = needles.where(F.col("page") > 0).withColumn("page_index", F.col("page") - 1)
    on_hint = spread_join(hint, texts, ["doc_id", "page_index"], F.xxhash64(*keep))
    hint_spans = cut_lineage(_page_spans(on_hint, keep))
    hinted = cut_lineage(
        _with_rects(hint_spans, boxes, keep).withColumn("fuzzy", F.col("mode") == "fuzzy").drop("mode"))

    rest = cut_lineage(needles.join(hinted.select(*keep), keep, "left_anti").drop("page"))
    spans = cut_lineage(_all_page_spans(rest, documents, keep, hot))
    hits = cut_lineage(_with_rects(spans, boxes, keep))
    unsound = spans.where("mode = 'exact'").join(hits, keep, "left_anti").groupBy(*keep).agg(F.collect_set("page_index").alias("without"))
    unsound = cut_lineage(rest.join(unsound, keep))
    if not unsound.isEmpty():
        hits = hits.unionByName(_with_rects(cut_lineage(_all_page_spans(unsound, documents, keep, hot, near=True)), boxes, keep))
    place = F.struct("page_index", "rects", "sort_index")
    # Whatever the page order, an ambiguous page or a second exact page means no location.
    scanned = hits.groupBy(*keep).agg(
        F.count_if(F.col("mode") == "ambiguous").alias("ambiguous"),
        F.count_if(F.col("mode") == "exact").alias("exact"),
        F.min_by(F.when(F.col("mode") == "exact", place),
                 F.when(F.col("mode") == "exact", F.col("page_index"))).alias("exact_at"),
        F.min_by(F.when(F.col("mode") == "fuzzy", place),
                 F.when(F.col("mode") == "fuzzy", F.col("page_index"))).alias("fuzzy_at"),
    ).where((F.col("ambiguous") == 0) & (F.col("exact") <= 1)).select(
        *keep, F.coalesce("exact_at", "fuzzy_at").alias("at"), (F.col("exact") == 0).alias("fuzzy")
    ).select(*keep, "at.page_index", "at.rects", "at.sort_index", "fuzzy")
    return hinted.unionByName(scanned)


def locate(findings: DataFrame, pages: DataFrame, key: list[str], boxed: TextBoxes | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Places of quotes: doc_id, key, page_index, rects, sort_index, fuzzy, partial. Unlocated quotes are absent.

    ``findings``: doc_id, key columns, quote, page (1-based hint, 0 unknown). ``pages``: output of ``with_page_text``.
    Where boxes follow from something smaller, ``pages`` holds doc_id, page_index, text and that instead, and ``boxed`` adds view_top, chars
    and offsets to such rows after they have met their quotes: a character's box is a hundred times its size in memory. With ``TextBoxes``
    they are arrays that no row holds.
    A long quote found nowhere is tried by its first, then its last 55 %.
    """
    texts = pages.select("doc_id", "page_index", "text")
    documents = cut_lineage(document_pages(pages))
    held = [c for c in pages.columns if c not in ("doc_id", "page_index", "text")]
    boxes = PageBoxes(pages.select("doc_id", "page_index", *held), boxed)
    keep = ["doc_id", *key]
    # explode keeps the filter above the canonical form, which would be made twice, by Python too
    canonical = findings.select(*keep, "page", t.canon(F.coalesce("quote", F.lit(""))).alias("_needle"))
    needles = cut_lineage(
        canonical.select(*keep, "page", F.explode(F.array("_needle")).alias("needle")).where(F.length("needle") >= v.MIN_MATCH_CHARS))
    hot = hot_keys(needles, ["doc_id"])
    whole = cut_lineage(_search(needles, texts, documents, boxes, key, hot)).withColumn("partial", F.lit(False))

    cut = F.floor(F.length("needle") * F.lit(v.PARTIAL_SHARE)).cast("int")
    parts = (
        needles.where(F.length("needle") >= v.PARTIAL_MIN_CHARS)
        .join(whole.select(*keep), keep, "left_anti")
        .select(*keep, "page", F.posexplode(F.array(F.left("needle", cut), F.right("needle", cut))).alias("part", "needle"))
    )
    parts = cut_lineage(parts)
    if parts.isEmpty():
        return whole
    partial = _search(parts, texts, documents, boxes, [*key, "part"], hot)
    place = F.struct("page_index", "rects", "sort_index", "fuzzy")
    first_part = partial.groupBy(*keep).agg(F.min_by(place, "part").alias("at")).select(
        *keep, "at.*", F.lit(True).alias("partial"))
    return whole.unionByName(first_part)
