"""Data of an annotated copy: export rows, their checks, markup records, bookmarks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from lectern import values as v
from lectern.operators.annotations import category_column


def export_rows(located: DataFrame) -> DataFrame:
    """Verified, located findings as export rows; highlights go to the reading layer."""
    layer = F.when(F.col("category") == v.HIGHLIGHT, v.LAYER_READING).otherwise(v.LAYER_SENTENCE)
    return located.select("doc_id", "ord", "category", F.col("page_index").alias("page"), "rects", "quote", "summary",
                          layer.alias("layer"))


def skipped_counts(findings: DataFrame, located: DataFrame) -> DataFrame:
    """Per document: findings with a quote that produced no export row, and those that did."""
    asked = findings.where(F.coalesce(F.col("quote"), F.lit("")) != "").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("asked"))
    placed = located.groupBy("doc_id").agg(F.count(F.lit(1)).alias("annotated"))
    return asked.join(placed, "doc_id", "left").fillna({"annotated": 0}).select(
        "doc_id", "annotated", (F.col("asked") - F.col("annotated")).alias("skipped"))


def reject_reason(page_count: Column) -> Column:
    """Why an export row is unusable, null for a sound one."""
    number = lambda n: n.isNotNull() & ~F.isnan(n) & (F.abs(n) < F.lit(float("inf")))
    finite = lambda r: number(r["x0"]) & number(r["y0"]) & number(r["x1"]) & number(r["y1"])
    ordered = lambda r: (r["x0"] < r["x1"]) & (r["y0"] < r["y1"])
    bad_page = F.col("page").isNull() | (F.col("page") < 0) | (F.col("page") >= page_count)
    bad_kind = ~F.coalesce(F.col("category").isin(*v.ALL_CATEGORIES), F.lit(False)) | ~F.coalesce(
        F.col("layer").isin(v.LAYER_SENTENCE, v.LAYER_READING), F.lit(False))
    return (
        F.when(bad_page, "page").when(bad_kind, "category")
        .when(F.coalesce(F.size("rects"), F.lit(0)) <= 0, "no-rects")
        .when(~F.forall("rects", finite), "coordinate").when(~F.forall("rects", ordered), "rectangle"))


def check_export(rows: DataFrame, page_counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound rows, rejected rows with ``reason``). ``page_counts``: doc_id, page_count; unknown documents reject."""
    checked = rows.join(page_counts, "doc_id", "left").withColumn(
        "reason", reject_reason(F.coalesce("page_count", F.lit(0)))).drop("page_count")
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def empty_exports(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents without any export row: an error for the export, not an empty copy."""
    return docs.select("doc_id").join(rows.select("doc_id"), "doc_id", "left_anti").withColumn(
        "reason", F.lit("nothing-located"))


def markup_records(rows: DataFrame, mark_prefix: str) -> DataFrame:
    """One PDF markup annotation per export row: bounding box, quad points, colour, opacity, contents."""
    def extreme(pick, field: str) -> Column:
        return pick(F.transform("rects", lambda r: r[field]))

    reading = F.col("layer") == v.LAYER_READING
    quads = F.flatten(F.transform("rects", lambda r: F.array(
        r["x0"], r["y1"], r["x1"], r["y1"], r["x0"], r["y0"], r["x1"], r["y0"])))
    rgb = F
    for row in v.CATEGORY_TABLE:
        rgb = rgb.when(F.col("category") == row[0], F.array(*[F.lit(x) for x in row[6]]))
    return rows.select(
        "doc_id", "ord", "page", F.when(reading, "Underline").otherwise("Highlight").alias("subtype"),
        F.array(extreme(F.array_min, "x0"), extreme(F.array_min, "y0"), extreme(F.array_max, "x1"),
                extreme(F.array_max, "y1")).alias("rect"),
        quads.alias("quad_points"), rgb.alias("color"), F.when(reading, 1.0).otherwise(0.3).alias("opacity"),
        F.concat(F.lit(mark_prefix), category_column(5), F.lit("] AI 分析："), F.coalesce("summary", F.lit("")),
                 F.lit("\n原文："), F.coalesce("quote", F.lit(""))).alias("contents"))


def bookmarks(rows: DataFrame, root_title: str) -> DataFrame:
    """Bookmark tree as rows: doc_id, level, group_ord, ord, title, page, top.

    Level 0 is the root, level 1 the category groups in first-seen order, level 2 the findings. The group order comes
    from one small aggregate per (document, category) joined back, so no window runs over a document's rows.
    """
    firsts = rows.groupBy("doc_id", "category").agg(
        F.min("ord").alias("first_ord"), F.min_by("page", "ord").alias("first_page"))
    # at most five categories per document
    groups = firsts.withColumn("group_ord", F.row_number().over(
        Window.partitionBy("doc_id").orderBy("first_ord")))
    root = groups.where(F.col("group_ord") == 1).select(
        "doc_id", F.lit(0).alias("level"), F.lit(0).alias("group_ord"), F.lit(-1).alias("ord"),
        F.lit(root_title).alias("title"), F.col("first_page").alias("page"), F.lit(None).cast("double").alias("top"))
    heads = groups.select(
        "doc_id", F.lit(1).alias("level"), "group_ord", F.lit(-1).alias("ord"), category_column(5).alias("title"),
        F.col("first_page").alias("page"), F.lit(None).cast("double").alias("top"))
    label = F.coalesce(F.nullif("summary", F.lit("")), F.col("quote"), F.lit(""))
    leaves = rows.join(groups.select("doc_id", "category", "group_ord"), ["doc_id", "category"]).select(
        "doc_id", F.lit(2).alias("level"), "group_ord", "ord",
        F.substring(label, 1, v.BOOKMARK_TITLE_CHARS).alias("title"), "page",
        (F.array_max(F.transform("rects", lambda r: r["y1"])) + v.BOOKMARK_TOP_MARGIN).alias("top"))
    return root.unionByName(heads).unionByName(leaves)


def layer_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "layer").agg(F.count(F.lit(1)).alias("annotations"))
