"""Stored highlights: ownership, idempotent insert, clearing, statistics.

Stored rows: ``doc_id, type, color, sort_index, page_index, rects, text, comment, page_label, tags``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern import values as v
from lectern.config import JobConfig

PLACE_KEY = ["doc_id", "text", "color", "page_index", "rects"]


def category_column(field: int) -> Column:
    """Value of the category table for the ``category`` column; null for unknown categories."""
    out = F
    for row in v.CATEGORY_TABLE:
        out = out.when(F.col("category") == row[0], F.lit(row[field]))
    return out


def owned(cfg: JobConfig, tags: Column, comment: Column) -> Column:
    """Ours only with both the tag and the comment prefix."""
    return F.coalesce(F.array_contains(tags, cfg.owner_tag) & comment.startswith(cfg.mark_prefix), F.lit(False))


def as_annotations(located: DataFrame, cfg: JobConfig) -> DataFrame:
    """Annotation rows for located findings, with ``ord`` kept for tie breaking."""
    comment = F.concat(F.lit(cfg.mark_prefix), category_column(4), F.lit(" "), category_column(2), F.lit("] "),
                       F.coalesce("summary", F.lit("")))
    return located.select(
        "doc_id", "ord", F.lit("highlight").alias("type"), category_column(1).alias("color"), "sort_index",
        "page_index", "rects", F.col("quote").alias("text"), comment.alias("comment"),
        (F.col("page_index") + 1).cast("string").alias("page_label"), F.array(F.lit(cfg.owner_tag)).alias("tags"))


def new_annotations(located: DataFrame, stored: DataFrame, cfg: JobConfig) -> DataFrame:
    """Rows to append: one per (document, text, colour, place), none that we already own. Edited comments do not matter.

    The in-batch duplicates fall to a grouped minimum, which combines before the shuffle.
    """
    rows = as_annotations(located, cfg)
    rest = [c for c in rows.columns if c not in PLACE_KEY]
    first = rows.groupBy(*PLACE_KEY).agg(F.min_by(F.struct(*rest), "ord").alias("r")).select(*PLACE_KEY, "r.*")
    ours = stored.where(owned(cfg, F.col("tags"), F.col("comment"))).select(*PLACE_KEY).distinct()
    return first.join(ours, PLACE_KEY, "left_anti").drop("ord").select(
        *[c for c in rows.columns if c != "ord"])


def clear_owned(stored: DataFrame, cfg: JobConfig) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, number removed per document); manual annotations stay."""
    ours = owned(cfg, F.col("tags"), F.col("comment"))
    removed = stored.groupBy("doc_id").agg(F.count_if(ours).alias("removed"))
    return stored.where(~ours), removed


def annotation_stats(findings: DataFrame, located: DataFrame, created: DataFrame,
                     failures: DataFrame | None = None) -> DataFrame:
    """Per document: created, existing, skipped, failed and the failure messages.

    ``findings``: all findings with a quote. ``located``: the verified ones that were located. ``created``: output of
    ``new_annotations`` that was offered to the sink. ``failures``: doc_id, message of rows the sink refused.
    """
    asked = findings.where(F.coalesce(F.col("quote"), F.lit("")) != "").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("asked"))
    placed = located.groupBy("doc_id").agg(F.count(F.lit(1)).alias("placed"))
    made = created.groupBy("doc_id").agg(F.count(F.lit(1)).alias("made"))
    out = asked.join(placed, "doc_id", "left").join(made, "doc_id", "left")
    if failures is None:
        out = out.withColumn("failed", F.lit(0).cast("long")).withColumn("errors", F.array().cast("array<string>"))
    else:
        # every message is kept; a document has as many as it has refused rows
        refused = failures.groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("failed"), F.array_sort(F.collect_list("message")).alias("errors"))
        out = out.join(refused, "doc_id", "left").fillna({"failed": 0}).withColumn(
            "errors", F.coalesce("errors", F.array().cast("array<string>")))
    out = out.fillna({"placed": 0, "made": 0})
    return out.select(
        "doc_id", (F.col("made") - F.col("failed")).alias("created"), (F.col("placed") - F.col("made")).alias("existing"),
        (F.col("asked") - F.col("placed")).alias("skipped"), "failed", "errors")


def note_place() -> Column:
    """Boxes of a guide note: one at the corner of the first page."""
    return F.array(F.struct(*[F.lit(float(n)).alias(c) for c, n in zip(("x0", "y0", "x1", "y1"), v.NOTE_BOX, strict=True)]))


def new_guide_notes(guides: DataFrame, stored: DataFrame, cfg: JobConfig) -> DataFrame:
    """Guide notes (doc_id, comment) not yet stored under our tag with the same comment."""
    ours = stored.where(F.array_contains("tags", cfg.owner_tag)).select("doc_id", "comment")
    return guides.distinct().join(ours, ["doc_id", "comment"], "left_anti").select(
        "doc_id", F.lit("note").alias("type"), F.lit(v.CATEGORY_TABLE[0][1]).alias("color"),
        F.lit("00000|000000|00000").alias("sort_index"), F.lit(0).alias("page_index"), note_place().alias("rects"), "comment", F.lit("1").alias("page_label"),
        F.array(F.lit(cfg.owner_tag)).alias("tags"))
