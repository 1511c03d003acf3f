"""Choosing what to analyse: source attachment, selection de-duplication, pending work."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern import values as v
from lectern.config import JobConfig


def usable(cfg: JobConfig) -> Column:
    """An attachment that is a PDF, not deleted and not one of our exports."""
    exported = F.coalesce(F.array_contains("tags", cfg.export_tag), F.lit(False))
    return F.coalesce(F.col("content_type"), F.lit("")).rlike("(?i)pdf") & ~F.coalesce("deleted", F.lit(False)) & ~exported


def first_sources(attachments: DataFrame, cfg: JobConfig) -> DataFrame:
    """parent_id -> attachment_id of its first usable attachment. Grouped minimum: combines before the shuffle."""
    return attachments.where(F.col("parent_id").isNotNull() & usable(cfg)).groupBy("parent_id").agg(
        F.min_by("attachment_id", F.struct("ord", "attachment_id")).alias("attachment_id"))


def pick_sources(items: DataFrame, attachments: DataFrame, cfg: JobConfig) -> DataFrame:
    """item_id -> attachment_id for selected items; items without a source are absent.

    ``items``: item_id, the id of a regular item or of an attachment. A usable attachment is its own source (its
    deleted flag does not matter when named directly); one of our exports stands for its parent.
    """
    exported = F.coalesce(F.array_contains("tags", cfg.export_tag), F.lit(False))
    direct = attachments.select(
        F.col("attachment_id").alias("item_id"), "parent_id", exported.alias("exported"),
        F.coalesce(F.col("content_type"), F.lit("")).rlike("(?i)pdf").alias("pdf"))
    looked = items.join(direct, "item_id", "left")
    is_attachment = F.col("exported").isNotNull()
    itself = looked.where(is_attachment & ~F.col("exported") & F.col("pdf")).select(
        "item_id", F.col("item_id").alias("attachment_id"))
    via = looked.where(~is_attachment | F.col("exported")).select(
        "item_id", F.when(is_attachment, F.col("parent_id")).otherwise(F.col("item_id")).alias("parent_id"))
    # the item side is as large as the selection; the source side has one row per parent
    return itself.unionByName(via.join(first_sources(attachments, cfg), "parent_id").select("item_id", "attachment_id"))


def items_with_source(items: DataFrame, attachments: DataFrame, cfg: JobConfig) -> DataFrame:
    return items.join(pick_sources(items, attachments, cfg), "item_id", "left_semi")


def unique_selection(selection: DataFrame) -> DataFrame:
    """One row per parent item, in order of first appearance, with the last selected row's payload.

    ``selection``: ord, item_id, parent_id.
    """
    target = F.coalesce("parent_id", "item_id")
    return selection.groupBy(target.alias("target_id")).agg(
        F.min("ord").alias("ord"), F.max_by("item_id", "ord").alias("selected_id"))


def cache_key(cfg: JobConfig, model: Column | None = None, language: Column | None = None) -> Column:
    """Result key from item_key, file_path, file_size, modified_ms, item_version."""
    suffix = [F.lit(cfg.model) if model is None else model, F.lit(cfg.language) if language is None else language,
              F.lit(f"p{v.PROMPT_VERSION}")]
    with_file = F.concat_ws(":", F.lit(v.KEY_VERSION), "item_key", F.col("file_size").cast("string"),
                            F.col("modified_ms").cast("string"), *suffix)
    without = F.concat_ws(":", F.lit(v.KEY_VERSION), "item_key",
                          F.concat(F.lit("v"), F.col("item_version").cast("string")), *suffix)
    return F.when(F.col("file_path").isNotNull(), with_file).otherwise(without)


def pending(items: DataFrame, store: DataFrame, force: bool = False) -> DataFrame:
    """Items (with ``cache_key``) whose result is not stored, or all of them when forced."""
    return items if force else items.join(store.select("cache_key"), "cache_key", "left_anti")


def with_cached(items: DataFrame, store: DataFrame) -> DataFrame:
    """Items with their stored result, null where there is none."""
    return items.join(store.select("cache_key", "result"), "cache_key", "left")
