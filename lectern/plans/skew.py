"""Joins and lineage for keys that may hold a large share of all rows."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A key is hot when it holds more than this share of the rows, so at most 1 / HOT_SHARE keys can be hot: the hot-key
# table is bounded whatever the data looks like and may be broadcast.
HOT_SHARE = 1 / 1000


def hot_keys(facts: DataFrame, keys: list[str], share: float = HOT_SHARE, min_rows: int = 10_000, stored: bool = False) -> DataFrame:
    """Keys holding more than ``share`` of the rows (and ``min_rows``), with the number of slots to spread them over.

    ``stored``: for facts that are costly to compute and few to a key; their counts are stored, so they are computed once here.
    """
    counts = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    counts = cut_lineage(counts) if stored else counts
    # the total is added up from the counts: from the facts it would compute them again
    limit = counts.agg(F.greatest(F.coalesce(F.sum("_rows"), F.lit(0)) * share, F.lit(float(min_rows))).alias("_limit")).scalar()
    return (
        counts.where(F.col("_rows") > limit)
        .select(*keys, F.ceil(F.col("_rows") / limit).cast("int").alias("_slots"))
    )


def spread_join(
    facts: DataFrame,
    dims: DataFrame,
    keys: list[str],
    spread_by: Column,
    how: str = "inner",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi join of many ``facts`` to few ``dims`` rows per key that stays balanced when keys are hot.

    Facts of a hot key get one of ``_slots`` slots by hash of ``spread_by``; the dims rows of that key are copied once
    per slot, every other key keeps its single slot. Small dims are still broadcast when the optimizer's size check
    allows it; then the slots cost nothing. ``how`` is ``inner`` or ``left``. ``hot`` is the output of ``hot_keys``;
    pass one counted on a cheap source when ``facts`` are costly to compute, since counting reads them again.
    """
    hot = F.broadcast(hot_keys(facts, keys) if hot is None else hot)
    salted = (
        facts.join(hot, keys, "left")
        .withColumn("_slot", F.when(F.col("_slots").isNull(), F.lit(0))
                    .otherwise(F.pmod(F.xxhash64(spread_by), F.col("_slots").cast("long"))).cast("int"))
        .drop("_slots")
    )
    copied = (
        dims.join(hot, keys, "left")
        .withColumn("_slot", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slots"), F.lit(1)) - 1)))
        .drop("_slots")
    )
    return salted.join(copied, [*keys, "_slot"], how).drop("_slot")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Only in local mode, where driver and executors are one process, an unset folder is replaced by a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder, so a lost executor does not repeat the work before it.

    Unlike a row checkpoint the table is columnar: later reads take only their columns, and its measured size lets the
    optimizer choose broadcasts.
    """
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
