"""Mixing sources to target weights by pivotal dependent rounding.

A source wants each of its documents ``target / size of the source`` times. The whole part of that is taken as it is;
the fraction is rounded for all documents of the source together: two documents' copy probabilities trade word mass
until one of them is 0 or 1, so the expected words of each document stay as they were and the words of the source stay
at its target but for one last document. Partitions trade among their own documents, their residuals among each other.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.llm.common import cut_lineage, n_words

#: Rows that trade in one leaf, and residuals that trade in one inner node of the tree.
LEAF_ROWS, FAN_IN = 4_000, 64
WEIGHTS, MOST_COPIES = (1, 2, 3), 3


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target for each source of ``sizes`` (source, size).

    Sources in order of code points, null last, get the weights in turn. Targets share the sum of all sizes; a target
    above ``most`` times its source stops there and the others share the rest by weight, until none is above. One row
    a source is kept; the window that orders them runs over sources, not over documents.
    """
    # Sources are ranked as binary, which orders by code point; a range exchange would do for very many sources.
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)))
    # Sources stop in the order of limit / weight: with those before it stopped, the level that the others share is
    # (all - their limits) / (weight of the others); a source stops when its own limit lies below its share.
    limit = F.col("source_size") * F.lit(float(most))
    by_ratio = Window.orderBy(limit / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    shared = ranked.withColumn("level", level).withColumn("stops", F.col("level") * F.col("weight") > limit)
    rest = shared.agg(
        F.max(F.struct(F.when(~F.col("stops"), -limit / F.col("weight")).alias("k"), "level")).alias("m"))
    return shared.crossJoin(F.broadcast(rest)).select(  # one row
        "source", F.col("source_size").cast("long").alias("source_size"),
        F.when(F.col("source_size") == 0, 0.0).when(F.col("stops"), limit)
        .otherwise(F.col("weight") * F.coalesce("m.level", F.lit(0.0))).alias("target"))


def _trade(ids: np.ndarray, mass: np.ndarray, share: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Settled shares, and the index of the residual (-1: none) after one row after another has traded."""
    share, held = share.copy(), -1
    for i in range(len(share)):
        if share[i] <= 0.0 or share[i] >= 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b, wa, wb = share[held], share[i], mass[held], mass[i]
        up = min((1.0 - a) * wa, b * wb)     # words that may move from the new row to the held one
        down = min(a * wa, (1.0 - b) * wb)   # and the other way
        if draws[i] * (up + down) < down:    # the chance of a direction is the way that the other one allows
            full_a, full_b, move = (1.0 - a) * wa <= b * wb, (1.0 - a) * wa >= b * wb, up
            na, nb = (1.0 if full_a else a + move / wa), (0.0 if full_b else b - move / wb)
        else:
            full_a, full_b, move = a * wa <= (1.0 - b) * wb, a * wa >= (1.0 - b) * wb, down
            na, nb = (0.0 if full_a else a - move / wa), (1.0 if full_b else b + move / wb)
        share[held], share[i] = na, nb
        left = [k for k in (held, i) if 0.0 < share[k] < 1.0]
        held = left[0] if left else -1
    return share, held


def _round_group(draw_last: bool):
    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["turn", "id", "mass"], kind="stable", na_position="last").reset_index(drop=True)
        draws = group["draw"].to_numpy(dtype=float)
        share, held = _trade(group["id"].to_numpy(), group["mass"].to_numpy(dtype=float), group["share"].to_numpy(dtype=float), draws)
        if draw_last and held >= 0:
            # Nobody is left to trade with: the residual itself is drawn, which keeps its expectation.
            share[held] = 1.0 if (draws[held] * 1009.0) % 1.0 < share[held] else 0.0
        group["share"] = share
        return group
    return rounded


def round_copies(rows: DataFrame, seed: int = 0, cut_last: bool = True) -> DataFrame:
    """Rows of (source, id, mass, share) with every share rounded to 0 or 1, source by source.

    The last residual of a source keeps its fraction if ``cut_last`` (a part of that document meets the target to the
    word), else it is drawn.

    The leaves hold about ``LEAF_ROWS`` rows however many a source has; each gives up one residual at most, and every
    level above puts ``FAN_IN`` residual holders together, so no task meets all rows of a source. Chance comes from
    hashes of the id, and leaves from the id too: reruns and repeated tasks agree. Every level is written to the
    shared folder.
    """
    named = rows.withColumn("hash", F.xxhash64(F.lit(seed), "id", "source"))
    fraction = F.pmod(F.xxhash64("hash", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    named = named.select("source", "id", "mass", "share", F.pmod("hash", F.lit(1 << 40)).alias("turn"), fraction.alias("draw"))
    largest = named.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    groups = max(1, -(-largest // LEAF_ROWS))
    level = named.withColumn("node", F.pmod("turn", F.lit(groups)))
    settled = None
    while True:
        last = groups == 1
        done = cut_lineage(level.groupBy("source", "node").applyInPandas(_round_group(last and not cut_last), level.schema))
        part = done if last else done.where("share <= 0 or share >= 1")
        settled = part if settled is None else settled.union(part)
        if last:
            return settled.select("source", "id", "mass", "share")
        groups = -(-groups // FAN_IN)
        level = done.where("share > 0 and share < 1").withColumn("node", F.pmod("node", F.lit(groups)))


def mix(docs: DataFrame, size: Column | None = None, weights: Sequence[float] = WEIGHTS,
        most: float = MOST_COPIES, seed: int = 0, cut_last: bool = True) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, part, taken for every row of ``docs`` (doc_id, text, source).

    ``taken`` is size times copies plus that of ``part``, which is over 0 for one document of a source at most: it is
    taken in part, so that the source meets its target (not with ``cut_last=False``, which draws whole copies). Rows without words (null, empty or blank text) have size 0 and are taken as the
    whole part of their source's share says. Rows that repeat a doc_id within a source trade as one document; a null id
    is an id and a null source a source of its own. An empty table gives no rows; other columns are ignored.
    """
    sized = cut_lineage(docs.select("doc_id", "source", (n_words(F.col("text")) if size is None else size).alias("size")))
    targets = cut_lineage(source_targets(sized, weights, most))
    # One row a source; the optimizer broadcasts it by its measured size or splits the hot source's side.
    wanted = targets.withColumn("wants", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    asked = sized.join(wanted.withColumnRenamed("source", "of"), same("source", "of")).drop("of")
    units = asked.groupBy("source", F.col("doc_id").alias("id")).agg(
        F.sum("size").cast("double").alias("mass"), F.max(F.col("wants") - F.floor("wants")).alias("share"))
    rounded = round_copies(units.where("mass > 0 and share > 0"), seed, cut_last).select(
        F.col("source").alias("r_source"), F.col("id").alias("r_id"), F.col("share").alias("extra"))
    both = asked.join(rounded, same("doc_id", "r_id") & same("source", "r_source"), "left")
    extra = F.coalesce("extra", F.lit(0.0))
    copies = (F.floor("wants") + F.floor(extra)).cast("long")
    part = extra - F.floor(extra)
    return both.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), part.alias("part"),
                       (copies * F.col("size") + F.round(part * F.col("size")).cast("long")).alias("taken"))


def repeat_rows(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``mixed`` (the output of ``mix`` on them) takes whole copies of their document."""
    often = mixed.groupBy(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source")).agg(F.max("copies").alias("copies"))
    rows = docs.select("doc_id", "source", F.struct("*").alias("row"))  # other columns may have any names
    joined = rows.join(often, F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("source").eqNullSafe(F.col("m_source")))
    return joined.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
