"""Connected components by alternating large and small stars, on links that are never collected."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour (or to the node itself)."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .where("a <> b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(least.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each end of ``links`` (a, b); ``component`` is the least id that links reach.

    Ids may be of any ordered type. Links to oneself, repeated links, both directions and links with a null end are
    allowed (the last are left out). The number of rounds grows with the logarithm of the longest chain; each round
    writes its links to the shared folder, so a lost executor repeats one round at most. At the end every link points
    from a node to the least node of its component.
    """
    links = links.select("a", "b").where("a <> b").distinct()
    rounds = cut_lineage(links)
    seen = None
    while True:
        state = rounds.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 31)).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
        rounds = cut_lineage(_small_star(_large_star(rounds)))
    stars = rounds.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
