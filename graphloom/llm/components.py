"""Connected components by alternating large-star and small-star rounds.

Links never leave the cluster.  A round is two grouped minima (combined on the map side) and two equi-joins
whose skewed side, the links of a hub, adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import cut


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, move to the least of those neighbours."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links (a, b)`` of one comparable type -> ``(node, component)``, component being the least node reachable.

    Nodes without links, null ends and self-links give no row; repeated links count once.
    """
    links = cut(links.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    mark = None
    for _ in range(max_rounds):
        links = cut(_small_star(_large_star(links)))
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
