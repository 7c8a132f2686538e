"""Connected components of a link table, by alternating large-star and small-star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import materialise


def _step(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b) with a > b. large: every larger neighbour of a node is linked to its smallest neighbour (or itself);
    small: every smaller neighbour and the node itself are."""
    if large:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if large:  # a table of its own, so that a node with very many links can be split in the join
        least = materialise(least, "least")
    near = both.join(least, "a")
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link. The links may come in any direction and
    more than once; a node linked only to itself, or to null, is not listed. Links never leave the executors.

    Each round halves the depth of the trees at least; it ends when every node is linked to its component and nothing else.
    """
    x, y = F.col(a), F.col(b)
    now = materialise(links.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "links")
    for _ in range(rounds):
        twice = now.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a")
        inner = now.select(F.col("b").alias("a")).distinct().join(now, "a", "left_semi")
        if twice.unionByName(inner).isEmpty():
            break
        now = materialise(_step(_step(now, True), False), "links")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
