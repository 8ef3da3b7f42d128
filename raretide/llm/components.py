"""Connected components of a link table by alternating star contractions, wholly in DataFrame joins.

Each round replaces every node's neighbours by links to the smallest node it sees: first for larger neighbours, then
for smaller ones. Hubs are met by a partial aggregate and a skew-splittable join, never by collecting a neighbourhood.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raretide.llm.workspace import Workspace


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b")


def _small_star(links: DataFrame) -> DataFrame:
    """links have a < b; every b points at its smallest a, and its other neighbours do as well."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).filter("a < b").distinct()


def connected_components(links: DataFrame, work: Workspace) -> DataFrame:
    """links: a, b (any order, repeats and loops allowed, nulls ignored). Returns node, component: the smallest node reachable.

    Nodes without a link to another node are absent. An empty table gives an empty result.
    """
    now = work.table(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")

    def mark(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    before = mark(now)
    while before[0]:
        after = work.table(_small_star(_large_star(now)), "stars")
        work.drop(now)
        now, seen = after, mark(after)
        if seen == before:
            break
        before = seen
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
