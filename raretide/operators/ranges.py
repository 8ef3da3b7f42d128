"""Joins on ranges and merges that keep their sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def range_join(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Each point with the ranges low <= at < high that hold it, all columns of both.

    The line is cut into cells of ``width``: a range stands in each cell that it meets and a point in one, so that an
    equi-join on cells, with the bounds as its rest, does it; neither side is broadcast unless Spark finds it small, and
    a crowded cell can be split. ``width`` near the usual length of a range gives each range a cell or two. Nulls and empty
    ranges meet nothing.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    spans = ranges.filter(F.col(low) < F.col(high)).withColumn("cell", F.explode(F.sequence(cell(low), cell(high))))
    return points.withColumn("cell", cell(at)).join(spans, "cell").filter((F.col(low) <= F.col(at)) & (F.col(at) < F.col(high))).drop("cell")


def prefix_ranges(mechs: DataFrame, key: str, size: str, block: int = 1024) -> DataFrame:
    """key (whole numbers), size -> key, low, high: ranges of these sizes laid end to end in the order of keys, from 0.

    A running sum in two steps: within blocks of keys, and over one row for each block.
    """
    rows = mechs.withColumn("block", F.floor(F.col(key) / block))
    blocks = rows.groupBy("block").agg(F.sum(size).alias("s"))
    blocks = blocks.select("block", (F.sum("s").over(W.orderBy("block")) - F.col("s")).alias("base"))
    inner = F.sum(size).over(W.partitionBy("block").orderBy(key))
    both = rows.withColumn("inner", inner).join(blocks, "block")
    return both.select(key, (F.col("base") + F.col("inner") - F.col(size)).alias("low"), (F.col("base") + F.col("inner")).alias("high"))


def odd_parity(p: Column) -> Column:
    """The probability that an odd number of independent events happens, as an aggregate. A half decides it; nulls count for nothing."""
    half = F.max(F.when(p == 0.5, 1).otherwise(0)) == 1
    # above a half the factor is negative: magnitudes are summed as logarithms, signs counted
    size = F.exp(F.sum(F.log(F.when(p == 0.5, 1.0).otherwise(F.abs(1 - 2 * p)))))
    sign = F.when(F.sum(F.when(p > 0.5, 1).otherwise(0)) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(half, 0.5).otherwise((1 - sign * size) / 2)


def merged_with_sources(rows: DataFrame, by: Sequence[str], order: str, p: str, k: int) -> DataFrame:
    """by, p (odd parity of the merged), merged (how many), sources: of each merged row its ``k`` first sources by ``order``.

    Sources are taken by rank within the key; Spark keeps at most ``k`` rows of a key in every task before the shuffle, so
    that a key of a third of all rows costs no more than another. Of equal orders one source is listed for each.
    """
    totals = rows.groupBy(*by).agg(odd_parity(F.col(p)).alias("p"), F.count(F.lit(1)).alias("merged"))
    first = rows.select(*by, order).withColumn("nth", F.row_number().over(W.partitionBy(*by).orderBy(order))).filter(F.col("nth") <= k)
    named = first.groupBy(*by).agg(F.array_sort(F.collect_list(order)).alias("sources"))
    same = None
    for c in by:
        equal = totals[c].eqNullSafe(named[c])
        same = equal if same is None else same & equal
    return totals.join(named, same).select(*(totals[c] for c in by), "p", "merged", "sources")
