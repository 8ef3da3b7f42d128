"""A library of failing configurations: neighbours of decoder settings, strata of a bench, folding in, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def neighbours(settings: DataFrame, moves: DataFrame) -> DataFrame:
    """name, config (map of doubles) and key, factor, plus -> name, key, value, config: each setting with one key moved.

    A moved value is ``value * factor + plus``; what comes out equal, or not above zero, is left out, as are moves of a
    key that the setting lacks. Moves are few and go to every setting. Two moves to one value count once.
    """
    both = settings.join(F.broadcast(moves), F.map_contains_key("config", F.col("key")))
    old = F.element_at("config", F.col("key"))
    moved = both.withColumn("old", old).withColumn("value", F.col("old") * F.col("factor") + F.col("plus")).filter("value > 0 AND value <> old")
    config = F.transform_values("config", lambda k, v: F.when(k == F.col("key"), F.col("value")).otherwise(v))
    return moved.select("name", "key", "value", config.alias("config")).dropDuplicates(["name", "key", "value"])


def strata(specimens: DataFrame, weight: str, identity: str, light: int = 8, each: int = 25, tail: int = 60) -> DataFrame:
    """A bench: ``each`` specimens of every weight up to ``light`` and ``tail`` of all heavier ones, with their stratum's size.

    Which ones is settled by a hash of the identity, so that a bench is the same whenever and wherever it is drawn.
    """
    stratum = F.when(F.col(weight) <= light, F.col(weight).cast("long")).otherwise(F.lit(light + 1).cast("long"))
    marked = specimens.withColumn("stratum", stratum).withColumn("lot", F.md5(F.col(identity).cast("string")))
    sizes = marked.groupBy("stratum").agg(F.count(F.lit(1)).alias("of"))
    drawn = marked.withColumn("place", F.row_number().over(W.partitionBy("stratum").orderBy("lot", identity)))
    drawn = drawn.filter(F.col("place") <= F.when(F.col("stratum") <= light, each).otherwise(tail)).filter(F.col("place") <= max(each, tail))
    return drawn.join(F.broadcast(sizes), "stratum").drop("lot", "place")


def identity(mechs: Column) -> Column:
    """A configuration's name: its mechanisms in order, even multiplicities left to the caller."""
    return F.array_join(F.array_sort(mechs.cast("array<long>")), ",")


def fold(library: DataFrame, found: DataFrame, order: str = "iteration") -> DataFrame:
    """The library with those found specimens that fail and that it lacks; both are mechs, order and further columns.

    ``found`` has ``fails`` as well, the outcome of a check. Of equal specimens the one of the smallest order stays; null
    outcomes count as not failing. ``added`` tells the new ones.
    """
    new = found.filter("fails").drop("fails")
    first = lambda rows: rows.withColumn("name", identity(F.col("mechs"))).groupBy("name").agg(F.min_by(F.struct(*rows.columns), F.struct(order, *(c for c in rows.columns if c not in (order, "mechs")))).alias("s"))
    have = first(library)
    fresh = first(new.select(*library.columns)).join(have.select("name"), "name", "left_anti")
    return have.withColumn("added", F.lit(False)).unionByName(fresh.withColumn("added", F.lit(True))).select("name", "s.*", "added")


def status(library: DataFrame, by: list[str]) -> DataFrame:
    """by, n, w_min, latest iteration of a library."""
    return library.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.size("mechs")).cast("long").alias("w_min"), F.max("iteration").alias("latest"))


def portfolios(answers: DataFrame, combos: DataFrame) -> DataFrame:
    """portfolio, entries, fixes, lightest_failure, ceiling.

    answers: shot, weight, truth, member, valid, score, answer; combos: portfolio, member. A portfolio gives the answer
    of its likeliest valid member, the earlier one on ties, without a valid one its first member's; entries that none of
    its members has seen do not count. Combinations are few and go to every answer: by member, all answers would meet in
    as many tasks as there are members. The ceiling is what at least one member mends. A null answer mends nothing.
    """
    right = F.coalesce(F.col("answer") == F.col("truth"), F.lit(False))
    rank = F.struct("valid", F.when(F.col("valid"), F.col("score")).alias("likely"), (-F.col("member")).alias("first"), "score", "answer")
    seen = answers.join(F.broadcast(combos), "member").groupBy("portfolio", "shot").agg(F.max(F.struct(rank.alias("rank"), right.alias("right"))).alias("best"), F.bool_or(right).alias("can"), F.min("weight").alias("weight"))
    n = lambda c: F.count(F.when(c, 1))
    return seen.groupBy("portfolio").agg(F.count(F.lit(1)).alias("entries"), n(F.col("best.right")).alias("fixes"), F.min(F.when(~F.col("best.right"), F.col("weight"))).alias("lightest_failure"), n(F.col("can")).alias("ceiling"))
