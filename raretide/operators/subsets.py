"""Subsets of sorted sets by rank: unranked in column expressions, packed into binary keys, sampled without listing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raretide.functions.parts import dealt

#: Members of the largest set: its subsets of any size are counted by a long.
LARGEST = 62
#: Ranks that one row is expanded into at a time.
RANKS = 4096
#: Sets whose subsets are looked at before all are.
SOME = 1024


def _binomials(k: int) -> Column:
    """C(m, j) for m up to LARGEST and j up to k, at place m * (k + 1) + j."""
    return F.array(*(F.lit(math.comb(m, j)).cast("long") for m in range(LARGEST + 1) for j in range(k + 1)))


def _once(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def choices(n: Column, k: int) -> Column:
    """C(n, k) as a long. Sets of more than LARGEST members end the query."""
    n = F.when(n > LARGEST, F.raise_error(F.lit(f"a set has more than {LARGEST} members"))).otherwise(n)
    return F.get(_binomials(k), (n * (k + 1) + k).cast("int"))


def unranked(members: Column, rank: Column, k: int) -> Column:
    """The subset of k members with this rank (from 0) in lexicographic order of places."""
    table, n = _binomials(k), F.size(members)

    def step(s: Column, j: Column) -> Column:
        holding = F.when(s["left"] > 0, F.get(table, ((n - 1 - j) * (k + 1) + s["left"] - 1).cast("int"))).otherwise(F.lit(0).cast("long"))
        take = (s["left"] > 0) & (s["rank"] < holding)
        return F.struct(
            F.when(take, s["rank"]).otherwise(s["rank"] - holding).alias("rank"),
            F.when(take, s["left"] - 1).otherwise(s["left"]).alias("left"),
            F.when(take, F.concat(s["places"], F.array(j))).otherwise(s["places"]).alias("places"),
        )

    start = F.struct(rank.cast("long").alias("rank"), F.lit(k).alias("left"), F.array().cast("array<int>").alias("places"))
    places = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["places"])
    return F.transform(places, lambda j: F.get(members, j))


def packed(subset: Column, k: int, bits: int = 14) -> Column:
    """k numbers below 2 ** bits as one binary key: as many as fit into each seven bytes, first ones highest."""
    per = 56 // bits
    field = lambda i: F.get(subset, F.lit(i))
    groups = []
    for g in range(0, k, per):
        value = F.lit(0).cast("long")
        for i in range(per):
            value = F.shiftleft(value, bits).bitwiseOR(field(g + i).cast("long") if g + i < k else F.lit(0).cast("long"))
        groups.append(F.lpad(F.hex(value), 14, "0"))
    wide = F.exists(subset, lambda x: (x < 0) | (x >= 1 << bits))
    return F.when(wide, F.raise_error(F.lit(f"a member does not fit into {bits} bits"))).otherwise(F.unhex(F.concat(*groups)))


def unpacked(key: Column, k: int, bits: int = 14) -> Column:
    """The numbers of a packed key."""
    per = 56 // bits
    group = lambda g: F.conv(F.hex(F.substring(key, 7 * g + 1, 7)), 16, 10).cast("long")
    return F.array(*(F.shiftright(group(i // per), bits * (per - 1 - i % per)).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(k)))


def _all(members: Column, k: int, chosen: tuple[Column, ...] = (), after: Column | None = None) -> Column:
    """All subsets of k members in the order of their ranks, as arrays: each one is the one before it but for its end."""
    rest = members if after is None else F.slice(members, after + 1, F.size(members))
    if k == 1:
        return F.transform(rest, lambda x: F.array(*chosen, x))
    start = F.lit(0) if after is None else after
    return F.flatten(F.transform(rest, lambda x, i: _all(members, k - 1, (*chosen, x), start + i + 1)))


def listed(sets: DataFrame, k: int, parts: int | None = None) -> DataFrame:
    """members (ascending) -> subset: each subset of k members of each row. Smaller sets have none.

    Ranks are dealt out in blocks, so that the subsets of one large set are made by many tasks; a set of one block has its
    subsets made in their order, without unranking each.
    """
    total = choices(F.size("members"), k)
    blocks = sets.filter(F.size("members") >= k).select("members", F.explode(F.sequence(F.lit(0).cast("long"), total - 1, F.lit(RANKS).cast("long"))).alias("first"))
    # a number of its own, since rows that are small here grow a thousandfold
    blocks = blocks.repartition(parts or int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "first", "members")
    total = choices(F.size("members"), k)
    ranks = F.sequence("first", F.least(F.col("first") + RANKS, total) - 1)
    made = F.when(total <= RANKS, _all(F.col("members"), k)).otherwise(F.transform(ranks, lambda r: unranked(F.col("members"), r, k)))
    return blocks.select(F.explode(made).alias("subset"))


def restrictions(sets: DataFrame, k: int, bits: int = 14) -> DataFrame:
    """members (ascending) -> key: each subset of k members of each row, packed. Smaller sets have none."""
    return listed(sets, k).select(packed(F.col("subset"), k, bits).alias("key"))


def _beyond(keys: DataFrame, budget: int) -> bool:
    """Whether more than ``budget`` rows differ among the first few of ``keys``: then more do among all."""
    return budget < 1 << 20 and keys.limit(2 * budget + SOME).distinct().count() > budget


def count_restrictions(sets: DataFrame, k: int, budget: int, error: float = 0.01, parts: int | None = None) -> DataFrame:
    """One row: k, subsets (sum of C(n, k)), restrictions, exact. Distinct subsets of k members over all sets, if they are few.

    Unless the subsets are within the budget anyway, some sets are looked at first: where their subsets alone exceed it, all do.
    Else a sketch with relative standard error ``error`` tells about how many differ. Up to ``budget`` they are counted
    exactly; beyond, no subset is shuffled and ``restrictions`` is the number of subsets, an upper bound, with exact false.
    With ``parts``, sets are shuffled into as many partitions, subsets into ``k`` times as many.
    """
    totals = sets.filter(F.size("members") >= k).agg(F.coalesce(F.sum(choices(F.size("members"), k).cast("decimal(38,0)")), F.lit(0)).cast("double").alias("subsets"))
    members = [f"c{i}" for i in range(k)]
    keys, some = (listed(t, k, parts).select(*(F.get("subset", F.lit(i)).alias(c) for i, c in enumerate(members))) for t in (sets, sets.filter(F.size("members") >= k).limit(SOME)))
    exact = totals.first()["subsets"] <= budget or not (_beyond(some, budget) or keys.agg(F.approx_count_distinct(F.struct(*members), error)).first()[0] > budget)
    if exact:
        totals = totals.crossJoin(dealt(keys, parts and k * parts, *members).distinct().agg(F.count(F.lit(1)).cast("double").alias("restrictions")))  # one row each
    else:
        totals = totals.withColumn("restrictions", F.col("subsets"))
    return totals.select(F.lit(k).alias("k"), "subsets", "restrictions", F.lit(bool(exact)).alias("exact"))


def _shuffled(place: Column, total: Column, name: Column, rounds: int = 4) -> Column:
    """A permutation of 0 .. total - 1 that the name settles: Feistel rounds over a grid of about equal sides, walked until inside.

    At most one side's length of the grid lies outside, so few steps are taken, and 64 that fail end the query.
    """
    a = F.greatest(F.ceil(F.sqrt(total.cast("double"))).cast("long"), F.lit(1).cast("long"))
    b = F.floor((total + a - 1) / a).cast("long")

    def mixed(r: Column, half: Column) -> Column:
        digest = F.md5(F.concat_ws(":", name, r.cast("string"), half.cast("string")).cast("binary"))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(F.when(even, (s["l"] + mixed(r, s["r"])) % a).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise((s["r"] + mixed(r, s["l"])) % b).alias("r"))

    def once(x: Column) -> Column:
        start = F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda s: s["l"] + a * s["r"])

    walk = lambda start: F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, lambda x, _: F.when(x < total, x).otherwise(once(x)))
    walked = _once(once(place), lambda x: F.when(x < total, x).otherwise(walk(x)))
    return _once(walked, lambda x: F.when(x < total, x).otherwise(F.raise_error(F.lit("no rank inside after 64 steps")).cast("long")))


def capped_subsets(sets: DataFrame, sizes: Sequence[int], cap: int, seed: int = 0) -> DataFrame:
    """set, members (ascending) -> set, k, rank, subset: for each set and size, min(cap, C(n, k)) different subsets.

    Which ones is settled by seed, set and size: the first ``cap`` places of a permutation of the ranks that is computed
    and never listed. Where the cap is not below C(n, k) these are all subsets. Sets with fewer members than k have none.
    """
    out = None
    for k in sizes:
        rows = sets.filter(F.size("members") >= k).select("set", "members", choices(F.size("members"), k).alias("total"))
        rows = rows.select("set", "members", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(cap).cast("long"), F.col("total")) - 1)).alias("place"))
        name = F.concat_ws(":", F.lit(str(seed)), F.col("set").cast("string"), F.lit(str(k)))
        drawn = _once(_shuffled(F.col("place"), F.col("total"), name), lambda r: F.struct(r.alias("rank"), unranked(F.col("members"), r, k).alias("subset")))  # noqa: B023
        rows = rows.select("set", F.lit(k).alias("k"), drawn.alias("drawn")).select("set", "k", "drawn.*")
        out = rows if out is None else out.unionByName(rows)
    return out
