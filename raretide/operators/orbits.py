"""Orbits of bit vectors under linear maps, and permutations of columns that translations of their detectors induce."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raretide.functions.lineage import cut


def image(mask: Column, columns: Sequence[int]) -> Column:
    """The image of a vector under the linear map that takes bit i to the vector columns[i]; higher bits go to nothing."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        out = out.bitwiseXOR(F.shiftright(mask, i).bitwiseAND(F.lit(1).cast("long")) * c)
    return out


def permutation(places: Sequence[int]) -> list[int]:
    """The linear map that moves bit i to places[i]."""
    return [1 << p for p in places]


def closure(vectors: DataFrame, maps: Sequence[Sequence[int]]) -> DataFrame:
    """mask -> mask: the vectors and all their images under products of the maps, each once. Nulls are passed over.

    Each round takes the images of what the round before has added, so that no image is worked out twice.
    """
    known = fresh = cut(vectors.select(F.col("mask").cast("long").alias("mask")).dropna().distinct())
    while True:
        images = fresh.select(F.explode(F.array(*(image(F.col("mask"), m) for m in maps))).alias("mask")).distinct()
        fresh = cut(images.join(known, "mask", "left_anti"))
        if fresh.isEmpty():
            return known
        known = cut(known.unionByName(fresh))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node; a, b -> node, root: the smallest node that links reach, in either direction.

    Roots point at roots: a round hooks the root of each node to the least grandparent among its neighbours and then
    jumps, so that paths halve and rounds are logarithmic. Each step is an aggregate and a join; no neighbourhood is
    gathered in one row. Links whose ends are no nodes are left out.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    now = cut(nodes.select("node", F.col("node").alias("root")).distinct())
    mark = lambda t: tuple(t.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "root"))).first())
    before = mark(now)
    while True:
        parent = now.select(F.col("node").alias("of"), F.col("root").alias("up"))
        lifted = now.join(parent, F.col("root") == F.col("of")).select("node", "root", "up")
        heard = both.join(lifted.select(F.col("node").alias("b"), "up"), "b").groupBy("a").agg(F.min("up").alias("least"))
        met = lifted.join(heard, F.col("node") == F.col("a"), "left").select("node", "root", "up", F.least("up", "least").alias("least"))
        hooks = met.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("hook"))
        new = met.join(hooks, F.col("node") == F.col("of"), "left").select("node", F.least("root", "least", "hook").alias("root"))
        now = cut(new)
        after = mark(now)
        if after == before:
            return now
        before = after


def orbits(vectors: DataFrame, maps: Sequence[Sequence[int]]) -> DataFrame:
    """mask -> mask, representative (the orbit's smallest vector), size (vectors of the orbit), present (those given).

    Maps are invertible; images that the table lacks belong to the orbit all the same. One row for each distinct mask.
    """
    given = vectors.select(F.col("mask").cast("long").alias("mask")).dropna().distinct()
    every = closure(given, maps)
    links = every.select(F.col("mask").alias("a"), F.explode(F.array(*(image(F.col("mask"), m) for m in maps))).alias("b"))
    rooted = components(every.select(F.col("mask").alias("node")), links)
    member = rooted.join(given.select(F.col("mask").alias("node"), F.lit(1).alias("own")), "node", "left")
    sizes = member.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.count("own").alias("present"))
    return member.filter("own = 1").join(sizes, "root").select(F.col("node").alias("mask"), F.col("root").alias("representative"), "size", "present")


def _signature(dets: Column) -> list[Column]:
    """An order-free name of a set: two independent sums of its members' hashes, and the members in order."""

    def total(seed: int) -> Column:  # of 48 bits of each hash: no set of a column's size overflows
        return F.aggregate(dets, F.lit(0).cast("long"), lambda a, d: a + F.shiftrightunsigned(F.xxhash64(d, F.lit(seed)), 16))

    return [total(1).alias("sum1"), total(2).alias("sum2"), F.array_sort(dets).alias("members")]


def column_permutations(columns: DataFrame, moves: DataFrame) -> DataFrame:
    """col, dets (a set) and shift, det, image -> shift, col, image: the column whose detectors are the moved ones, for all shifts.

    One join on signatures serves all shifts. Two columns with equal detectors end the query, and so does a column
    whose moved set is no column's, or a detector that a shift does not move: such shifts are no symmetries.
    """
    named = columns.select("col", *_signature(F.col("dets")))
    held = named.groupBy("sum1", "sum2", "members").agg(F.min("col").alias("image"), F.count(F.lit(1)).alias("n"))
    held = held.withColumn("image", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("columns with equal detectors: "), F.col("image").cast("string"), F.lit(" and others")))).otherwise(F.col("image")))
    flips = columns.select("col", F.explode("dets").alias("det"))
    moved = flips.join(moves, "det").groupBy("shift", "col").agg(F.collect_list("image").alias("dets"))
    asked = moved.join(columns.select("col", F.size("dets").alias("of")), "col").select("shift", "col", F.when(F.size("dets") == F.col("of"), F.col("dets")).otherwise(F.raise_error(F.lit("a detector without an image")).cast(moved.schema["dets"].dataType)).alias("dets"))
    met = asked.select("shift", "col", *_signature(F.col("dets"))).join(held.drop("n"), ["sum1", "sum2", "members"], "left")
    why = F.concat(F.lit("shift "), F.col("shift").cast("string"), F.lit(" takes column "), F.col("col").cast("string"), F.lit(" to no column"))
    return met.select("shift", "col", F.when(F.col("image").isNull(), F.raise_error(why).cast(columns.schema["col"].dataType)).otherwise(F.col("image")).alias("image"))
