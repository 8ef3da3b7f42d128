"""Relations over fault mechanisms and configurations: syndromes, parities, multiplicities, merges, enumeration.

A mechanism is a row mech, p, det (detector mask), obs (observable mask); a configuration is the rows (config, mech)
that share a config. Masks are longs; XOR is the aggregate bit_xor, which also cancels repeated mechanisms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raretide.functions.parts import dealt


def syndromes(configs: DataFrame, mechs: DataFrame) -> DataFrame:
    """config, syndrome, truth: one join on the mechanism, then a combinable aggregate."""
    return configs.join(mechs.select("mech", "det", "obs"), "mech").groupBy("config").agg(F.bit_xor("det").alias("syndrome"), F.bit_xor("obs").alias("truth"))


def parity_members(configs: DataFrame) -> DataFrame:
    """config, mech of the mechanisms that occur an odd number of times."""
    return configs.groupBy("config", "mech").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select("config", "mech")


def supports(configs: DataFrame) -> DataFrame:
    """config, w, support: the sorted odd mechanisms; a configuration's own rows are few."""
    return parity_members(configs).groupBy("config").agg(F.count(F.lit(1)).alias("w"), F.array_sort(F.collect_list("mech")).alias("support"))


def multiplicities(mechs: DataFrame, q_base: float | None = None) -> DataFrame:
    """mech, m = max(round half even of p / q_base, 1); q_base is the smallest p by default."""
    base = F.lit(q_base) if q_base else F.col("q")
    rows = mechs if q_base else mechs.join(F.broadcast(mechs.agg(F.min("p").alias("q"))), F.lit(True))
    return rows.select("mech", F.greatest(F.bround(F.col("p") / base), F.lit(1.0)).cast("long").alias("m"))


def sector(mechs: DataFrame, mask: int) -> DataFrame:
    """Columns of the detectors in ``mask``: equal ones merge by the rule of odd parity, invisible ones go."""
    seen = mechs.select(F.col("det").bitwiseAND(F.lit(mask)).alias("det"), "obs", "p").filter("det <> 0 OR obs <> 0")
    flips = F.when(F.max(F.when(F.col("p") == 0.5, 1).otherwise(0)) == 1, 0.0).otherwise(F.exp(F.sum(F.log(F.when(F.col("p") == 0.5, 1.0).otherwise(1 - 2 * F.col("p"))))))
    return seen.groupBy("det", "obs").agg(((1 - flips) / 2).alias("p"), F.count(F.lit(1)).alias("merged"))


def degenerate(mechs: DataFrame) -> DataFrame:
    """Detector signatures with more than one action on the observables."""
    return mechs.groupBy("det").agg(F.countDistinct("obs").alias("actions"), F.count(F.lit(1)).alias("mechs")).filter("actions > 1")


def subsets(members: DataFrame, size: int, parts: int | None = None) -> DataFrame:
    """Distinct ascending ``size``-subsets (c1 < c2 < ...) of each config's members; config itself is dropped.

    With ``parts``, members are shuffled into as many partitions by config, subsets into ``size`` times as many.
    """
    members = dealt(members, parts, "config")
    out = members.select("config", F.col("mech").alias("c1"))
    for i in range(2, size + 1):
        out = out.join(members.select("config", F.col("mech").alias(f"c{i}")), "config").filter(f"c{i} > c{i - 1}")
    return dealt(out.drop("config"), parts and size * parts, *(f"c{i}" for i in range(1, size + 1))).distinct()


#: Pairs of columns that a partition of ``half_pairs`` holds, about.
PAIRS = 1 << 19


def half_pairs(columns: DataFrame) -> DataFrame:
    """Weight-4 undetectable logical sets by meeting in the middle: pairs joined on equal XOR, disjoint, other action.

    All three splits of such a set meet; only that into its lower and its upper pair is joined, so that a set comes once
    and none is shuffled. Nor are pairs where masks have few values, 64 times as many as there are columns at most: the
    values of an XOR are dealt instead, and each is joined with the columns and with those that make it up to the value.
    A mechanism is one row; repeated rows count once.
    """
    columns = columns.select("mech", F.col("det").cast("long").alias("det"), "obs").distinct()
    n, low, high = columns.agg(F.count(F.lit(1)), F.min("det"), F.max("det")).first()
    a, b = (columns.select(F.col("mech").alias(x), F.col("det").alias(f"d{x}"), F.col("obs").alias(f"o{x}")) for x in ("i", "j"))
    tasks = max(64, 16 * columns.sparkSession.sparkContext.defaultParallelism)
    if n and low is not None and low >= 0 and 1 << high.bit_length() <= 64 * n:
        sums = columns.sparkSession.range(1 << high.bit_length()).select(F.col("id").alias("s")).repartition(max(tasks, n * n // 2 // PAIRS), "s")
        both = sums.join(F.broadcast(a), F.lit(True)).withColumn("dj", F.col("s").bitwiseXOR(F.col("di"))).join(F.broadcast(b), "dj").filter("i < j")
    else:
        both = a.repartition(tasks, "i").join(b, F.col("i") < F.col("j")).withColumn("s", F.col("di").bitwiseXOR(F.col("dj")))
    pairs = both.select("i", "j", "s", F.col("oi").bitwiseXOR(F.col("oj")).alias("act"))
    other = pairs.select(F.col("i").alias("k"), F.col("j").alias("l"), "s", F.col("act").alias("act2"))
    met = pairs.join(other.hint("merge"), "s").filter("act <> act2 AND j < k")
    return met.select(F.array("i", "j", "k", "l").alias("members"))


def class_votes(classes: DataFrame) -> DataFrame:
    """syndrome, truth, rho -> syndrome, fails = sum - max: all but the heaviest class are lost, ties too."""
    by_class = classes.groupBy("syndrome", "truth").agg(F.sum("rho").alias("rho"))
    return by_class.groupBy("syndrome").agg((F.sum("rho") - F.max("rho")).alias("fails"))


def lookup(synd: DataFrame) -> DataFrame:
    """The most frequent truth of each syndrome (ties: the smallest): every distinct syndrome is decoded once."""
    n = synd.groupBy("syndrome", "truth").agg(F.count(F.lit(1)).alias("n"))
    best = W.partitionBy("syndrome").orderBy(F.col("n").desc(), "truth")
    return n.withColumn("nth", F.row_number().over(best)).filter("nth = 1").select("syndrome", F.col("truth").alias("guess"))


def shared_checks(incidence: DataFrame, parts: int | None = None) -> DataFrame:
    """vertex, check -> a < b with the number of checks they share.

    With ``parts``, incidence is shuffled into as many partitions by check, pairs into twice as many.
    """
    rows = dealt(incidence.select("vertex", "check"), parts, "check").distinct()
    pairs = rows.select(F.col("vertex").alias("a"), "check").join(rows.select(F.col("vertex").alias("b"), "check"), "check").filter("a < b")
    return dealt(pairs.select("a", "b"), parts and 2 * parts, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def adjacency(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """vertex, degree, neighbours (sorted). With ``parts``, ends of edges are shuffled into as many partitions by vertex."""
    both = edges.select(F.col("a").alias("vertex"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("vertex"), F.col("a").alias("to")))
    return dealt(both, parts, "vertex").groupBy("vertex").agg(F.count(F.lit(1)).alias("degree"), F.array_sort(F.collect_set("to")).alias("neighbours"))
