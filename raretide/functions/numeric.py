"""Numeric column functions that Spark lacks: log-factorials, binomial weights, guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rates are clipped to this range before their logarithms are taken (fixed values).
Q_MIN, Q_MAX = 1e-300, 1 - 1e-15


def log_factorials(spark: SparkSession, n: int) -> DataFrame:
    """k, ln k! for k = 0 .. n: a dimension table of n + 1 rows by a running sum."""
    rows = spark.range(n + 1).select(F.col("id").alias("k"), F.log(F.greatest(F.col("id"), F.lit(1)).cast("double")).alias("ln"))
    return rows.select("k", F.sum("ln").over(W.orderBy("k")).alias("lf"))


def log_choose(bins: DataFrame, n: int, w: str = "w") -> DataFrame:
    """bins with log_c = ln C(n, w). The factorial table has n + 1 rows, so it is broadcast up to a million."""
    table = log_factorials(bins.sparkSession, n)
    hint = F.broadcast if n <= 1_000_000 else (lambda t: t)
    low, high = table.select(F.col("k").alias("k1"), F.col("lf").alias("lf1")), table.select(F.col("k").alias("k2"), F.col("lf").alias("lf2"))
    whole = table.filter(F.col("k") == n).select(F.col("lf").alias("lfn"))
    joined = bins.join(hint(low), F.col(w).cast("long") == F.col("k1")).join(hint(high), n - F.col(w).cast("long") == F.col("k2")).join(F.broadcast(whole), F.lit(True))
    return joined.withColumn("log_c", F.col("lfn") - F.col("lf1") - F.col("lf2")).drop("k1", "k2", "lf1", "lf2", "lfn")


def clipped(q: Column) -> Column:
    return F.least(F.greatest(q, F.lit(Q_MIN)), F.lit(Q_MAX))


def binomial_weight(log_c: Column, w: Column, n: int, q: Column) -> Column:
    """C(n, w) q**w (1 - q)**(n - w), in logarithms."""
    return F.exp(log_c + w * F.log(q) + (n - w) * F.log(1 - q))


def rate(f: Column, t: Column) -> Column:
    """f / t, and 0 without trials."""
    return F.when(t == 0, F.lit(0.0)).otherwise(f / t)


def per_round(ler: Column, rounds: int) -> Column:
    """1 - (1 - L)**(1 / rounds), L clipped to [0, 1)."""
    return 1 - F.pow(1 - F.least(F.greatest(ler, F.lit(0.0)), F.lit(1 - 1e-12)), F.lit(1.0 / rounds))

