"""Shift symmetries of a bivariate-bicycle code as tables: permutations, automorphism tests, orbits, gate layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _moved(q: Column, l: int, m: int) -> Column:  # noqa: E741
    """The image of a qubit or check under the shift (a, b), within its half of l * m."""
    half = l * m
    r = F.pmod(q, F.lit(half))
    x, y = (F.floor(r / m) + F.col("a")) % l, (r % m + F.col("b")) % m
    return ((q - r) + x * m + y).cast("long")


def shifts(spark: SparkSession, l: int, m: int) -> DataFrame:  # noqa: E741
    return spark.range(l * m).select(F.floor(F.col("id") / m).alias("a"), (F.col("id") % m).alias("b"))


def qubit_permutations(spark: SparkSession, l: int, m: int) -> DataFrame:  # noqa: E741
    """a, b, q, image for every shift and qubit."""
    qubits = spark.range(2 * l * m).select(F.col("id").alias("q"))
    return shifts(spark, l, m).join(qubits, F.lit(True)).select("a", "b", "q", _moved(F.col("q"), l, m).alias("image"))


def broken(checks: DataFrame, l: int, m: int) -> DataFrame:  # noqa: E741
    """a, b, entries of the check matrix whose image is none: empty where the shift is an automorphism."""
    spark = checks.sparkSession
    images = shifts(spark, l, m).join(checks, F.lit(True)).select("a", "b", "kind", _moved(F.col("row"), l, m).alias("row"), _moved(F.col("col"), l, m).alias("col"))
    return images.join(checks, ["kind", "row", "col"], "left_anti")


def orbits(pairs: DataFrame, l: int, m: int) -> DataFrame:  # noqa: E741
    """x, y (x < y) -> the smallest image of the pair under all shifts: its orbit's representative."""
    spark = pairs.sparkSession
    images = pairs.join(F.broadcast(shifts(spark, l, m)), F.lit(True)).select("x", "y", _moved(F.col("x"), l, m).alias("i"), _moved(F.col("y"), l, m).alias("j"))
    return images.groupBy("x", "y").agg(F.min(F.struct(F.least("i", "j").alias("rx"), F.greatest("i", "j").alias("ry"))).alias("r")).select("x", "y", "r.rx", "r.ry")
