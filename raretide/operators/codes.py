"""Bivariate-bicycle codes as coordinate tables: circulant blocks, parity checks, commutation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def circulant(spark: SparkSession, l: int, m: int, monomials: list[tuple[int, int]]) -> DataFrame:  # noqa: E741
    """row, col of the polynomial's matrix over Z_l x Z_m; equal monomials cancel."""
    shifts = spark.createDataFrame(monomials, "i int, j int")
    cells = spark.range(l * m).select(F.col("id").alias("row")).join(F.broadcast(shifts), F.lit(True))
    x, y = F.expr(f"(row div {m} + i) % {l}"), F.expr(f"(row % {m} + j) % {m}")
    return cells.select("row", (x * m + y).cast("long").alias("col")).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select("row", "col")


def parity_checks(spark: SparkSession, l: int, m: int, a: list[tuple[int, int]], b: list[tuple[int, int]]) -> DataFrame:  # noqa: E741
    """kind (X or Z), row, col of H_X = [A | B] and H_Z = [B' | A']."""
    half, ca, cb = l * m, circulant(spark, l, m, a), circulant(spark, l, m, b)
    turned = lambda t: t.select(F.col("col").alias("row"), F.col("row").alias("col"))
    parts = (("X", ca, 0), ("X", cb, half), ("Z", turned(cb), 0), ("Z", turned(ca), half))
    out = None
    for kind, t, at in parts:
        part = t.select(F.lit(kind).alias("kind"), "row", (F.col("col") + at).alias("col"))
        out = part if out is None else out.unionByName(part)
    return out


def odd_overlaps(checks: DataFrame) -> DataFrame:
    """Pairs of an X and a Z check that share an odd number of qubits; empty for a valid code."""
    x, z = (checks.filter(F.col("kind") == k).select(F.col("row").alias(k), "col") for k in ("X", "Z"))
    return x.join(z, "col").groupBy("X", "Z").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")


def gate_layers(spark: SparkSession, l: int, m: int, a: list[tuple[int, int]], b: list[tuple[int, int]]) -> DataFrame:  # noqa: E741
    """kind, row, layer (1 ..), qubit: a monomial couples every check to a qubit of its own, so each is one layer."""
    half, out = l * m, None
    for layer, (monomial, of_a) in enumerate([(x, True) for x in a] + [(x, False) for x in b], 1):
        one = circulant(spark, l, m, [monomial])
        x = one.select(F.lit("X").alias("kind"), "row", F.lit(layer).cast("long").alias("layer"), (F.col("col") + (0 if of_a else half)).alias("qubit"))
        z = one.select(F.lit("Z").alias("kind"), F.col("col").alias("row"), F.lit(layer).cast("long").alias("layer"), (F.col("row") + (half if of_a else 0)).alias("qubit"))
        out = x.unionByName(z) if out is None else out.unionByName(x).unionByName(z)
    return out
