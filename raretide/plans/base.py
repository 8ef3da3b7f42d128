"""Roles that the driver tables play, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N = 2000
RATES = (1e-4, 5e-4, 1e-3, 5e-3, 2e-2)
ROUNDS = 12


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in RATES], "p double")


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """w, fail, run, channel of each sampled shot."""
    line = read(spark, sf_dir, "lineitem")
    return line.select(F.col("l_quantity").cast("int").alias("w"), (F.col("l_returnflag") == "R").alias("fail"), F.col("l_linestatus").alias("run"), F.col("l_linenumber").alias("channel"), ((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.09) & (F.col("l_tax") > 0.07)).alias("rare"))


def mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mech, p, det (8-bit detector mask), obs (4-bit observable mask)."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("mech"), (F.col("p_size") / 1000.0).alias("p"), F.pmod(F.col("p_partkey") * 2654435761, F.lit(256)).alias("det"), F.pmod(F.col("p_size"), F.lit(16)).cast("long").alias("obs"), "p_brand", "p_type", "p_size")


def configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("config"), F.col("l_partkey").alias("mech"))


SHOTS = "shots AS (SELECT CAST(l_quantity AS INTEGER) AS w, l_returnflag = 'R' AS fail, l_linestatus AS run, l_linenumber AS channel, l_returnflag = 'R' AND l_discount > 0.09 AND l_tax > 0.07 AS rare FROM lineitem)"
SPEC = f"{SHOTS}, spec AS (SELECT w, count(*) AS t, count(*) FILTER (fail) AS f FROM shots GROUP BY w)"
GRID = "grid(p) AS (VALUES " + ", ".join(f"(CAST({p} AS DOUBLE))" for p in RATES) + ")"
MECH = "mech AS (SELECT p_partkey AS mech, p_size / 1000.0::DOUBLE AS p, (p_partkey * 2654435761) % 256 AS det, CAST(p_size % 16 AS BIGINT) AS obs, p_brand, p_type, p_size FROM part)"
CONF = "conf AS (SELECT l_orderkey AS config, l_partkey AS mech FROM lineitem)"
LOG_C = f"(lgamma({N + 1}) - lgamma(w + 1) - lgamma({N} - w + 1))"
B = f"exp({LOG_C} + w * ln(p) + ({N} - w) * ln(1 - p))"
RATE = "(CASE WHEN t = 0 THEN 0 ELSE f / t END)"
LER = f"sum({RATE} * {B})"
SE = f"sqrt(sum(CASE WHEN t = 0 THEN 0 ELSE {RATE} * (1 - {RATE}) / t * {B} * {B} END))"
HEAD = f"sum(CASE WHEN f = 0 AND t > 0 THEN least(3, t) / t * {B} ELSE 0 END)"


def filled(name: str, out: str, by: str = "", only: str = "> 1") -> str:
    keys, over = (f"{by}, ", f"PARTITION BY {by} ORDER BY w") if by else ("", "ORDER BY w")
    return f"""{out}_ahead AS (SELECT {keys}w, t, f, lead(w) OVER o AS w2, lead(t) OVER o AS t2, lead(f) OVER o AS f2 FROM {name} WINDOW o AS ({over})),
        {out} AS (SELECT {keys}w, t, f FROM {name} UNION ALL
                  SELECT {keys}unnest(range(w + 1, w2)) AS w, t + t2, f + f2 FROM {out}_ahead WHERE w2 - w {only})"""


EPS = f"(1 - pow(1 - least(greatest(ler, 0), 1 - 1e-12), 1.0::DOUBLE / {ROUNDS}))"
EPS_SE = f"(pow(1 - least(greatest(ler, 0), 1 - 1e-12), 1.0::DOUBLE / {ROUNDS} - 1) / {ROUNDS} * ler_se)"
EPS_HEAD = f"(1 - pow(1 - least(greatest(ler + headroom, 0), 1 - 1e-12), 1.0::DOUBLE / {ROUNDS}) - {EPS})"
