"""Readers of study artifacts: spectrum checkpoints, run folders, progress logs, and compact number lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a spectrum checkpoint; others in the file are dropped by the schema.
SPECTRUM = "n_expanded long, q_base double, p_ref double, shots_per_weight long, trials_by_weight map<string,long>, seed long, weights_plan array<long>, failures_by_weight map<string,long>"
DISTANCE = "distance long, distance_is_bound boolean, onset long, n_compressed long, n_expanded long, onset_fraction double"


def _run(df: DataFrame) -> DataFrame:
    return df.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def spectra(spark: SparkSession, pattern: str) -> DataFrame:
    """run, n_expanded, q_base, p_ref, place, w, t, f of checkpoints: planned weights that are done, in plan order.

    Trials fall back to shots_per_weight where the file predates trials by weight.
    """
    files = _run(spark.read.schema(SPECTRUM).option("multiLine", True).json(pattern))
    bins = files.select("run", "n_expanded", "q_base", "p_ref", "shots_per_weight", "trials_by_weight", "failures_by_weight", F.posexplode("weights_plan").alias("place", "w"))
    key = F.col("w").cast("string")
    done = bins.withColumn("f", F.element_at("failures_by_weight", key)).filter("f IS NOT NULL")
    return done.select("run", "n_expanded", "q_base", "p_ref", "place", "w", F.coalesce(F.element_at("trials_by_weight", key), "shots_per_weight").alias("t"), "f")


def progress(spark: SparkSession, pattern: str) -> DataFrame:
    """run, planned, done, fraction of each checkpoint; valid in the middle of a run."""
    files = _run(spark.read.schema(SPECTRUM).option("multiLine", True).json(pattern))
    done = F.size(F.map_keys("failures_by_weight"))
    return files.select("run", F.size("weights_plan").alias("planned"), done.alias("done"), (done / F.size("weights_plan")).alias("fraction"))


def distances(spark: SparkSession, pattern: str) -> DataFrame:
    return _run(spark.read.schema(DISTANCE).option("multiLine", True).json(pattern))


def progress_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """trial, found of lines such as ``trial 12/4095: 7 found``; other lines are passed over."""
    found = lines.select(F.regexp_extract(column, r"trial\s+(\d+)", 1).alias("trial"), F.regexp_extract(column, r"(\d+)\s+found", 1).alias("found"))
    return found.filter("trial <> '' AND found <> ''").select(F.col("trial").cast("long").alias("trial"), F.col("found").cast("long").alias("found"))


def number_list(text: Column) -> Column:
    """``2-5,9`` or ``3..10`` -> sorted distinct numbers."""
    parts = F.split(F.regexp_replace(F.regexp_replace(text, r"\s", ""), r"\.\.", "-"), ",")
    spans = F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.sequence(F.element_at(F.split(x, "-"), 1).cast("long"), F.element_at(F.split(x, "-"), -1).cast("long")))
    return F.array_sort(F.array_distinct(F.flatten(spans)))


def budgets(spec: DataFrame, column: str) -> DataFrame:
    """``1-3:100,2:500`` -> w, t; the later of two entries for a weight wins."""
    entries = spec.select(F.posexplode(F.split(F.regexp_replace(column, r"\s", ""), ",")).alias("place", "e")).select("place", F.split("e", ":").alias("e"))
    rows = entries.select("place", F.explode(number_list(F.col("e")[0])).alias("w"), F.col("e")[1].cast("long").alias("t"))
    return rows.groupBy("w").agg(F.max_by("t", "place").alias("t"))


def log_grid(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """n rates from low to high, even in logarithms."""
    step = f"{low} * pow({high} / {low}, id / {max(1, n - 1)})"
    return spark.range(n).select(F.expr(step).cast("double").alias("p"))
