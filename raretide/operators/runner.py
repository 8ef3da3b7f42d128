"""Study runs: fingerprints of configurations, which tasks must run, clones of configurations, sweeps that resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(config: Column) -> Column:
    """SHA-256 of a map's entries in the order of their keys: the order in which a file has them does not count."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(config))), 256)


def status(requests: DataFrame, stored: DataFrame, forced: str | None = None) -> DataFrame:
    """task, config and task, config -> task, status: cached, forced (a cached task with that prefix), stale or missing."""
    have = stored.select("task", fingerprint(F.col("config")).alias("had"))
    both = requests.select("task", fingerprint(F.col("config")).alias("wants")).join(have, "task", "left")
    again = F.col("task").startswith(forced) if forced else F.lit(False)
    same = F.when(again, "forced").otherwise("cached")
    return both.select("task", F.when(F.col("had").isNull(), "missing").when(F.col("had") != F.col("wants"), "stale").otherwise(same).alias("status"))


def clones(parents: DataFrame, variants: DataFrame, dropped: list[str]) -> DataFrame:
    """name, config and variant, changes -> name (``parent__variant``), config: each parent without the dropped keys, changed.

    Changes win over what the parent has; ``label`` becomes the clone's name. Variants are few and go to every parent.
    """
    both = parents.join(F.broadcast(variants), F.lit(True)).withColumn("clone", F.concat_ws("__", "name", "variant"))
    changes = F.map_concat(F.map_filter("changes", lambda k, v: k != "label"), F.create_map(F.lit("label"), F.col("clone")))
    own = F.map_filter("config", lambda k, v: ~k.isin(dropped) & ~F.map_contains_key(changes, k))
    return both.select(F.col("clone").alias("name"), F.map_concat(own, changes).alias("config"))


def resumed_sweep(spark: SparkSession, folder: str, config: dict[str, str], weights: DataFrame, sample: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """w, t, f of every planned weight: bins that the folder has are read, the others sampled and appended to it.

    ``weights`` is w; ``sample`` takes those still to do and gives w, t, f. Each bin carries the configuration's fingerprint;
    bins of another one raise ValueError, so that two plans are never mixed. A row is a whole bin: after an interrupted
    append a weight is either done or sampled by the next call.
    """
    own = spark.range(1).select(fingerprint(F.create_map(*(F.lit(x) for kv in sorted(config.items()) for x in kv)))).first()[0]
    try:
        bins = spark.read.schema("w long, t long, f long, plan string").parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        bins = None
    todo = weights.select(F.col("w").cast("long").alias("w")).distinct()
    if bins is not None:
        if not bins.filter(F.col("plan") != own).isEmpty():
            raise ValueError(f"{folder} holds bins of another configuration")
        todo = todo.join(bins.select("w"), "w", "left_anti")
    if bins is None or not todo.isEmpty():
        done = sample(todo).select(*(F.col(c).cast("long").alias(c) for c in ("w", "t", "f")), F.lit(own).alias("plan"))
        done.write.mode("append").parquet(folder)
    return spark.read.parquet(folder).join(weights.select(F.col("w").cast("long").alias("w")).distinct(), "w", "left_semi").select("w", "t", "f")
