"""Sampling of fault configurations and their decoding, spread over the cluster by shots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raretide.functions.decoders import BpOsd

#: Shots of a block.
BLOCK = 2048


def _blocks(plan: DataFrame) -> DataFrame:
    """plan (w, shots) -> w, start, n: blocks of at most ``BLOCK`` shots of one weight; weight 0 has none."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shots") - 1, F.lit(BLOCK).cast("long")))
    return plan.filter("w > 0 AND shots > 0").select("w", "shots", starts.alias("start")).select("w", "start", F.least(F.col("shots") - F.col("start"), F.lit(BLOCK)).alias("n"))


def _drawn(seed: int, w: int, start: int, shots: int, n: int) -> Iterator[np.ndarray]:
    """The columns of a block's shots, w different ones of n a row, in parts of bounded size: those of the w least keys.

    Keys come from a generator seeded by (seed, w, block) row by row, so that any task draws the same shots.
    """
    r, part = np.random.default_rng([seed, w, start // BLOCK]), max(1, (1 << 22) // n)
    for i in range(0, shots, part):
        yield np.argpartition(r.random((min(part, shots - i), n)), w - 1, axis=1)[:, :w]


def shots_of_weight(spark: SparkSession, plan: DataFrame, n: int, seed: int) -> DataFrame:
    """plan (w, shots) -> w, shot, column: each shot draws w different columns; weight 0 draws none."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for w, start, shots in zip(b.w, b.start, b.n, strict=True):
                first = int(start)
                for picked in _drawn(seed, int(w), int(start), int(shots), n):
                    yield pd.DataFrame({"w": np.full(picked.size, w), "shot": np.repeat(np.arange(first, first + len(picked)), w), "column": np.sort(picked, axis=1).ravel()})
                    first += len(picked)

    return _blocks(plan).mapInPandas(draw, f"w {plan.schema['w'].dataType.simpleString()}, shot long, column long")


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of bits, and which of them each row is."""
    wide = np.zeros((len(rows), -(-max(rows.shape[1], 1) // 64) * 64), np.uint8)
    wide[:, : rows.shape[1]] = rows
    keys = np.packbits(wide, axis=1).view(np.uint64)
    _, first, of = np.unique(keys[:, 0], return_index=True, return_inverse=True) if keys.shape[1] == 1 else np.unique(keys, axis=0, return_index=True, return_inverse=True)
    return rows[first], of.reshape(-1)


def spectrum_of_weights(spark: SparkSession, plan: DataFrame, h: np.ndarray, priors: np.ndarray, logical: np.ndarray, seed: int, **how) -> DataFrame:
    """plan (w, shots) -> w, t, f: the shots of ``shots_of_weight``, and those whose correction leaves a flipped logical.

    Blocks of one weight's shots are dealt over the cluster; a block is drawn, each of its distinct syndromes decoded
    once, and only its counts leave the task. Shots are never rows.
    """
    shared = spark.sparkContext.broadcast((BpOsd(h, priors, **how), np.asarray(h, np.float32), np.asarray(logical, np.float32)))  # the code's own size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder, h, logical = shared.value
        for b in batches:
            rows = []
            for w, start, shots in zip(b.w, b.start, b.n, strict=True):
                for picked in _drawn(seed, int(w), int(start), int(shots), h.shape[1]):
                    faults = np.zeros((len(picked), h.shape[1]), np.uint8)
                    np.put_along_axis(faults, picked, 1, axis=1)
                    once, of = _distinct((faults @ h.T % 2).astype(np.uint8))
                    left = faults ^ decoder.many(once)[of]
                    rows.append((int(w), len(picked), int((left @ logical.T % 2).any(1).sum())))
            yield pd.DataFrame(rows, columns=["w", "t", "f"])

    blocks = _blocks(plan)
    tasks = max(64, 16 * spark.sparkContext.defaultParallelism)
    done = blocks.repartition(tasks).mapInPandas(run, "w long, t long, f long")
    return done.groupBy("w").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))


def bernoulli_shots(spark: SparkSession, shots: int, n: int, q: float, seed: int) -> DataFrame:
    """shot, column: every column fails with probability q; a binomial count, then that many different columns."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shot in b.shot:
                r = np.random.default_rng([seed, int(shot)])
                picked = r.choice(n, r.binomial(n, q), replace=False)
                yield pd.DataFrame({"shot": np.full(len(picked), shot), "column": np.sort(picked)})

    return spark.range(shots).select(F.col("id").alias("shot")).mapInPandas(draw, "shot long, column long")


def syndromes_of(faults: DataFrame, checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, syndrome: the sorted checks (row, col) that an odd number of a shot's columns touches."""
    hit = faults.join(checks, faults["column"] == checks["col"]).groupBy(*keys, "row").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
    odd = hit.groupBy(*keys).agg(F.array_sort(F.collect_list("row")).alias("syndrome"))
    return faults.select(*keys).distinct().join(odd, keys, "left").withColumn("syndrome", F.coalesce("syndrome", F.array().cast("array<long>")))


def decode_distinct(syndromes: DataFrame, h: np.ndarray, priors: np.ndarray, **how) -> DataFrame:
    """syndrome, correction (sorted columns): every distinct syndrome is decoded once, by a deterministic decoder."""
    decoder = syndromes.sparkSession.sparkContext.broadcast(BpOsd(h, priors, **how))  # the code's own size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.zeros((len(b), h.shape[0]), np.uint8)
            for i, s in enumerate(b.syndrome):
                x[i, np.asarray(s, int)] = 1
            yield pd.DataFrame({"syndrome": b.syndrome, "correction": [np.flatnonzero(c).tolist() for c in decoder.value.many(x)]})

    return syndromes.select("syndrome").distinct().mapInPandas(run, "syndrome array<long>, correction array<long>")


def failures(faults: DataFrame, corrected: DataFrame, logical: DataFrame, keys: list[str]) -> DataFrame:
    """keys, failed: whether fault and correction together flip a logical (k, col), after joining corrections back."""
    both = faults.select(*keys, "column").unionByName(corrected.select(*keys, F.explode("correction").alias("column")))
    left = both.groupBy(*keys, "column").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
    flips = left.join(logical, left["column"] == logical["col"]).groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select(*keys).distinct().withColumn("failed", F.lit(True))
    return corrected.select(*keys).join(flips, keys, "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
