"""Rare-event splitting: Metropolis chains restricted to failing configurations, and ratios down a ladder of rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chain(seed_config: np.ndarray, fails, q: float, q_next: float, steps: int, r: np.random.Generator) -> tuple[float, float, np.ndarray]:
    """Single-flip Metropolis over failing configurations at rate q.

    Returns ln of the mean of (q_next / q)**w ((1 - q_next) / (1 - q))**(n - w), the mean weight and the last state.
    """
    x, n = seed_config.copy(), len(seed_config)
    odds, up, down = np.log(q / (1 - q)), np.log(q_next / q), np.log((1 - q_next) / (1 - q))
    w, logs, weights = int(x.sum()), np.empty(steps), np.empty(steps)
    for i in range(steps):
        j = r.integers(n)
        move = -odds if x[j] else odds
        if move >= 0 or r.random() < np.exp(move):
            x[j] ^= 1
            if fails(x):
                w += 1 if x[j] else -1
            else:
                x[j] ^= 1
        logs[i], weights[i] = w * up + (n - w) * down, w
    top = logs.max()
    return float(top + np.log(np.exp(logs - top).mean())), float(weights.mean()), x


def rungs(high: float, low: float, columns: float, distance: int, most: int = 200) -> list[float]:
    """Rates of a ladder from high to the first at most low, each a step that one fault's worth of weight bridges.

    The weight at a rate is its mean, ``columns * rate``, or half the distance where that is more.
    """
    out = [high]
    while out[-1] > low and len(out) <= most:
        weight = max(distance / 2, columns * out[-1])
        out.append(out[-1] * 2.0 ** (-1 / np.sqrt(weight)))
    return [float(p) for p in out]


def first_four(x: np.ndarray) -> bool:
    """A failure with a known law, q**4: all of the first four columns."""
    return bool(x[:4].all())


def ladder(spark: SparkSession, n: int, fails, start: np.ndarray, rates: list[float], chains: int, steps: int, seed: int) -> DataFrame:
    """level, q, log_ratio (pooled over chains), weight, log_total: P(rates[level + 1]) / P(rates[0]) in logarithms.

    Each chain walks the whole ladder in one task, carrying its state from rung to rung; chains spread over the cluster.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r, x, out = np.random.default_rng([seed, int(key[0])]), start.copy(), []
        for level, (a, b) in enumerate(zip(rates, rates[1:], strict=False)):
            ratio, weight, x = chain(x, fails, a, b, steps, r)
            out.append((key[0], level, a, ratio, weight))
        return pd.DataFrame(out, columns=["chain", "level", "q", "log_ratio", "weight"])

    rungs = spark.range(chains).groupBy(F.col("id").alias("chain")).applyInPandas(run, "chain long, level int, q double, log_ratio double, weight double")
    return pooled(rungs)


def pooled(rungs: DataFrame) -> DataFrame:
    """Log-mean-exp over chains, then the running sum down the ladder."""
    top = rungs.groupBy("level").agg(F.max("log_ratio").alias("top"))
    each = rungs.join(top, "level").groupBy("level", "q", "top").agg(F.log(F.avg(F.exp(F.col("log_ratio") - F.col("top")))).alias("m"), F.avg("weight").alias("weight"))
    return each.select("level", "q", (F.col("top") + F.col("m")).alias("log_ratio"), "weight").withColumn("log_total", F.sum("log_ratio").over(W.orderBy("level")))


def bennett(forward: DataFrame, backward: DataFrame, rounds: int = 3) -> float:
    """ln of the ratio of two ensembles by the acceptance ratio, from tables of u (energy differences); few iterations."""
    c = 0.0
    for _ in range(rounds):
        a = forward.agg(F.avg(1 / (1 + F.exp(F.col("u") - c)))).first()[0]
        b = backward.agg(F.avg(1 / (1 + F.exp(-(F.col("u") - c))))).first()[0]
        c += float(np.log(b / a)) if a and b else 0.0
    return -c
