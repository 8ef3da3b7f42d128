"""Splitting over a failure predicate that judges many configurations at once, such as a batch decoder.

Configurations are rows of 0 and 1 over expanded columns; ``fails(rows)`` says which of them fail. All walkers of a task
advance together, one batch to a step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raretide.functions.relay import Decoder
from raretide.operators.montecarlo import Model

Fails = Callable[[np.ndarray], np.ndarray]


class DecoderFails:
    """Whether a decoder's answer differs from what a configuration does."""

    def __init__(self, model: Model, decoder: Decoder):
        columns, _ = model.expanded()
        self.model, self.decoder = model, decoder.setup(model.h, model.p, model.observables)
        self.spread = np.zeros((len(columns), len(model.p)), np.float32)
        self.spread[np.arange(len(columns)), columns] = 1

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        events, flips = self.model.outcomes((rows.astype(np.float32) @ self.spread % 2).astype(np.uint8))
        return (self.decoder.decode(events) != flips).any(1)


def advance(x: np.ndarray, q: np.ndarray, steps: int, fails: Fails, r: np.random.Generator, balanced: bool = True) -> np.ndarray:
    """Metropolis steps of every walker at its own rate q, kept among failing configurations; returns the weights seen.

    A balanced step removes one of the set columns or adds one of the others with equal chance, and is weighed by how
    likely its return is; a plain one flips any column.
    """
    n, walkers = x.shape[1], np.arange(len(x))
    odds, seen = np.log(q / (1 - q)), np.empty((steps, len(x)), np.int64)
    for step in range(steps):
        w = x.sum(1)
        if balanced:
            add = r.random(len(x)) < 0.5
            add = np.where(w == 0, True, np.where(w == n, False, add))
            keys = r.random(x.shape)
            j = np.where(add[:, None] == (x == 0), keys, -1).argmax(1)
            there = np.where((w == 0) | (w == n), 1.0, 0.5) / np.where(add, n - w, np.maximum(w, 1))
            after = np.where(add, w + 1, w - 1)
            back = np.where((after == 0) | (after == n), 1.0, 0.5) / np.where(add, after, n - after)
            log_accept = np.where(add, odds, -odds) + np.log(back / there)
        else:
            j = r.integers(n, size=len(x))
            log_accept = np.where(x[walkers, j] == 0, odds, -odds)
        tried = np.flatnonzero(np.log(r.random(len(x))) < log_accept)
        if len(tried):
            moved = x[tried].copy()
            moved[np.arange(len(tried)), j[tried]] ^= 1
            good = fails(moved)
            x[tried[good]] = moved[good]
        seen[step] = x.sum(1)
    return seen


def log_ratios(weights: np.ndarray, n: int, q: float, q_next: float) -> np.ndarray:
    """ln of the likelihood ratio of configurations of these weights between two rates."""
    return weights * np.log(q_next / q) + (n - weights) * np.log((1 - q_next) / (1 - q))


def acceptance_ratio(w_a: np.ndarray, w_b: np.ndarray, n: int, q_a: float, q_b: float, rounds: int = 20) -> float:
    """ln P(b) / P(a) of two failing ensembles by Bennett's acceptance ratio, from samples of both."""
    forward, backward = log_ratios(w_a, n, q_a, q_b), log_ratios(w_b, n, q_b, q_a)
    c = 0.0
    for _ in range(rounds):
        top = np.mean(1 / (1 + np.exp(np.clip(c - forward, -700, 700))))
        bottom = np.mean(1 / (1 + np.exp(np.clip(-c - backward, -700, 700))))
        step = np.log(top / bottom) if top > 0 and bottom > 0 else 0.0
        c += float(step)
        if abs(step) < 1e-10:
            break
    return c


def multi_seeded(spark: SparkSession, n: int, fails: Fails, seeds: np.ndarray, rates: list[float], instances: int, steps: int, seed: int, most: int | None = None, tolerance: float = 0.1) -> DataFrame:
    """level, q, log_ratio, spread, log_total, steps: independent ladders, each level grown until its halves agree.

    Every instance carries its walkers (one for each seed) down the ladder; a level's chain doubles until the ratio of
    all its steps and of the first half differ by at most ``tolerance``, or ``most`` steps are taken. Ratios are
    Bennett's, of neighbouring levels; spread is that of the instances.
    """
    most = most or 8 * steps
    shared = spark.sparkContext.broadcast((fails, np.asarray(seeds, np.uint8)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fails, start = shared.value
        r, x, levels = np.random.default_rng([seed, int(key[0])]), start.copy(), []
        for k, q in enumerate(rates):
            rate, seen = np.full(len(x), q), np.zeros((0, len(x)), np.int64)
            other = rates[k + 1] if k + 1 < len(rates) else rates[k - 1]
            advance(x, rate, steps // 4, fails, r)
            while True:
                seen = np.vstack([seen, advance(x, rate, max(steps, len(seen)), fails, r)])
                g = np.exp(log_ratios(seen, n, q, other) - log_ratios(seen, n, q, other).max())
                if len(seen) >= most or abs(g.mean() / g[: len(g) // 2].mean() - 1) <= tolerance:
                    break
            levels.append(seen)
        out = [(key[0], k, a, acceptance_ratio(levels[k].ravel(), levels[k + 1].ravel(), n, a, b), len(levels[k])) for k, (a, b) in enumerate(zip(rates, rates[1:], strict=False))]
        return pd.DataFrame(out, columns=["instance", "level", "q", "log_ratio", "steps"])

    ladders = spark.range(instances).groupBy(F.col("id").alias("instance")).applyInPandas(run, "instance long, level int, q double, log_ratio double, steps long")
    return _over_instances(ladders)


def _over_instances(ladders: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    each = ladders.groupBy("level", "q").agg(F.avg("log_ratio").alias("log_ratio"), F.stddev_samp("log_ratio").alias("spread"), F.sum("steps").alias("steps"))
    return each.withColumn("log_total", F.sum("log_ratio").over(W.orderBy("level")))  # as many rows as rungs


def replica_exchange(spark: SparkSession, n: int, fails: Fails, start: np.ndarray, rates: list[float], walkers: int, sweeps: int, local: int, seed: int) -> DataFrame:
    """level, q, log_ratio, spread, swaps, lightest, log_total: tempering with swaps between neighbouring rungs.

    A walker is a whole ladder in one task, one replica to a rung; after ``local`` steps neighbours swap with the
    chance min(1, ratio of likelihoods). swaps is the part accepted, lightest the least weight that was seen failing.
    """
    shared = spark.sparkContext.broadcast((fails, np.asarray(start, np.uint8)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fails, first = shared.value
        r, x = np.random.default_rng([seed, int(key[0])]), np.repeat(first[None], len(rates), axis=0)
        q, kept, swapped = np.array(rates), [], np.zeros((2, len(rates)))
        odds = np.log(q / (1 - q))
        for sweep in range(sweeps):
            seen = advance(x, q, local, fails, r)
            if sweep >= sweeps // 4:
                kept.append(seen)
            for k in range(sweep % 2, len(rates) - 1, 2):
                w = x[[k, k + 1]].sum(1).astype(int)
                swapped[0, k] += 1
                if np.log(r.random()) < (odds[k] - odds[k + 1]) * (w[1] - w[0]):
                    x[[k, k + 1]] = x[[k + 1, k]]
                    swapped[1, k] += 1
        w = np.concatenate(kept)
        out = [(key[0], k, a, acceptance_ratio(w[:, k], w[:, k + 1], n, a, b), swapped[1, k] / max(1, swapped[0, k]), int(w[:, k].min())) for k, (a, b) in enumerate(zip(rates, rates[1:], strict=False))]
        return pd.DataFrame(out, columns=["instance", "level", "q", "log_ratio", "swaps", "lightest"])

    ladders = spark.range(walkers).groupBy(F.col("id").alias("instance")).applyInPandas(run, "instance long, level int, q double, log_ratio double, swaps double, lightest long")
    extra = ladders.groupBy("level").agg(F.avg("swaps").alias("swaps"), F.min("lightest").alias("lightest"))
    return _over_instances(ladders.withColumn("steps", F.lit(sweeps * local).cast("long"))).join(extra, "level")


def strip(x: np.ndarray, fails: Fails, r: np.random.Generator, passes: int = 64) -> np.ndarray:
    """Each failing configuration made lighter, column by column, as long as it fails; candidates of all in one batch."""
    x = x.copy()
    for _ in range(passes):
        owner, column = np.nonzero(x)
        if not len(owner):
            break
        tried = x[owner]
        tried[np.arange(len(owner)), column] = 0
        good = np.flatnonzero(fails(tried))
        if not len(good):
            break
        good = r.permutation(good)
        _, pick = np.unique(owner[good], return_index=True)
        chosen = good[pick]
        x[owner[chosen]] = tried[chosen]
    return x
