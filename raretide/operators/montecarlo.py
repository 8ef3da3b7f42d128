"""Monte Carlo over fault mechanisms: direct sampling, sweeps, weight-stratified and adaptive sampling.

Shots are dealt over the cluster in blocks; a block is drawn by a generator seeded by (seed, block), decoded as one
batch and handed back as counts, so that a task that is computed anew gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raretide.functions.intervals import clopper_pearson, jeffreys
from raretide.functions.relay import Decoder
from raretide.operators import memory

#: Shots of a block, and blocks that a task decodes together.
BLOCK, TOGETHER = 512, 64


@dataclass(frozen=True)
class Model:
    """Fault mechanisms as matrices: detectors x N, observables x N, and their probabilities."""

    h: np.ndarray
    observables: np.ndarray
    p: np.ndarray

    @classmethod
    def of(cls, spark: SparkSession, circuit: memory.Circuit, channels: set[str] | None = None, kind: int | None = None) -> Model:
        """The circuit's mechanisms; kind: only the detectors of one type of check (0: Z, 1: X), merged."""
        rows = sorted(memory.mechanisms(spark, circuit, channels).collect(), key=lambda r: (r.dets, r.obs))  # as many as the circuit has
        wanted = {d: i for i, d in enumerate(d for d, k in enumerate(circuit.kinds) if kind is None or k == kind)}
        merged: dict[tuple, float] = {}
        for r in rows:
            key = tuple(wanted[d] for d in r.dets if d in wanted), tuple(r.obs)
            if key != ((), ()):
                merged[key] = merged.get(key, 0.0) * (1 - r.p) + r.p * (1 - merged.get(key, 0.0))
        h, o = np.zeros((len(wanted), len(merged)), np.uint8), np.zeros((len(circuit.observables), len(merged)), np.uint8)
        for j, (dets, obs) in enumerate(merged):
            h[list(dets), j] = 1
            o[list(obs), j] = 1
        return cls(h, o, np.array(list(merged.values())))

    def outcomes(self, faults: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Detection events and observable flips of rows of faults."""
        f = faults.astype(np.float32)
        return (f @ self.h.T.astype(np.float32) % 2).astype(np.uint8), (f @ self.observables.T.astype(np.float32) % 2).astype(np.uint8)

    def expanded(self, q: float | None = None) -> tuple[np.ndarray, float]:
        """The mechanism of each expanded column, of which a mechanism has round(p / q) (half to even), one at least."""
        q = float(self.p.min()) if q is None else q
        return np.repeat(np.arange(len(self.p)), np.maximum(1, np.rint(self.p / q)).astype(int)), q


def _draw(model: Model, w: int | None, columns: np.ndarray, r: np.random.Generator, n: int, scale: float) -> np.ndarray:
    """n rows of faults: each mechanism by its own probability, or w different expanded columns, equal ones cancelling."""
    if w is None:
        return (r.random((n, len(model.p))) < model.p * scale).astype(np.uint8)
    faults = np.zeros((n, len(model.p)), np.uint8)
    for i in range(n):
        np.add.at(faults[i], columns[r.choice(len(columns), w, replace=False)], 1)
    return faults & 1


def count_failures(spark: SparkSession, model: Model, decoder: Decoder, plan: Iterable[tuple[int | None, int]], seed: int, scale: float = 1.0, keep: int = 0) -> DataFrame:
    """plan of (w or None, shots) -> w, t, f, failing: shots, failures, and of each block its first ``keep`` failing fault sets."""
    ready = decoder.setup(model.h, model.p, model.observables) if decoder.h is None else decoder
    columns, _ = model.expanded()
    shared = spark.sparkContext.broadcast((model, ready, columns))  # the circuit's own size
    blocks = [(w, k, min(BLOCK, shots - k * BLOCK)) for w, shots in plan for k in range(-(-shots // BLOCK))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, ready, columns = shared.value
        for b in batches:
            rows = []
            for i in range(0, len(b), TOGETHER):  # equal events of these blocks are decoded once
                drawn = []
                for w, k, n in b.iloc[i : i + TOGETHER][["w", "block", "n"]].itertuples(index=False):
                    w = None if pd.isna(w) else int(w)
                    faults = _draw(model, w, columns, np.random.default_rng([seed, 0 if w is None else w + 1, int(k)]), int(n), scale)
                    drawn.append((w, int(n), np.packbits(faults, axis=1) if keep else None, *model.outcomes(faults)))
                answers = ready.decode(np.concatenate([events for *_, events, _ in drawn]))
                for w, n, packed, _, flips in drawn:
                    bad = np.flatnonzero((answers[:n] != flips).any(1))
                    answers = answers[n:]
                    rows.append((w, n, len(bad), [np.flatnonzero(np.unpackbits(packed[j], count=len(model.p))).tolist() for j in bad[:keep]]))
            yield pd.DataFrame(rows, columns=["w", "t", "f", "failing"]).astype({"w": "Int64"})

    work = spark.createDataFrame(blocks, "w long, block long, n long").repartition(max(1, min(len(blocks), 4 * spark.sparkContext.defaultParallelism)))
    done = work.mapInPandas(run, "w long, t long, f long, failing array<array<long>>")
    return done.groupBy("w").agg(F.sum("t").alias("t"), F.sum("f").alias("f"), F.flatten(F.collect_list("failing")).alias("failing"))


def estimate(errors: int, shots: int) -> tuple[float, float, float, float]:
    """Rate, half the width of its Jeffreys interval, and the exact interval."""
    low, high = jeffreys(errors, shots)
    return (errors / shots, (high - low) / 2, *clopper_pearson(errors, shots))


RESULT = "p double, rounds long, shots long, errors long, ler double, ler_se double, low double, high double"


def run(spark: SparkSession, build: Callable[[memory.Noise, int], memory.Circuit], noise: memory.Noise, rounds: int, shots: int, decoder: Decoder, seed: int, calibration: memory.Noise | None = None) -> tuple:
    """One point; the decoder's priors are the circuit's, or frozen at those of another noise model."""
    model = Model.of(spark, build(noise, rounds))
    if calibration is not None:
        known = Model.of(spark, build(calibration, rounds))
        if known.h.shape != model.h.shape or (known.h != model.h).any():
            raise ValueError("the calibration circuit has other mechanisms")
        decoder.setup(known.h, known.p, known.observables)
    else:
        decoder.setup(model.h, model.p, model.observables)
    got = count_failures(spark, model, decoder, [(None, shots)], seed).first()
    return (noise.p_phys, rounds, got.t, got.f, *estimate(got.f, got.t))


def sweep(spark: SparkSession, build: Callable[[memory.Noise, int], memory.Circuit], noises: Iterable[memory.Noise], rounds: Iterable[int], shots: int, decoder: Decoder, seed: int, calibration: memory.Noise | None = None) -> DataFrame:
    """Every noise model with every number of rounds: p, rounds, shots, errors, ler, ler_se, low, high."""
    return spark.createDataFrame([run(spark, build, n, r, shots, decoder, seed, calibration) for n in noises for r in rounds], RESULT)


def predicted(measured: dict[int, float], w: int, window: int = 3) -> float:
    """f(w) on the line through ln f at the nearest measured weights with 0 < f < 1; else the nearest f, or 1 without any."""
    inner = sorted((k for k, f in measured.items() if 0 < f < 1), key=lambda k: (abs(k - w), k))[: max(2, window)]
    if len(inner) > 1:
        slope, start = np.polyfit(inner, np.log([measured[k] for k in inner]), 1)
        return float(np.clip(np.exp(start + slope * w), 1e-12, 1))
    near = inner or sorted(measured, key=lambda k: abs(k - w))[:1]
    return float(np.clip(measured[near[0]], 1e-12, 1)) if near else 1.0


def fixed_sampling(spark: SparkSession, model: Model, decoder: Decoder, budget: int | dict[int, int], weights: Iterable[int], seed: int) -> DataFrame:
    """w, t, f with a fixed number of shots, for all weights or by weight."""
    plan = [(w, budget if isinstance(budget, int) else budget[w]) for w in sorted(set(weights))]
    return count_failures(spark, model, decoder, plan, seed).select("w", "t", "f")


def adaptive_sampling(spark: SparkSession, model: Model, decoder: Decoder, weights: Iterable[int], seed: int, target: int = 50, least: int = 4, most: int = 20000, window: int = 3, stop_after_zeros: int | None = None) -> DataFrame:
    """w, t, f from the largest weight down; each weight's shots are what its predicted f needs for ``target`` failures.

    Weights below ``stop_after_zeros`` weights in a row without a failure at the full budget are left out: their f is
    smaller still, and a weight without failures adds nothing to a reweighted rate.
    """
    measured: dict[int, float] = {}
    rows, empty = [], 0
    for w in sorted(set(weights), reverse=True):
        shots = int(np.clip(np.ceil(target / max(predicted(measured, w, window), 1e-300)), least, most))
        got = count_failures(spark, model, decoder, [(w, shots)], seed).first()
        rows.append((w, got.t, got.f))
        measured[w] = got.f / got.t
        empty = empty + 1 if got.f == 0 and shots >= most else 0
        if stop_after_zeros is not None and empty >= stop_after_zeros:
            break
    return spark.createDataFrame(sorted(rows), "w long, t long, f long")


def onset(spark: SparkSession, model: Model, decoder: Decoder, shots: int, seed: int, low: int = 1, high: int = 64) -> int | None:
    """The smallest weight in [low, high] of which some shot fails."""
    for w in range(low, high + 1):
        if count_failures(spark, model, decoder, [(w, shots)], seed).first().f:
            return w
    return None
