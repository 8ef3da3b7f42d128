"""Queries that need numpy kernels or a stream; tests compare them with brute force instead of SQL."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import functions as F

from raretide.functions import gf2, relay
from raretide.operators import codes, decode, fit, memory, splitting
from raretide.operators import montecarlo as mc
from raretide.operators import spectrum as S
from raretide.plans import base as X
from raretide.plans.catalogue import query
from raretide.plans.relations import BB6
from raretide.streaming.spectra import spectrum_stream


def bb6(spark) -> tuple[np.ndarray, np.ndarray]:
    """H_X and H_Z of the code, from its coordinate table (432 rows)."""
    out = {"X": np.zeros((36, 72), np.uint8), "Z": np.zeros((36, 72), np.uint8)}
    for r in codes.parity_checks(spark, *BB6).collect():
        out[r.kind][r.row, r.col] = 1
    return out["X"], out["Z"]


@query()
def gf2_rank(spark, sf):
    """Ranks of both check matrices and the number of logical qubits."""
    hx, hz = bb6(spark)
    rows = [("X", gf2.rank(hx)), ("Z", gf2.rank(hz)), ("k", len(gf2.logicals(hx, hz)))]
    return spark.createDataFrame(rows, "matrix string, rank long")


def decoded(spark, plan):
    """w, t, f of min-sum + OSD on the 72-qubit code, for plan (w, shots)."""
    hx, hz = bb6(spark)
    return decode.spectrum_of_weights(spark, plan, hx, np.full(72, 0.02), gf2.logicals(hz, hx), 11)


@query()
def bp_osd_decode(spark, sf):
    """Failures by weight of min-sum + OSD on the 72-qubit code; a fixed plan of 200 shots of each weight up to 8 that lineitem has."""
    return decoded(spark, S.failure_spectrum(X.shots(spark, sf)).filter("w <= 8").select("w", F.lit(200).cast("long").alias("shots")))


@query()
def bp_osd_decode_all(spark, sf):
    """Failures by weight of min-sum + OSD on the 72-qubit code; as many shots of every weight as lineitem has rows for it."""
    return decoded(spark, S.failure_spectrum(X.shots(spark, sf)).select("w", F.col("t").alias("shots")))


@query()
def fit_ansatz(spark, sf):
    return fit.fit_spectra(S.failure_spectrum(X.shots(spark, sf), ["channel"]), "channel", 1.0)


@query()
def bootstrap_band(spark, sf):
    return fit.bootstrap(S.failure_spectrum(X.shots(spark, sf)), list(X.RATES), 200, 1.0, 40, 3)


@query()
def splitting_chain(spark, sf):
    """A ladder over a failure set with a known law: all of four columns, so P(q) = q**4."""
    return splitting.ladder(spark, 12, splitting.first_four, np.ones(12, np.uint8), [0.3, 0.2, 0.13, 0.09], 16, 4000, 5)


@query(f"WITH {X.SPEC} SELECT CAST(w AS BIGINT) AS w, t, f FROM spec")
def streaming_spectrum(spark, sf):
    schema = X.read(spark, sf, "lineitem").schema
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp()}"
    place = f"{shared}/spectrum-{spark.sparkContext.applicationId}-{abs(hash(sf))}-{np.random.default_rng().integers(1 << 40)}"
    shots = lambda df: df.select(F.col("l_quantity").cast("int").alias("w"), (F.col("l_returnflag") == "R").alias("fail"))
    out = spectrum_stream(spark, f"{sf}/lineitem.parque[t]", schema, shots, f"{place}/out", f"{place}/stream")
    return out.select(F.col("w").cast("long").alias("w"), "t", "f")


#: The [[18, 4, 4]] code's polynomials (fixed values): x + 1 + y^2 and y + 1 + x^2 over Z_3 x Z_3.
BB18 = (3, 3, [(1, 0), (0, 0), (0, 2)], [(0, 1), (0, 0), (2, 0)])


@query()
def mechanism_counts(spark, sf):
    """Mechanisms of the 18-qubit code's two-cycle memory, in all and by noise channel."""
    circuit = memory.memory_circuit(*BB18, 2, 0.003)
    out = None
    for name, channels in (("full", None), *((c, {c}) for c in ("cz", "meas", "prep", "gate_idle", "meas_idle"))):
        part = memory.mechanisms(spark, circuit, channels).agg(F.count(F.lit(1)).alias("mechanisms"), F.round(F.sum("p"), 9).alias("rate")).select(F.lit(name).alias("channel"), "mechanisms", "rate")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def min_weight_logicals(spark, sf):
    """All logical sets of at most three columns in the Z sector of the 18-qubit code's memory, by weight."""
    circuit = memory.memory_circuit(*BB18, 2, 0.003)
    columns = memory.masks(memory.mechanisms(spark, circuit), [i for i, k in enumerate(circuit.kinds) if k == 0])
    out = None
    for w in (1, 2, 3):
        part = memory.logicals_of_weight(columns, w).agg(F.count(F.lit(1)).alias("logicals")).select(F.lit(w).cast("long").alias("w"), "logicals")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def circuit_spectrum(spark, sf):
    """Failure spectrum of the 18-qubit code's memory circuit: mechanisms drawn by weight, decoded by min-sum + OSD."""
    circuit = memory.memory_circuit(*BB18, 2, 0.003)
    mechs = memory.mechanisms(spark, circuit).orderBy("dets", "obs").collect()  # as many as the circuit has
    h = np.zeros((len(circuit.detectors), len(mechs)), np.uint8)
    for i, r in enumerate(mechs):
        h[r.dets, i] = 1
    at = lambda c, n: spark.createDataFrame([(int(x), i) for i, r in enumerate(mechs) for x in r[c]], f"{n} long, col long")
    plan = spark.createDataFrame([(w, 60) for w in (1, 2, 3, 4, 6, 8)], "w int, shots long")
    faults = decode.shots_of_weight(spark, plan, len(mechs), 17)
    synd = decode.syndromes_of(faults, at("dets", "row"), ["w", "shot"])
    answers = decode.decode_distinct(synd, h, np.array([r.p for r in mechs]))
    result = decode.failures(faults, synd.join(answers, "syndrome"), at("obs", "k"), ["w", "shot"])
    return S.failure_spectrum(result.withColumnRenamed("failed", "fail")).select(F.col("w").cast("long").alias("w"), "t", "f")


def _bb18(noise, rounds):
    return memory.memory_circuit(*BB18, rounds, noise)


@query()
def mc_sweep(spark, sf):
    """Direct Monte Carlo of the 18-qubit code's memory over rates and cycles; ten shots for each supplier at every point."""
    shots = 10 * X.read(spark, sf, "supplier").count()
    noises = [memory.Noise.uniform(p) for p in (0.003, 0.006, 0.012)]
    return mc.sweep(spark, _bb18, noises, (2, 3), shots, relay.named("relay", legs=6, seed=3), 23)


@query()
def mc_frozen_calibration(spark, sf):
    """The same at a rate for which the decoder was not calibrated: its priors are those of another rate."""
    shots = 10 * X.read(spark, sf, "supplier").count()
    return mc.sweep(spark, _bb18, [memory.Noise.uniform(0.012)], (2,), shots, relay.named("relay", legs=6, seed=3), 23, calibration=memory.Noise.uniform(0.003))


@query()
def channel_variants(spark, sf):
    """Mechanisms and summed rates of the 18-qubit memory's variants: each channel alone, without it, and measurement times five."""
    circuit = memory.memory_circuit(*BB18, 2, memory.Noise.measurement_ratio(0.003, 2.0))
    variants = [("full", circuit)]
    for c in memory.CHANNELS:
        variants += [(f"{c}__iso", memory.varied(circuit, isolate=c)), (f"{c}__abl", memory.varied(circuit, ablate=c))]
    fivefold = {"meas": 5.0, "meas_idle": 5.0}
    variants += [("x5", memory.varied(circuit, factors=fivefold)), ("x5 meas__abl", memory.varied(circuit, ablate="meas", factors=fivefold))]
    out = None
    for name, variant in variants:
        part = memory.mechanisms(spark, variant).agg(F.count(F.lit(1)).alias("mechanisms"), F.round(F.sum("p"), 9).alias("rate")).select(F.lit(name).alias("variant"), "mechanisms", "rate")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def adaptive_spectrum(spark, sf):
    """Failure spectrum of the 18-qubit memory's Z sector, each weight with as many shots as its predicted failures need."""
    circuit = memory.memory_circuit(*BB18, 2, 0.003)
    model = mc.Model.of(spark, circuit, kind=0)
    return mc.adaptive_sampling(spark, model, relay.named("relay", legs=6, seed=3), range(1, 17), 29, target=30, most=10 * X.read(spark, sf, "supplier").count(), stop_after_zeros=2)


@query()
def decoder_comparison(spark, sf):
    """Failures of each registered decoder on the same shots of the 18-qubit memory."""
    model = mc.Model.of(spark, _bb18(memory.Noise.uniform(0.006), 2))
    shots, out = 10 * X.read(spark, sf, "supplier").count(), None
    for name, settings in (("relay", {"legs": 6, "seed": 3}), ("bposd", {}), ("trivial", {})):
        part = mc.count_failures(spark, model, relay.named(name, **settings), [(None, shots)], 31).select(F.lit(name).alias("decoder"), "t", "f")
        out = part if out is None else out.unionByName(part)
    return out
