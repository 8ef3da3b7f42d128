"""Memory circuits of bivariate-bicycle codes as instruction rows, and their fault mechanisms by Pauli frames.

A circuit is compiled from two small tables. TIMETABLE says what each kind of check does in each slot of a cycle: couple
its ancillas by one monomial, or an activity by name. ACTIVITIES says what instructions an activity consists of, with
the noise channel of each noisy one. Qubits without an activity in a slot rest. Detectors are differences of each
check's record of outcomes. A circuit is a list of (name, targets, rate, channel); a noise model gives the rates.

Every elementary component of every noise row is one fault. A task carries its faults through the circuit at once, as
bit matrices of X and Z frames; flipped measurements give detectors and observables, and equal signatures merge by the
rule of odd parity.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raretide.functions import gf2

NOISE = ("X_ERROR", "DEPOLARIZE1", "DEPOLARIZE2")
#: What X and Z checks do in each slot (fixed values, the published schedule): the monomial that couples them, or an activity.
TIMETABLE = (
    ("prepare_plus", 3),
    (1, 5),
    (4, 0),
    (3, 1),
    (5, 2),
    (0, 4),
    (2, "read"),
    ("read_plus", "prepare"),
)
#: Activities as (instruction, noise channel or None).
ACTIVITIES = {
    "prepare": (("R", None), ("X_ERROR", "prep")),
    "prepare_plus": (("R", None), ("X_ERROR", "prep"), ("H", None), ("DEPOLARIZE1", "gate")),
    "couple": (("CX", None), ("DEPOLARIZE2", "cz")),
    "read": (("X_ERROR", "meas"), ("M", None)),
    "read_plus": (("H", None), ("DEPOLARIZE1", "gate"), ("X_ERROR", "meas"), ("M", None)),
    "rest": (("DEPOLARIZE1", "idle"),),
}
#: idle is either of the two: beside gates, or in a slot in which some qubit is measured or prepared only.
CHANNELS = ("cz", "meas", "prep", "gate", "gate_idle", "meas_idle")


@dataclass(frozen=True)
class Noise:
    """Rates of the physical noise: of gates and resting, of measurement, of preparation (by default as measurement)."""

    p_phys: float
    p_meas: float
    p_reset: float | None = None
    idle: bool = True

    def __post_init__(self):
        if any(not 0 <= p <= 1 for p in (self.p_phys, self.p_meas, self.p_reset or 0.0)):
            raise ValueError("rates lie in [0, 1]")

    def rate(self, channel: str) -> float:
        if channel == "meas":
            return self.p_meas
        if channel == "prep":
            return self.p_meas if self.p_reset is None else self.p_reset
        return self.p_phys if self.idle or not channel.endswith("idle") else 0.0

    @classmethod
    def uniform(cls, p: float) -> Noise:
        return cls(p, p)

    @classmethod
    def measurement_ratio(cls, p_phys: float, ratio: float) -> Noise:
        """p_meas = ratio * p_phys."""
        return cls(p_phys, min(1.0, ratio * p_phys))

    @classmethod
    def physical_ratio(cls, p_meas: float, ratio: float) -> Noise:
        """p_phys = ratio * p_meas."""
        return cls(min(1.0, ratio * p_meas), p_meas)


@dataclass
class Circuit:
    qubits: int
    rows: list[tuple[str, list[int], float, str | None]] = field(default_factory=list)
    detectors: list[list[int]] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)  # 0: of a Z check, 1: of an X check
    observables: list[list[int]] = field(default_factory=list)

    @property
    def measured(self) -> int:
        return sum(len(r[1]) for r in self.rows if r[0] == "M")


class _Compiler:
    def __init__(self, qubits: int, noise: Noise):
        self.circuit, self.noise, self.outcomes = Circuit(qubits), noise, 0

    def perform(self, activity: str, targets: list[int], idle: str = "gate_idle") -> list[int]:
        """Append an activity's instructions; the indices of the outcomes that it measures."""
        got: list[int] = []
        for name, channel in ACTIVITIES[activity] if targets else ():
            channel = idle if channel == "idle" else channel
            rate = self.noise.rate(channel) if channel else 0.0
            if name == "M":
                got = list(range(self.outcomes, self.outcomes + len(targets)))
                self.outcomes += len(targets)
            if not channel or rate > 0:
                self.circuit.rows.append((name, list(targets), rate, channel))
        return got


def _partners(l: int, m: int, monomials: list, sign: int, at: int) -> list[list[int]]:  # noqa: E741
    """For each monomial the data qubit of each check, in the half that starts at ``at``."""
    cells = np.arange(l * m)
    return [(at + (cells // m + sign * a) % l * m + (cells % m + sign * b) % m).tolist() for a, b in monomials]


def memory_circuit(l: int, m: int, a: list, b: list, rounds: int, noise: Noise | float, p_measure: float | None = None) -> Circuit:  # noqa: E741
    """A Z-basis memory experiment of ``rounds`` cycles of the timetable; noise: a model, or one rate for all."""
    if not isinstance(noise, Noise):
        noise = Noise(noise, noise if p_measure is None else p_measure)
    half = l * m
    data, ancillas = list(range(2 * half)), (list(range(2 * half, 3 * half)), list(range(3 * half, 4 * half)))
    partners = (_partners(l, m, a, 1, 0) + _partners(l, m, b, 1, half), _partners(l, m, b, -1, 0) + _partners(l, m, a, -1, half))
    checks = np.zeros((2, half, 2 * half), np.uint8)
    for kind, of_kind in enumerate(partners):
        for monomial in of_kind:
            checks[kind, np.arange(half), monomial] ^= 1
    out = _Compiler(4 * half, noise)
    out.perform("prepare", data + ancillas[1])
    record: tuple[list, list] = ([], [])  # of X and of Z checks, the outcomes of each cycle
    for _ in range(rounds):
        for slot in TIMETABLE:
            pairs, busy, gates = [], set(), False
            for kind, does in enumerate(slot):
                busy |= set(ancillas[kind])
                if isinstance(does, int):  # X checks control their data, data control Z checks
                    ends = (ancillas[kind], partners[kind][does])
                    pairs += [q for pair in zip(*(ends if kind == 0 else ends[::-1]), strict=True) for q in pair]
                    busy |= set(ends[1])
                    gates = True
                elif got := out.perform(does, ancillas[kind]):
                    record[kind].append(got)
            out.perform("couple", pairs)
            out.perform("rest", sorted(set(range(4 * half)) - busy), "gate_idle" if gates else "meas_idle")
    final = out.perform("read", data)
    circuit = out.circuit
    ended = [[[final[q] for q in np.flatnonzero(row)] for row in checks[1]]]
    blocks = []  # cycle, kind (0: of Z checks), detectors of one cycle's checks
    for kind, closing in ((0, []), (1, ended)):
        outcomes = [[[o] for o in cycle] for cycle in record[kind]] + closing
        # data start in a known state of the Z checks only: theirs has a detector before the first difference
        earlier = [[[]] * half] + outcomes[:-1]
        for cycle, (now, then) in list(enumerate(zip(outcomes, earlier, strict=True)))[1 - kind :]:
            blocks.append((cycle, 1 - kind, [x + y for x, y in zip(now, then, strict=True)]))
    for _, kind, block in sorted(blocks, key=lambda x: x[:2]):
        circuit.detectors += block
        circuit.kinds += [kind] * half
    circuit.observables = [[final[q] for q in np.flatnonzero(v)] for v in gf2.logicals(checks[0], checks[1])]
    return circuit


def isolated(circuit: Circuit, channels: Iterable[str]) -> Circuit:
    """The circuit with the noise of these channels only; its other instructions stay."""
    return scaled(circuit, {c: 1.0 if c in set(_known(channels)) else 0.0 for c in CHANNELS})


def ablated(circuit: Circuit, channels: Iterable[str]) -> Circuit:
    """The circuit without the noise of these channels."""
    return scaled(circuit, dict.fromkeys(_known(channels), 0.0))


def scaled(circuit: Circuit, factors: dict[str, float]) -> Circuit:
    """Rates times the factor of their channel (1 where none is named), at most 1; noise of rate 0 goes. Calls compose."""
    _known(factors)
    rows = [(n, t, min(1.0, p * factors.get(c, 1.0)) if c else p, c) for n, t, p, c in circuit.rows]
    return replace(circuit, rows=[r for r in rows if r[3] is None or r[2] > 0])


def varied(circuit: Circuit, isolate: str | None = None, ablate: str | None = None, factors: dict[str, float] | None = None) -> Circuit:
    """A study's variant: scaled, then either one channel alone or all but one (never both)."""
    if isolate and ablate:
        raise ValueError("isolate a channel or ablate one, not both")
    circuit = scaled(circuit, factors) if factors else circuit
    return isolated(circuit, [isolate]) if isolate else ablated(circuit, [ablate]) if ablate else circuit


def _known(channels: Iterable[str]) -> Iterable[str]:
    if odd := set(channels) - set(CHANNELS):
        raise ValueError(f"unknown channels: {sorted(odd)}")
    return channels


def components(name: str, targets: list[int], rate: float) -> list[tuple[float, list[tuple[int, int, int]]]]:
    """(probability, [(qubit, x, z)]) of the independent elementary faults of a noise row."""
    paulis = ((1, 0), (1, 1), (0, 1))
    if name == "X_ERROR":
        return [(rate, [(q, 1, 0)]) for q in targets]
    if name == "DEPOLARIZE1":
        q1 = 0.5 * (1 - (1 - 4 * rate / 3) ** 0.5)
        return [(q1, [(q, x, z)]) for q in targets for x, z in paulis]
    q2 = 0.5 * (1 - (1 - 16 * rate / 15) ** 0.125)
    both = [(a, b) for a in ((0, 0), *paulis) for b in ((0, 0), *paulis) if a != (0, 0) or b != (0, 0)]
    return [(q2, [(s, *a), (t, *b)]) for s, t in zip(targets[::2], targets[1::2], strict=True) for a, b in both]


def flips(circuit: Circuit, faults: list[tuple[int, list[tuple[int, int, int]]]]) -> np.ndarray:
    """faults x measurements: which measurements each fault (row of the circuit, Pauli) flips."""
    n = len(faults)
    x, z = np.zeros((circuit.qubits, n), np.uint8), np.zeros((circuit.qubits, n), np.uint8)
    out, done = np.zeros((circuit.measured, n), np.uint8), 0
    at: dict[int, list[int]] = {}
    for i, (row, _) in enumerate(faults):
        at.setdefault(row, []).append(i)
    for row, (name, targets, *_) in enumerate(circuit.rows):
        if name == "CX":
            s, t = targets[::2], targets[1::2]
            x[t] ^= x[s]
            z[s] ^= z[t]
        elif name == "H":
            x[targets], z[targets] = z[targets], x[targets]
        elif name == "R":
            x[targets] = z[targets] = 0
        elif name == "M":
            out[done : done + len(targets)] = x[targets]
            done += len(targets)
        for i in at.get(row, ()):
            for q, fx, fz in faults[i][1]:
                x[q, i] ^= fx
                z[q, i] ^= fz
    return out.T


def mechanisms(spark: SparkSession, circuit: Circuit, channels: set[str] | None = None, parts: int = 8) -> DataFrame:
    """dets, obs (sorted indices), p, merged: the visible fault mechanisms of the circuit, or of some noise channels."""
    rows = [i for i, r in enumerate(circuit.rows) if r[3] is not None and (channels is None or r[3] in channels)]
    shared = spark.sparkContext.broadcast(circuit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        detectors, observables = (np.zeros((len(g), c.measured), np.uint8) for g in (c.detectors, c.observables))
        for matrix, groups in ((detectors, c.detectors), (observables, c.observables)):
            for i, g in enumerate(groups):
                np.add.at(matrix[i], g, 1)
        for b in batches:  # all faults of a batch of noise rows are carried through the circuit together
            faults = [(row, e, q) for row in b.row.tolist() for q, e in components(*c.rows[row][:3])]
            seen = flips(c, [(row, e) for row, e, _ in faults])
            d, o = seen @ detectors.T % 2, seen @ observables.T % 2
            yield pd.DataFrame({"dets": [np.flatnonzero(v).tolist() for v in d], "obs": [np.flatnonzero(v).tolist() for v in o], "p": [q for *_, q in faults]})

    found = spark.createDataFrame([(r,) for r in rows], "row int").repartition(parts).mapInPandas(run, "dets array<int>, obs array<int>, p double")
    visible = found.filter("size(dets) > 0 OR size(obs) > 0")
    return visible.groupBy("dets", "obs").agg(((1 - F.exp(F.sum(F.log(1 - 2 * F.col("p"))))) / 2).alias("p"), F.count(F.lit(1)).alias("merged"))


def masks(mechs: DataFrame, detectors: list[int] | None = None) -> DataFrame:
    """mech, p, det, obs as bit masks of at most 63 detectors; ``detectors``: those of a sector, merged and renumbered."""
    place = F.col("dets") if detectors is None else F.filter("dets", lambda d: d.isin(detectors))
    bits = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, d: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), d)))
    rows = mechs.select(bits(place).alias("det"), bits(F.col("obs")).alias("obs"), "p").filter("det <> 0 OR obs <> 0")
    merged = rows.groupBy("det", "obs").agg(((1 - F.exp(F.sum(F.log(1 - 2 * F.col("p"))))) / 2).alias("p"))
    return merged.select(F.xxhash64("det", "obs").alias("mech"), "p", "det", "obs")


def logicals_of_weight(columns: DataFrame, weight: int) -> DataFrame:
    """Undetectable sets of 1 to 3 columns that flip an observable: the last column closes the others' syndrome by a join."""
    one = columns.select(F.col("mech").alias("c1"), F.col("det").alias("d"), F.col("obs").alias("o"))
    if weight == 1:
        return one.filter("d = 0 AND o <> 0").select(F.array("c1").alias("members"))
    open_set = one
    if weight == 3:
        two = columns.select(F.col("mech").alias("c2"), F.col("det").alias("d2"), F.col("obs").alias("o2"))
        open_set = one.join(two, F.col("c1") < F.col("c2")).select("c1", "c2", F.col("d").bitwiseXOR(F.col("d2")).alias("d"), F.col("o").bitwiseXOR(F.col("o2")).alias("o"))
    last = columns.select(F.col("mech").alias("c"), F.col("det").alias("d"), F.col("obs").alias("oc"))
    top = "c1" if weight == 2 else "c2"
    closed = open_set.join(last, "d").filter(F.col(top) < F.col("c")).filter("o <> oc")
    return closed.select(F.array(*(["c1", "c"] if weight == 2 else ["c1", "c2", "c"])).alias("members"))
