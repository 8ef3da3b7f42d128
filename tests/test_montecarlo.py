"""Intervals, batch decoders, noise variants and sampling against brute force and known numbers."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from raretide.functions import intervals, relay
from raretide.functions.decoders import BpOsd
from raretide.operators import memory
from raretide.operators import montecarlo as mc
from raretide.plans import catalogue, kernels

catalogue.load()


def test_beta_and_binomial_intervals():
    for a, b in ((0.5, 0.5), (3, 7), (40.5, 960.5), (1, 20)):
        for p in (0.025, 0.5, 0.975):
            assert abs(intervals.beta_cdf(intervals.beta_quantile(p, a, b), a, b) - p) < 1e-9
    tail = lambda k, n, x: sum(math.comb(n, i) * x**i * (1 - x) ** (n - i) for i in range(k, n + 1))
    for k, n in ((0, 10), (3, 30), (30, 30), (7, 200)):
        low, high = intervals.clopper_pearson(k, n)
        assert (k == 0 and low == 0) or abs(tail(k, n, low) - 0.025) < 1e-8
        assert (k == n and high == 1) or abs(1 - tail(k + 1, n, high) - 0.025) < 1e-8
    low, high = intervals.jeffreys(0, 100)
    assert 0 < low < 1e-5 and 0.02 < high < 0.03


def _code(spark):
    hx, hz = kernels.bb6(spark)
    return hx, hz


def test_decoders_meet_their_syndromes(spark):
    hx, hz = _code(spark)
    from raretide.functions import gf2

    observables, priors = gf2.logicals(hz, hx), np.full(72, 0.02)
    r = np.random.default_rng(5)
    faults = np.zeros((600, 72), np.uint8)
    for i, row in enumerate(faults):
        row[r.choice(72, 1 + i % 4, replace=False)] = 1
    events = faults @ hx.T % 2
    truth = faults @ observables.T % 2
    wrong = {}
    for name in ("relay", "bposd", "trivial"):
        d = relay.named(name).setup(hx, priors, observables)
        if name != "trivial":
            solved = (d.corrections(events) @ hx.T % 2 == events).all(1)
            assert solved.mean() > 0.99
        wrong[name] = int((d.decode(events) != truth).any(1).sum())
    assert max(wrong["relay"], wrong["bposd"]) <= 0.05 * len(faults) < wrong["trivial"]
    one_by_one = BpOsd(hx, priors)
    light = events[np.arange(600) % 4 == 0]  # single faults have one lightest answer
    batch = relay.named("bposd").setup(hx, priors, observables).corrections(light)
    assert all(np.array_equal(batch[i], one_by_one(s)) for i, s in enumerate(light))
    with pytest.raises(ValueError):
        relay.named("oracle")
    with pytest.raises(RuntimeError):
        relay.named("relay").decode(events)


def test_answers_of_a_small_code():
    """Every answer is listed: none given is lighter than the lightest, and more legs never make it heavier."""
    h = np.array([[1, 1, 0, 1, 1, 0, 0], [1, 0, 1, 1, 0, 1, 0], [0, 1, 1, 1, 0, 0, 1]], np.uint8)
    priors = np.array([0.05, 0.04, 0.06, 0.03, 0.02, 0.07, 0.01])
    every = np.array(list(itertools.product((0, 1), repeat=7)), np.uint8)
    weight = np.log((1 - priors) / priors)
    events = np.array(list(itertools.product((0, 1), repeat=3)), np.uint8)
    lightest = np.array([min(weight @ y for y in every if np.array_equal(h @ y % 2, e)) for e in events])
    before = None
    for settings in ({"legs": 4}, {"legs": 12}, {"legs": 40}):
        got = relay.named("relay", stop=1000, seed=2, **settings).setup(h, priors, np.ones((1, 7), np.uint8)).corrections(events)
        assert np.array_equal(got @ h.T % 2, events)
        now = got @ weight
        assert (now >= lightest - 1e-6).all() and (before is None or (now <= before + 1e-6).all())
        before = now
    closed = relay.named("bposd", rounds=0).setup(h, priors, np.ones((1, 7), np.uint8)).corrections(events)
    assert np.allclose(closed @ weight, lightest, atol=1e-5)  # ordered statistics alone try every answer here


def test_noise_models_and_variants(spark):
    n = memory.Noise.measurement_ratio(0.002, 3.0)
    assert (n.rate("cz"), n.rate("meas"), n.rate("prep")) == (0.002, pytest.approx(0.006), pytest.approx(0.006))
    assert memory.Noise(0.1, 0.2, 0.3).rate("prep") == 0.3 and memory.Noise.physical_ratio(0.01, 0.5).p_phys == 0.005
    with pytest.raises(ValueError):
        memory.Noise(1.5, 0)
    circuit = memory.memory_circuit(*kernels.BB18, 2, 0.003)
    assert {r[3] for r in circuit.rows} == {None, *memory.CHANNELS}
    quiet = [r for r in circuit.rows if r[3] is None]
    for c in memory.CHANNELS:
        alone, without = memory.varied(circuit, isolate=c), memory.varied(circuit, ablate=c)
        assert {r[3] for r in alone.rows} == {None, c} and c not in {r[3] for r in without.rows}
        assert [r for r in alone.rows if r[3] is None] == quiet and len(alone.rows) + len(without.rows) == len(circuit.rows) + len(quiet)
    both = memory.varied(circuit, ablate="meas", factors={"meas_idle": 5.0})
    assert {r[2] for r in both.rows if r[3] == "meas_idle"} == {0.015} and "meas" not in {r[3] for r in both.rows}
    for wrong in ({"isolate": "cz", "ablate": "cz"}, {"isolate": "crosstalk"}, {"factors": {"x": 2.0}}):
        with pytest.raises(ValueError):
            memory.varied(circuit, **wrong)
    assert len(circuit.detectors) == len(circuit.kinds) == 9 * (2 + 1 + 1) and max(max(d) for d in circuit.detectors) == circuit.measured - 1
    got = {x.variant: (x.mechanisms, x.rate) for x in catalogue.QUERIES["channel_variants"](spark, "").collect()}
    assert got["full"][1] == pytest.approx(sum(got[f"{c}__iso"][1] for c in memory.CHANNELS), rel=0.05)
    assert all(got[f"{c}__abl"][1] < got["full"][1] < got["x5"][1] for c in memory.CHANNELS)


def test_sampling(spark):
    circuit = memory.memory_circuit(*kernels.BB18, 2, 0.003)
    model = mc.Model.of(spark, circuit)
    columns, q = model.expanded()
    assert q == model.p.min() and np.array_equal(np.bincount(columns), np.maximum(1, np.rint(model.p / q)))
    trivial = relay.named("trivial")
    got = {x.w: x for x in mc.count_failures(spark, model, trivial, [(1, 700), (None, 1100), (3, 5)], 4, keep=3).collect()}
    assert {w: x.t for w, x in got.items()} == {1: 700, None: 1100, 3: 5}
    assert got[None].f == [x.f for x in mc.count_failures(spark, model, relay.named("trivial"), [(None, 1100)], 4).collect()][0]
    # a decoder that never corrects fails where a fault flips an observable: known exactly at weight 1
    share = (model.observables.any(0)[columns]).mean()
    assert abs(got[1].f / 700 - share) < 4 * math.sqrt(share * (1 - share) / 700)
    for fault in got[1].failing:
        assert len(fault) == 1 and model.observables[:, fault].any()
    flips = 1 - 2 * model.p
    any_flip = 1 - np.mean([np.prod(flips[(np.array(k) @ model.observables % 2).astype(bool)]) for k in itertools.product((0, 1), repeat=4)])
    assert abs(got[None].f / 1100 - any_flip) < 4 * math.sqrt(any_flip / 1100)


def test_blocks_share_what_they_decode(spark):
    """A task's blocks ask the decoder for each of their events once, and count as blocks alone do."""

    class Counting(relay.Trivial):
        def corrections(self, events):
            if len(np.unique(events, axis=0)) != len(events) or len(events) > 1024:
                raise ValueError("events asked twice, or too many at once")
            self.asked = getattr(self, "asked", 0) + len(events)
            return super().corrections(events)

    model = mc.Model.of(spark, memory.memory_circuit(*kernels.BB18, 2, 0.003))
    decoder = Counting().setup(model.h, model.p, model.observables)
    events = np.vstack([model.outcomes(np.eye(len(model.p), dtype=np.uint8))[0]] * 3)
    decoder.decode(events)
    assert decoder.asked == len(np.unique(events, axis=0))
    want = []
    for k, n in ((0, 512), (1, 512), (2, 76)):
        faults = (np.random.default_rng([9, 0, k]).random((n, len(model.p))) < model.p).astype(np.uint8)
        want += [(model.observables @ f % 2).any() for f in faults]
    got = mc.count_failures(spark, model, relay.named("trivial"), [(None, 1100)], 9).first()
    assert (got.t, got.f) == (1100, sum(want))


@pytest.mark.parametrize("scale", [1.0, 0.625])
def test_min_sum_stops_at_met_syndromes_and_matches_one_by_one(spark, scale):
    """Shots of one batch do not touch each other, over more than one part of a batch, with silent checks and columns."""
    r = np.random.default_rng(3)
    h = (r.random((12, 40)) < 0.2).astype(np.uint8)
    h[5], h[:, 7] = 0, 0
    core = relay.MinSum(h, r.uniform(0.01, 0.2, 40), scale)
    syndromes = (r.random((150, 40)) < 0.1).astype(np.uint8) @ h.T % 2
    syndromes[3, 5] = 1
    start, memory = np.repeat(core.prior[None], 150, axis=0), r.uniform(-0.2, 0.6, 40).astype(np.float32)
    out, met = core.run(syndromes, start, memory, 25)
    assert met.any() and not met[3] and np.array_equal(met, core.satisfied(out < 0, syndromes))
    for i in range(0, 150, 7):
        one, ok = core.run(syndromes[i : i + 1], start[:1], memory, 25)
        assert np.array_equal(one[0], out[i]) and ok[0] == met[i]


def test_adaptive_sampling_and_sweeps(spark, sf_dir):
    assert mc.predicted({}, 5) == 1.0 and mc.predicted({9: 1.0}, 5) == 1.0
    assert mc.predicted({8: math.exp(-2), 9: math.exp(-1), 7: math.exp(-3)}, 5) == pytest.approx(math.exp(-5))
    spec = catalogue.QUERIES["adaptive_spectrum"](spark, sf_dir).orderBy("w").collect()
    f = {x.w: x.f / x.t for x in spec}
    assert max(f) == 16 and f[16] > 0.5 and f[min(f)] < 0.2
    sizes = {x.w: x.t for x in spec}
    assert sizes[16] <= sizes[min(sizes)]
    rows = catalogue.QUERIES["mc_sweep"](spark, sf_dir).collect()
    assert len(rows) == 6 and all(x.low <= x.ler <= x.high and x.ler == x.errors / x.shots for x in rows)
    again = catalogue.QUERIES["mc_sweep"](spark, sf_dir).collect()
    assert sorted(rows) == sorted(again)
    assert catalogue.QUERIES["mc_frozen_calibration"](spark, sf_dir).count() == 1
    by = {x.decoder: x.f for x in catalogue.QUERIES["decoder_comparison"](spark, sf_dir).collect()}
    assert by["relay"] <= by["trivial"] and by["bposd"] <= by["trivial"]
    model = mc.Model.of(spark, memory.memory_circuit(*kernels.BB18, 2, 0.003), kind=0)
    assert mc.onset(spark, model, relay.named("trivial"), 200, 1) == 1
    assert {x.w: x.t for x in mc.fixed_sampling(spark, model, relay.named("trivial"), {2: 30, 4: 10}, [2, 4], 1).collect()} == {2: 30, 4: 10}
