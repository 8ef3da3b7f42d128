"""Onset counting, distance searches and splitting against listing everything or a known law."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raretide.functions import gf2, relay
from raretide.operators import dem, memory, onset, replica
from raretide.operators import montecarlo as mc
from raretide.plans import catalogue, kernels, reports

catalogue.load()


def _toy(spark, n=9, seed=2):
    r = np.random.default_rng(seed)
    rows = [(i, int(r.integers(1, 8)), int(r.integers(0, 4)), int(r.integers(1, 4))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "mech long, det long, obs long, m long")


def _silent(rows, w):
    """Sets of w columns that no detector sees and some observable does."""
    out = []
    for s in itertools.combinations(rows, w):
        det, obs = 0, 0
        for _, d, o, _ in s:
            det, obs = det ^ d, obs ^ o
        if det == 0 and obs:
            out.append(sorted(x[0] for x in s))
    return out


def test_votes_without_listing_sets(spark):
    """Against listing, with columns of equal detectors, of equal classes too; repeated rows list no set twice."""
    for n, seed in ((9, 2), (14, 3), (18, 4), (3, 5)):
        rows, columns = _toy(spark, n, seed)
        four = _silent(rows, 4)
        by, classes = {r[0]: r for r in rows}, {}
        for a, b in {tuple(p) for s in four for p in itertools.combinations(s, 2)}:
            c = classes.setdefault(by[a][1] ^ by[b][1], {})
            c[by[a][2] ^ by[b][2]] = c.get(by[a][2] ^ by[b][2], 0) + by[a][3] * by[b][3]
        got = onset.voted_pairs(columns).first()
        assert (int(got.fails), got.logicals, got.expanded) == (sum(sum(c.values()) - max(c.values()) for c in classes.values()), len(four), sum(r[3] for r in rows))
        for sets in (onset.disjoint_halves(columns.union(columns), 4), dem.half_pairs(columns.union(columns))):
            assert sorted(list(x.members) for x in sets.collect()) == sorted(four)


def test_sets_are_made_once(spark):
    """No shuffle follows the join of pairs: 2,000 of 80 columns would have been shuffled thrice each."""
    columns = spark.range(80).select(F.col("id").alias("mech"), (F.col("id") * 37 % 64).alias("det"), (F.col("id") % 5).alias("obs"))
    plan = dem.half_pairs(columns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") <= 4 and "Aggregate" not in plan[: plan.index("Join")]


def test_no_pair_is_shuffled(spark):
    """The values of an XOR are; masks of more values, and negative ones, list the same sets."""
    columns = spark.range(60).select(F.col("id").alias("mech"), (F.col("id") * 37 % 64).alias("det"), (F.col("id") % 5).alias("obs"))
    plan = dem.half_pairs(columns)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning(s" in plan and "ENSURE_REQUIREMENTS" not in "".join(x for x in plan.splitlines() if "hashpartitioning(s" in x)
    for rows in ([(i, i * 37 % 32, i * i % 3, 1) for i in range(16)], [(i, (i * 37 % 8 - 4) << 58 | i * 5 % 4, i * i % 3, 1) for i in range(16)]):
        want = sorted(_silent(rows, 4))
        got = dem.half_pairs(spark.createDataFrame(rows, "mech long, det long, obs long, m long"))
        assert want and sorted(list(x.members) for x in got.collect()) == want
    assert dem.half_pairs(columns.limit(0)).count() == 0


def test_meeting_in_the_middle_and_votes(spark):
    rows, columns = _toy(spark)
    four = _silent(rows, 4)
    assert four and sorted(list(x.members) for x in onset.disjoint_halves(columns, 4).collect()) == sorted(four)
    two = sorted(list(x.members) for x in onset.disjoint_halves(columns, 2).collect())
    assert two == sorted(_silent(rows, 2))
    with pytest.raises(ValueError):
        onset.disjoint_halves(columns, 3)
    with pytest.raises(ValueError):
        onset.restrictions(spark.createDataFrame([(1, i) for i in range(20)], "config long, mech long"), 5, most=100)
    logicals = spark.createDataFrame([(k, m) for k, s in enumerate(four) for m in s], "config long, mech long")
    by = {r[0]: r for r in rows}
    classes = {}
    for a, b in {tuple(p) for s in four for p in itertools.combinations(s, 2)}:
        key = by[a][1] ^ by[b][1]
        classes.setdefault(key, {}).setdefault(by[a][2] ^ by[b][2], []).append(by[a][3] * by[b][3])
    want = sum(sum(map(sum, c.values())) - max(map(sum, c.values())) for c in classes.values())
    assert int(onset.fail_count(logicals, columns, 4).first().fails) == want
    three = _silent(rows, 3)
    odd = spark.createDataFrame([(k, m) for k, s in enumerate(three) for m in s], "config long, mech long")
    pairs = {tuple(p) for s in three for p in itertools.combinations(s, 2)}
    assert int(onset.fail_count(odd, columns, 3).first().fails) == sum(by[a][3] * by[b][3] for a, b in pairs)
    assert onset.log_fraction(10, 5, 2) == pytest.approx(0.0)


def test_distance_has_verified_witnesses(spark):
    model = mc.Model.of(spark, memory.memory_circuit(*kernels.BB18, 2, 0.003), kind=0)
    found = onset.forced_logicals(spark, model, range(1, 16)).collect()
    assert len(found) == 15
    for x in found:
        v = np.zeros(len(model.p), np.uint8)
        v[x.members] = 1
        assert not (model.h @ v % 2).any() and (model.observables @ v % 2)[[k for k in range(4) if x.mask >> k & 1]].sum() % 2 == 1
    exact = {x.w: x.logicals for x in catalogue.QUERIES["min_weight_logicals"](spark, "").collect()}
    lightest = min([w for w, n in exact.items() if n], default=4)
    got = catalogue.QUERIES["min_weight_distance"](spark, "").first()
    assert got.distance == min(x.weight for x in found) >= lightest and got.onset == (got.distance + 1) // 2
    assert got.distance <= 4  # the code's own distance
    for k, v in enumerate(onset.unit_actions(model)):
        assert v is not None and not (model.h @ v % 2).any() and (model.observables @ v % 2).tolist() == [int(i == k) for i in range(4)]


def test_pairs_of_logicals(spark):
    hx, hz = kernels.bb6(spark)
    x, z = gf2.paired_logicals(hx, hz)
    assert x.shape == z.shape == (12, 72) and np.array_equal(x.astype(int) @ z.T % 2, np.eye(12))
    assert not (hz.astype(int) @ x.T % 2).any() and not (hx.astype(int) @ z.T % 2).any()
    assert {(r.shift, r["order"], r.symplectic) for r in catalogue.QUERIES["shift_actions"](spark, "").collect()} == {("x", 6, True), ("y", 6, True)}
    weights = {r.weight: r.logicals for r in catalogue.QUERIES["light_logicals"](spark, "").collect()}
    assert min(weights) == 4 and sum(weights.values()) == 2**11 - 2**7


def test_chains_keep_to_a_known_law(spark):
    """Failing means all of the first three of ten columns: P(q) = q ** 3."""
    fails = _first_three
    start = np.zeros(10, np.uint8)
    start[:3] = 1
    rates = [0.3, 0.2, 0.12]
    seeds = np.repeat(start[None], 8, axis=0)
    got = replica.multi_seeded(spark, 10, fails, seeds, rates, 4, 400, 3).orderBy("level").collect()
    assert got[-1].log_total == pytest.approx(3 * math.log(0.12 / 0.3), abs=0.2)
    again = replica.replica_exchange(spark, 10, fails, start, rates, 6, 120, 10, 5).orderBy("level").collect()
    assert again[-1].log_total == pytest.approx(3 * math.log(0.12 / 0.3), abs=0.25)
    assert all(0 < x.swaps <= 1 and x.lightest == 3 for x in again)
    r = np.random.default_rng(1)
    for balanced in (True, False):
        x = np.repeat(start[None], 40, axis=0)
        w = replica.advance(x, np.full(40, 0.25), 1500, fails, r, balanced)[300:]
        assert w.mean() == pytest.approx(3 + 7 * 0.25, abs=0.12) and fails(x).all()
    full = np.ones((5, 10), np.uint8)
    assert np.array_equal(replica.strip(full, fails, r), np.repeat(start[None], 5, axis=0))


def _first_three(rows):
    return rows[:, :3].all(1)


def test_splitting_over_a_decoder(spark, sf_dir):
    for name in ("splitting_over_decoder", "tempering_over_decoder"):
        rows = catalogue.QUERIES[name](spark, sf_dir).orderBy("level").collect()
        assert len(rows) == 2 and all(x.log_ratio < 0 for x in rows) and rows[1].log_total == pytest.approx(rows[0].log_ratio + rows[1].log_ratio)


def test_exact_intervals_cover_the_rate(spark, sf_dir):
    for x in catalogue.QUERIES["exact_intervals"](spark, sf_dir).collect():
        assert 0 <= x.low <= x.f / x.t <= x.high <= 1


def test_first_existing(spark):
    wanted = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "name string, priority int, path string")
    found = spark.createDataFrame([("y",), ("w",)], "path string")
    assert [tuple(r) for r in reports.first_existing(wanted, found).collect()] == [("a", "y")]
    kinds = spark.createDataFrame([("memory", 6, 7), ("lpu_idle", None, 7), ("lpu_x1", 3, 7), ("automorphism", None, 7)], "e string, r int, c int")
    assert [r.n for r in kinds.select(reports.cycles_of(F.col("e"), F.col("r"), F.col("c")).alias("n")).collect()] == [6, 12, 7, 7]
