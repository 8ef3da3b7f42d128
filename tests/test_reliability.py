"""The reliability operators against closed forms, brute force and known values."""

from __future__ import annotations

import itertools
import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from raretide.functions import gf2
from raretide.functions.decoders import BpOsd, ensemble
from raretide.functions.numeric import log_factorials
from raretide.operators import codes, decode, dem, fit, memory, splitting
from raretide.operators import spectrum as S
from raretide.plans import catalogue, kernels
from raretide.sources import artifacts

catalogue.load()


def spec(spark, rows):
    return spark.createDataFrame(rows, "w int, t long, f long")


def grid(spark, *p):
    return spark.createDataFrame([(x,) for x in p], "p double")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = catalogue.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    text = lambda v: "%.8g" % v if isinstance(v, float) or hasattr(v, "quantize") else str(v)
    rows = sorted(tuple(text(v) for v in r) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(text(v) for v in r) for r in want.fetchall())


def test_flat_spectrum_has_a_closed_form(spark):
    f, n, q = 0.3, 60, 0.05
    flat = spec(spark, [(w, 100000, int(100000 * f)) for w in range(1, n + 1)])
    got = S.reweight(flat, grid(spark, q), n).first()
    assert got.ler == pytest.approx(f * (1 - (1 - q) ** n), rel=1e-9)
    strided = flat.filter("w <= 5 OR w % 2 = 0")
    assert S.reweight(S.fill(strided), grid(spark, 0.4), n).first().ler == pytest.approx(f * (1 - 0.6**n), rel=1e-9)


def test_fill_pools_neighbours_and_legacy_fills_single_gaps(spark):
    s = spec(spark, [(1, 10, 1), (3, 20, 4), (7, 40, 8)])
    assert sorted(map(tuple, S.fill(s).collect())) == [(1, 10, 1), (2, 30, 5), (3, 20, 4), (4, 60, 12), (5, 60, 12), (6, 60, 12), (7, 40, 8)]
    assert sorted(r.w for r in S.fill(s, only_gap=2).collect()) == [1, 2, 3, 7]


def test_pool_refuses_different_constants(spark):
    a = spec(spark, [(1, 10, 1)])
    with pytest.raises(ValueError, match="differ"):
        S.pool(a, a, constants=[(10, 1.0, 1.0), (11, 1.0, 1.0)])


def test_headroom_counts_bins_without_failures(spark):
    s = spec(spark, [(1, 100, 0), (2, 2, 0), (3, 50, 5)])
    n, p = 10, 0.1
    got = S.with_headroom(s, grid(spark, p), n).first()
    b = lambda w: math.comb(n, w) * p**w * (1 - p) ** (n - w)
    assert got.headroom == pytest.approx(3 / 100 * b(1) + 1.0 * b(2), rel=1e-9)
    assert got.ler == pytest.approx(0.1 * b(3), rel=1e-9)


def test_crossing_is_the_last_one_or_null(spark):
    curve = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 3.0, 2.0), (4.0, 1.0, 2.0), (8.0, 4.0, 2.0)], "p double, y1 double, y2 double")
    assert 4 < S.crossing(curve).first().crossing < 8
    assert S.crossing(curve.filter("p > 4")).first().crossing is None


def test_log_factorials(spark):
    rows = log_factorials(spark, 50).collect()
    assert all(r.lf == pytest.approx(math.lgamma(r.k + 1), abs=1e-9) for r in rows) and len(rows) == 51


def test_multiplicities_round_half_to_even(spark):
    m = spark.createDataFrame([(1, 1.0), (2, 2.5), (3, 3.5), (4, 0.2)], "mech long, p double")
    assert {r.mech: r.m for r in dem.multiplicities(m, 1.0).collect()} == {1: 1, 2: 2, 3: 4, 4: 1}


def test_half_pairs_and_votes_by_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(32), r.randrange(4)) for i in range(14)]
    got = {tuple(x.members) for x in dem.half_pairs(spark.createDataFrame(rows, "mech long, det long, obs long")).collect()}
    want = set()
    for c in itertools.combinations(rows, 4):
        d = o = 0
        for _, x, y in c:
            d, o = d ^ x, o ^ y
        if d == 0 and o != 0:
            want.add(tuple(x[0] for x in c))
    assert got == want
    classes = [(r.randrange(9), r.randrange(3), r.randrange(1, 5)) for _ in range(60)]
    total = {}
    for s, t, n in classes:
        total.setdefault(s, {}).setdefault(t, 0)
        total[s][t] += n
    fails = dem.class_votes(spark.createDataFrame(classes, "syndrome long, truth long, rho long")).agg(F.sum("fails")).first()[0]
    assert fails == sum(sum(v.values()) - max(v.values()) for v in total.values())


def test_sector_merge_follows_odd_parity(spark):
    rows = [(1, 0.1, 3, 1), (2, 0.2, 19, 1), (3, 0.3, 16, 0), (4, 0.5, 3, 0)]
    got = {(x.det, x.obs): (x.p, x.merged) for x in dem.sector(spark.createDataFrame(rows, "mech long, p double, det long, obs long"), 15).collect()}
    assert got[3, 1] == (pytest.approx(0.1 * 0.8 + 0.2 * 0.9), 2) and got[3, 0] == (pytest.approx(0.5), 1) and len(got) == 2


def test_code_has_twelve_logical_qubits_and_commutes(spark):
    hx, hz = kernels.bb6(spark)
    assert not (hx.astype(int) @ hz.T % 2).any()
    assert 72 - gf2.rank(hx) - gf2.rank(hz) == 12 == len(gf2.logicals(hx, hz))
    assert codes.odd_overlaps(codes.parity_checks(spark, *kernels.BB6)).count() == 0


def test_gf2_kernels():
    r = np.random.RandomState(0)
    for _ in range(30):
        a = r.randint(0, 2, (r.randint(1, 9), r.randint(1, 9))).astype(np.uint8)
        k = gf2.kernel(a)
        assert len(k) == a.shape[1] - gf2.rank(a) and not (a @ k.T % 2).any()
        b = a @ r.randint(0, 2, a.shape[1]) % 2
        assert np.array_equal(a @ gf2.solve(a, b) % 2, b)
        s = r.randint(0, 2, (5, 5)).astype(np.uint8)
        i = gf2.inverse(s)
        assert (i is None) == (gf2.rank(s) < 5) and (i is None or np.array_equal(s @ i % 2, np.eye(5)))


def test_decoders_meet_every_syndrome_and_correct_light_faults(spark):
    hx, hz = kernels.bb6(spark)
    r = np.random.RandomState(1)
    one, many = BpOsd(hx, np.full(72, 0.02)), ensemble(hx, np.full(72, 0.02), 3, 5)
    logical = gf2.logicals(hz, hx)
    for w in (1, 2, 2, 5, 9):
        e = np.zeros(72, np.uint8)
        e[r.choice(72, w, replace=False)] = 1
        for x in (one(hx @ e % 2), many(hx @ e % 2)[0]):
            assert np.array_equal(hx @ x % 2, hx @ e % 2)
            if w <= 2:  # below half the distance
                assert not (logical @ (x ^ e) % 2).any()


def test_decoding_query_corrects_what_the_distance_allows(spark, sf_dir):
    got = {x.w: (x.t, x.f) for x in catalogue.QUERIES["bp_osd_decode"](spark, sf_dir).collect()}
    assert set(got) == set(range(1, 9)) and all(t == 200 for t, _ in got.values())
    assert got[1][1] == got[2][1] == 0 and got[8][1] > got[3][1]


def test_decoding_of_all_shots(spark, sf_dir):
    """Every weight of lineitem, with as many shots as it has rows."""
    want = {int(x.l_quantity): x["count"] for x in spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_quantity").count().collect()}
    got = {x.w: (x.t, x.f) for x in catalogue.QUERIES["bp_osd_decode_all"](spark, sf_dir).collect()}
    assert {w: t for w, (t, _) in got.items()} == want and len(want) == 50
    assert got[1][1] == got[2][1] == 0 and got[8][1] > 0


def test_batches_of_shots_count_what_rows_of_shots_do(spark):
    """More than one block of a weight, decoded in batches, against the shots as rows and one syndrome at a time."""
    hx, hz = kernels.bb6(spark)
    priors, logical = np.full(72, 0.02), gf2.logicals(hz, hx)
    plan = spark.createDataFrame([(0, 5), (2, 40), (6, decode.BLOCK + 30), (30, 25)], "w int, shots long")
    got = {x.w: (x.t, x.f) for x in decode.spectrum_of_weights(spark, plan, hx, priors, logical, 11).collect()}
    one, want = BpOsd(hx, priors), {}
    for w, n in ((2, 40), (6, decode.BLOCK + 30), (30, 25)):
        faults = np.zeros((n, 72), np.uint8)
        for r in decode.shots_of_weight(spark, plan.filter(f"w = {w}"), 72, 11).collect():
            faults[r.shot, r.column] = 1
        fixed = np.array([one(s) for s in faults @ hx.T % 2]) if n < 100 else one.many(faults @ hx.T % 2)
        assert np.array_equal(fixed @ hx.T % 2, faults @ hx.T % 2)
        want[w] = (n, int(((fixed ^ faults) @ logical.T % 2).any(1).sum()))
    assert got == want


def test_shots_have_their_weight_and_repeat(spark):
    plan = spark.createDataFrame([(0, 5), (3, 20), (10, 20)], "w int, shots long")
    first = decode.shots_of_weight(spark, plan, 30, 4)
    sizes = first.groupBy("w", "shot").agg(F.countDistinct("column").alias("n"), F.count("*").alias("m")).collect()
    assert len(sizes) == 40 and all(x.n == x.w == x.m for x in sizes)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, decode.shots_of_weight(spark, plan.repartition(3), 30, 4).collect()))
    mean = decode.bernoulli_shots(spark, 400, 50, 0.1, 2).count() / 400
    assert abs(mean - 5) < 0.6


def test_fit_recovers_the_spectrum_it_was_drawn_from(spark):
    r, w = np.random.RandomState(0), np.arange(5, 31)
    f = r.binomial(200000, fit.three_parameter(w, 5, 1e-2, 4, 0.5))
    got = fit.fit_three(w, np.full(len(w), 200000), f, 5)
    assert got["error"] is None and got["f0"] == pytest.approx(1e-2, rel=0.15) and got["gamma"] == pytest.approx(4, rel=0.15) and got["a"] == pytest.approx(0.5, rel=0.15)
    assert fit.fit_three(w, np.full(len(w), 10), np.zeros(len(w)), 5)["error"]
    rows = spec(spark, [(int(a), 200000, int(b)) for a, b in zip(w, f, strict=True)])
    band = fit.bootstrap(rows, [1e-3, 1e-2], 200, 5.0, 20, 1).collect()
    assert len(band) == 2 and all(x.lo <= x.mid <= x.hi for x in band)


def test_splitting_finds_a_known_law(spark):
    rates = [0.3, 0.2, 0.13]
    got = splitting.ladder(spark, 12, splitting.first_four, np.ones(12, np.uint8), rates, 16, 4000, 5).orderBy("level").collect()
    assert got[-1].log_total == pytest.approx(4 * math.log(rates[-1] / rates[0]), abs=0.25)
    same = splitting.ladder(spark, 12, splitting.first_four, np.ones(12, np.uint8), [0.2, 0.2], 2, 50, 1).first()
    assert same.log_ratio == pytest.approx(0)


def test_bennett_of_gaussians(spark):
    r = np.random.RandomState(2)
    # u = E1 - E0 of two unit Gaussians at 0 and 1 with equal volume: the ratio is 1
    u = lambda x: 0.5 * ((x - 1) ** 2 - x**2)
    forward = spark.createDataFrame([(float(v),) for v in u(r.normal(0, 1, 4000))], "u double")
    backward = spark.createDataFrame([(float(v),) for v in u(r.normal(1, 1, 4000))], "u double")
    assert splitting.bennett(forward, backward, 5) == pytest.approx(0, abs=0.1)


def test_artifacts(spark, tmp_path):
    run = tmp_path / "run7"
    run.mkdir()
    (run / "spectrum.json").write_text(json.dumps({"n_expanded": 9, "q_base": 0.1, "p_ref": 0.2, "shots_per_weight": 100, "trials_by_weight": {"4": 30}, "weights_plan": [3, 4, 2, 5], "failures_by_weight": {"2": 1, "3": 7, "4": 30}, "note": "dropped"}))
    got = [(x.run, x.w, x.t, x.f) for x in artifacts.spectra(spark, f"{tmp_path}/*/spectrum.json").orderBy("place").collect()]
    assert got == [("run7", 3, 100, 7), ("run7", 4, 30, 30), ("run7", 2, 100, 1)]
    assert artifacts.progress(spark, f"{tmp_path}/*/spectrum.json").first().fraction == 0.75
    t = spark.createDataFrame([("2-5, 9,4",), ("3..6",)], "s string").select(artifacts.number_list(F.col("s")).alias("n")).collect()
    assert [x.n for x in t] == [[2, 3, 4, 5, 9], [3, 4, 5, 6]]
    b = artifacts.budgets(spark.createDataFrame([("1-3:100,2:500",)], "s string"), "s").collect()
    assert {x.w: x.t for x in b} == {1: 100, 2: 500, 3: 100}
    lines = spark.createDataFrame([("trial 12/4095: 7 found",), ("noise",)], "value string")
    assert [tuple(x) for x in artifacts.progress_lines(lines).collect()] == [(12, 7)]
    g = [x.p for x in artifacts.log_grid(spark, 1e-4, 1e-2, 3).collect()]
    assert g == pytest.approx([1e-4, 1e-3, 1e-2])


def test_memory_circuit_has_the_known_mechanisms(spark, sf_dir):
    got = {x.channel: x.mechanisms for x in catalogue.QUERIES["mechanism_counts"](spark, sf_dir).collect()}
    assert got == {"full": 1062, "cz": 1062, "meas": 45, "prep": 45, "gate_idle": 72, "meas_idle": 72}
    q = memory.components("DEPOLARIZE2", [0, 1], 0.003)
    assert len(q) == 15 and q[0][0] == pytest.approx(0.00020028056129117733, rel=1e-12)


def test_min_weight_logicals_by_brute_force(spark, sf_dir):
    circuit = memory.memory_circuit(*kernels.BB18, 2, 0.003)
    columns = memory.masks(memory.mechanisms(spark, circuit), [i for i, k in enumerate(circuit.kinds) if k == 0]).collect()
    d, o = (np.array([r[c] for r in columns]) for c in ("det", "obs"))
    want = 0
    for i in range(len(d)):
        rest = np.arange(i + 1, len(d))
        x, y = d[rest] ^ d[i], o[rest] ^ o[i]
        for k in range(len(rest)):
            hit = (x[k] == d[rest[k] + 1 :]) & (y[k] != o[rest[k] + 1 :])
            want += int(hit.sum())
    got = {r.w: r.logicals for r in catalogue.QUERIES["min_weight_logicals"](spark, sf_dir).collect()}
    assert got == {1: 0, 2: 0, 3: want}


def test_circuit_spectrum_rises_with_weight(spark, sf_dir):
    got = {x.w: x.f / x.t for x in catalogue.QUERIES["circuit_spectrum"](spark, sf_dir).collect()}
    assert got[1] == 0 and got[8] > got[2]
