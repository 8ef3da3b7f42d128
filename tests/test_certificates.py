"""Layout rules one by one on a sound layout, empty and null rows; portfolios on a small library; fits with errors."""

from __future__ import annotations

import numpy as np
import pytest

from raretide.operators import certify, fit, library

#: Vertices 0 (the hub) to 3: checks 10 and 11 link 0-1-2 and 1-3, so that 1 would gap to 3 only through an edge.
SOUND = {
    "inc": [("g", 10, 0), ("g", 10, 1), ("g", 10, 2), ("g", 11, 2), ("g", 11, 3)],
    "edges": [("g", 0, 1), ("g", 2, 1), ("g", 0, 2), ("g", 2, 3)],
    "hubs": [("g", 0)],
    "rungs": [("g", 0, 1), ("g", 1, 2), ("g", 2, 3)],
    "cycles": [("g", "c", 0, 0), ("g", "c", 1, 1), ("g", "c", 2, 2), ("g", "c", 3, 0)],
}
KINDS = {"inc": "graph string, check long, v long", "edges": "graph string, a long, b long", "hubs": "graph string, hub long", "rungs": "graph string, place long, v long", "cycles": "graph string, cycle string, place long, v long"}


def _tables(spark, **changed):
    return [spark.createDataFrame((SOUND | changed)[k], kind) for k, kind in KINDS.items()]


def _broken(spark, **changed):
    return sorted(map(tuple, certify.violations(*_tables(spark, **changed)).collect()))


def test_sound_layout_breaks_nothing(spark):
    assert _broken(spark) == []


def test_nulls_and_repeats_say_nothing(spark):
    odd = {k: [*rows, rows[0], tuple([None] * len(rows[0])), (*rows[0][:-1], None)] for k, rows in SOUND.items()}
    assert _broken(spark, **odd) == []
    assert _broken(spark, **{k: [] for k in SOUND}) == []


@pytest.mark.parametrize(
    ("changed", "found"),
    [
        ({"edges": [*SOUND["edges"], ("g", 1, 3)]}, [("g", "edge_without_check", 1, 3)]),
        ({"edges": SOUND["edges"][:2] + SOUND["edges"][3:]}, [("g", "check_not_linked", 10, 1), ("g", "step_without_edge", 2, 0)]),
        ({"rungs": SOUND["rungs"][:2]}, [("g", "off_bridge", 3, -1)]),
        ({"rungs": [*SOUND["rungs"], ("g", 3, 2)]}, [("g", "twice_on_bridge", 2, 2)]),
        ({"rungs": [("g", 0, 1), ("g", 1, 0), ("g", 2, 2), ("g", 3, 3)]}, [("g", "not_for_bridge", 0, -1)]),
        ({"rungs": [("g", 0, 2), ("g", 1, 1), ("g", 2, 3)]}, [("g", "bridge_gap", 1, 3)]),
        ({"rungs": [("g", 0, 3), ("g", 1, 2), ("g", 2, 1)]}, [("g", "open_triangle", 0, 3)]),
        ({"cycles": SOUND["cycles"][:3]}, [("g", "open_cycle", 0, 2)]),
    ],
)
def test_each_rule(spark, changed, found):
    assert _broken(spark, **changed) == found


def test_census_counts_layouts_by_their_reasons(spark):
    both = {k: rows + [("h", *r[1:]) for r in rows] for k, rows in SOUND.items()}
    both["rungs"] = both["rungs"][:-1]
    parts = _tables(spark, **both)
    assert sorted(map(tuple, certify.census(certify.violations(*parts), parts[0]).collect())) == [("", 1), ("off_bridge", 1)]


def test_portfolios(spark):
    rows = [  # shot, weight, truth, member, valid, score, answer
        (1, 5, "F", 1, True, 2.0, "O"),
        (1, 5, "F", 2, True, 1.0, "F"),
        (2, 4, "F", 1, False, 9.0, "O"),
        (2, 4, "F", 2, True, 1.0, "F"),
        (3, 3, "F", 1, False, 1.0, "F"),
        (3, 3, "F", 2, False, 2.0, "O"),
        (4, 2, "F", 2, True, 1.0, None),
        (5, 1, None, 9, True, 1.0, "F"),
    ]
    answers = spark.createDataFrame(rows, "shot long, weight long, truth string, member int, valid boolean, score double, answer string")
    combos = spark.createDataFrame([("both", 1), ("both", 2), ("first", 1)], "portfolio string, member int")
    assert sorted(map(tuple, library.portfolios(answers, combos).collect())) == [("both", 4, 2, 2, 3), ("first", 3, 1, 4, 1)]
    assert library.portfolios(answers.limit(0), combos).collect() == []


def test_fit_errors_shrink_with_the_trials_and_hold_the_truth(spark):
    w = np.arange(4, 30)
    rows = []
    for group, trials in (("few", 10**4), ("many", 10**6)):
        f = np.random.default_rng(5).binomial(trials, fit.three_parameter(w, 4, 0.01, 2.5, 0.5))
        rows += [(group, int(x), trials, int(y), 4, 0.01) for x, y in zip(w, f)]
        rows += [(group + " free", int(x), trials, int(y), 4, None) for x, y in zip(w, f)]
    rows += [("short", 4, 10, 1, 4, None), ("none", 4, 10, 0, None, None)]
    spec = spark.createDataFrame(rows, "run string, w long, t long, f long, w0 long, f0 double")
    got = {r.run: r for r in fit.fit_with_errors(spec, ["run"]).collect()}
    for name in ("few", "many", "few free", "many free"):
        assert abs(got[name].gamma - 2.5) < 4 * got[name].gamma_se
    assert got["many"].gamma_se < got["few"].gamma_se / 5
    assert got["many"].f0 == 0.01 and got["many"].f0_se is None and got["many free"].f0_se > 0
    assert got["many"].gamma_se < got["many free"].gamma_se
    assert got["short"].error and got["short"].gamma is None and got["none"].error == "no onset"


def test_covariance_is_that_of_the_linear_problem():
    w = np.arange(5, 25)
    t = np.full(len(w), 10**5)
    f = np.maximum(1, np.round(t * fit.three_parameter(w, 4, 0.01, 2.0, 0.5) * (1 + 0.01 * np.cos(w)))).astype(int)
    at = {"f0": 0.01, "gamma": 2.0, "a": 0.5}
    cov = fit.errors_of(at, w, t, f, 4, ("gamma",))
    rate, x = f / t, 2.0
    power = (w / 4) ** x
    slope = 0.01 * power * np.log(w / 4) * np.exp(-0.02 * power) / fit.three_parameter(w, 4, 0.01, x, 0.5)  # d ln(curve) / d gamma
    sigma = np.sqrt((1 - rate) / f)
    r = (np.log(fit.three_parameter(w, 4, 0.01, x, 0.5)) - np.log(rate)) / sigma
    assert np.isclose(cov[0, 0], r @ r / (len(w) - 1) / ((slope / sigma) @ (slope / sigma)), rtol=1e-6)
    assert fit.errors_of(at, w[:1], t[:1], f[:1], 4, ("gamma",)) is None


def test_layouts_are_shuffled_once(spark):
    found = certify.violations(*_tables(spark, cycles=[*SOUND["cycles"], ("g", "d", 0, 1), ("g", "d", 1, 1)]))
    assert found.collect() == []
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1
    # one told rule for each place where it is broken
    gaps = certify.violations(*_tables(spark, rungs=[("g", 0, 1), ("g", 1, 3), ("g", 2, 1), ("g", 3, 3), ("g", 4, 2)]))
    assert sorted(map(tuple, gaps.filter("rule = 'bridge_gap'").collect())) == [("g", "bridge_gap", 1, 3)] * 2 + [("g", "bridge_gap", 3, 1)]
