"""Libraries of specimens and stored results."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from raretide.operators import fit
from raretide.operators import library as L
from raretide.sources import results


def test_neighbours_move_one_key(spark):
    settings = spark.createDataFrame([("a", {"x": 4.0, "y": 1.0})], "name string, config map<string,double>")
    moves = spark.createDataFrame([("x", 2.0, 0.0), ("x", 1.0, 4.0), ("y", 1.0, -1.0), ("y", 1.0, 0.0), ("z", 2.0, 0.0)], "key string, factor double, plus double")
    assert [(r.key, r.value, r.config) for r in L.neighbours(settings, moves).collect()] == [("x", 8.0, {"x": 8.0, "y": 1.0})]


def test_strata(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 20).alias("w"))
    drawn = L.strata(rows, "w", "id").collect()
    per = {s: sum(r.stratum == s for r in drawn) for s in range(10)}
    assert per == {s: 25 for s in range(9)} | {9: 60}
    assert {r.of for r in drawn if r.stratum == 9} == {550}
    again = L.strata(rows.repartition(7), "w", "id").collect()
    assert {r.id for r in drawn} == {r.id for r in again}


def test_fold_adds_failing_specimens_once(spark):
    have = spark.createDataFrame([([3, 1], 5, "a"), ([1, 3], 2, "b")], "mechs array<long>, iteration long, generator string")
    new = spark.createDataFrame([([1, 3], 1, "c", True), ([2, 4], 9, "d", True), ([4, 2], 8, None, True), ([7], 3, "e", False), ([8], 3, "e", None)], "mechs array<long>, iteration long, generator string, fails boolean")
    out = {r.name: (r.iteration, r.generator, r.added) for r in L.fold(have, new).collect()}
    assert out == {"1,3": (2, "b", False), "2,4": (8, None, True)}


def test_arrays_survive_a_write(spark, tmp_path):
    rows = spark.createDataFrame([("a", [0.1, 0.2], [1, 2, 3]), ("b", [], None)], "run string, p array<double>, w array<long>")
    results.write_arrays(rows, f"{tmp_path}/r")
    back = results.read_arrays(spark, f"{tmp_path}/r", "run").collect()
    assert sorted((r.run, r.name, r.place, r.value) for r in back) == [("a", "p", 0, 0.1), ("a", "p", 1, 0.2), ("a", "w", 0, 1.0), ("a", "w", 1, 2.0), ("a", "w", 2, 3.0)]


def test_run_parts(spark, tmp_path):
    for run, parts in (("one", ("config", "spectrum", "onset")), ("two", ("config", "spectrum"))):
        (tmp_path / run).mkdir()
        for p in parts:
            (tmp_path / run / f"{p}.json").write_text(json.dumps({"of": run, "part": p}))
    got = {r.run: r for r in results.run_parts(spark, str(tmp_path)).collect()}
    assert json.loads(got["one"].onset) == {"of": "one", "part": "onset"} and got["two"].onset is None and got["two"].splitting is None
    (tmp_path / "three").mkdir()
    (tmp_path / "three" / "config.json").write_text("{}")
    with pytest.raises(PySparkException, match="run three lacks spectrum"):
        results.run_parts(spark, str(tmp_path)).collect()


def test_folder_of_a_run_has_one_channel(spark):
    rows = spark.createDataFrame([("r", "idle", "cz")], "base string, iso string, abl string")
    with pytest.raises(PySparkException, match="not both"):
        rows.select(results.output_folder(F.col("base"), F.col("iso"), F.col("abl"))).collect()


def test_pinned_fit():
    r, w = np.random.RandomState(1), np.arange(5, 31)
    t = np.full(len(w), 200000)
    got = fit.fit_pinned(w, t, r.binomial(t, fit.three_parameter(w, 5, 1e-2, 4, 0.5)), 5, 1e-2)
    assert got["error"] is None and abs(got["gamma"] - 4) < 5 * got["gamma_se"] < 0.1
    assert fit.fit_pinned(w, t, np.zeros(len(w)), 5, 1e-2)["error"]
