"""Layout graphs and study runs against plain Python."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from raretide.operators import layout as L
from raretide.operators import runner


def _graph(spark, n, chance, seed):
    r = np.random.default_rng(seed)
    pairs = [(a, b) for a, b in itertools.combinations(range(n), 2) if r.random() < chance]
    return pairs, L.numbered(spark.createDataFrame([(0, b, a) for a, b in pairs] + [(0, 3, 3)], "graph int, a long, b long"))


@pytest.mark.parametrize("chance", [0.08, 0.3])
def test_trees_and_cycles(spark, chance):
    pairs, edges = _graph(spark, 16, chance, 4)
    trees = L.spanning_trees(edges)
    cycles = {r.edge: r.cycle for r in L.cycle_basis(edges, trees).collect()}
    [size] = L.sizes(edges, trees).collect()
    assert size.edges == len(pairs) and size.cycles == len(cycles) == size.edges - size.vertices + size.components
    for edge, cycle in cycles.items():
        seen = np.bincount([v for e in cycle for v in pairs[e]], minlength=16)
        assert edge in cycle and set(seen) <= {0, 2} and len(set(cycle)) == len(cycle)
    for t in trees.collect():
        assert len(t.path) == t.level and (t.level == 0) == (t.parent is None)
        odd = np.flatnonzero(np.bincount([v for e in t.path for v in pairs[e]], minlength=16) % 2)
        assert list(odd) == ([] if t.level == 0 else sorted((t.root, t.vertex)))


def test_empty_graph(spark):
    edges = L.numbered(spark.createDataFrame([], "graph int, a long, b long"))
    trees = L.spanning_trees(edges)
    assert not trees.collect() and not L.cycle_basis(edges, trees).collect() and not L.incident(edges).collect()


@pytest.mark.parametrize("beside", [True, False])
def test_covering_paths_are_all_of_them(spark, beside):
    pairs, edges = _graph(spark, 7, 0.6, 1)
    near = {*pairs, *((b, a) for a, b in pairs)}
    want = [list(p) for p in itertools.permutations([0, 1, 3, 4, 5, 6]) if all(s in near for s in itertools.pairwise(p)) and (not beside or (2, p[0]) in near)]
    assert sorted(r.path for r in L.covering_paths(edges, 7, F.lit(2), beside).collect()) == want and want


def test_ladder_is_closed_and_steps_on_edges(spark):
    row = spark.sql("SELECT array(1, 2, 3) AS top, array(11, 12, 13) AS bottom")
    [walks] = row.select(L.ladder(F.col("top"), F.col("bottom"), F.lit(0))).first()
    assert walks == [[1, 2, 12, 11, 1], [2, 3, 13, 12, 2], [0, 1, 11, 0]]
    edges = L.numbered(spark.createDataFrame([(0, 1, 2), (0, 2, 12), (0, 12, 11)], "graph int, a long, b long"))
    steps = L.walk_edges(spark.createDataFrame([(0, 0, i, v) for i, v in enumerate(walks[0])], "graph int, walk int, place int, v long"), edges)
    assert {(r.v, r.to): r.edge for r in steps.collect()} == {(1, 2): 0, (2, 12): 1, (12, 11): 2, (11, 1): None}


def test_status_ignores_the_order_of_keys(spark):
    tasks = lambda rows: spark.createDataFrame(rows, "task string, config map<string,string>")
    wants = tasks([("a", {"x": "1", "y": "2"}), ("b", {"x": "1"}), ("c", {"x": "1"}), ("d1", {"x": "1"}), ("e", {"x": None})])
    had = tasks([("a", {"y": "2", "x": "1"}), ("b", {"x": "2"}), ("d1", {"x": "1"}), ("e", {})])
    assert dict(runner.status(wants, had, "d").collect()) == {"a": "cached", "b": "stale", "c": "missing", "d1": "forced", "e": "stale"}


def test_clone_drops_and_changes(spark):
    parents = spark.createDataFrame([("p", {"label": "p", "weights": "1", "rounds": "3", "fast": "no"})], "name string, config map<string,string>")
    variants = spark.createDataFrame([("iso_z", {"fast": "yes", "noise_channel": "z"})], "variant string, changes map<string,string>")
    [r] = runner.clones(parents, variants, ["weights"]).collect()
    assert r.name == "p__iso_z" and r.config == {"label": "p__iso_z", "rounds": "3", "fast": "yes", "noise_channel": "z"}


def test_sweep_resumes(spark, tmp_path):
    folder, asked = str(tmp_path / "bins"), []

    def sample(todo):
        asked.append(sorted(r.w for r in todo.collect()))
        return todo.select("w", F.lit(10).alias("t"), F.col("w").alias("f"))

    plan = lambda ws: spark.createDataFrame([(w,) for w in ws], "w int")
    first = runner.resumed_sweep(spark, folder, {"seed": "1"}, plan([1, 2, 2]), sample)
    assert sorted(tuple(r) for r in first.collect()) == [(1, 10, 1), (2, 10, 2)]
    runner.resumed_sweep(spark, folder, {"seed": "1"}, plan([2, 3]), sample)
    again = runner.resumed_sweep(spark, folder, {"seed": "1"}, plan([1, 2, 3]), sample)
    assert asked == [[1, 2], [3]] and sorted(r.w for r in again.collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="another configuration"):
        runner.resumed_sweep(spark, folder, {"seed": "2"}, plan([1]), sample)
