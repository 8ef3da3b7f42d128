"""Orbits, induced permutations, range joins and merges with sources against plain loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from raretide.operators import orbits, ranges


def _apply(m, columns):
    out = 0
    for i, c in enumerate(columns):
        if m >> i & 1:
            out ^= c
    return out


def _orbit(mask, maps):
    seen, todo = {mask}, [mask]
    while todo:
        m = todo.pop()
        for f in maps:
            if (x := _apply(m, f)) not in seen:
                seen.add(x)
                todo.append(x)
    return seen


def test_orbits_equal_a_search(spark):
    r = random.Random(1)
    maps = (orbits.permutation([(i + 1) % 9 for i in range(9)]), [1 << i for i in range(8)] + [1 << 8 | 1])
    masks = [r.randrange(1 << 9) for _ in range(40)] + [0, 0, None]
    table = spark.createDataFrame([(m, 1, 2) for m in masks], "mask long, root long, node long")
    out = {x.mask: (x.representative, x.size, x.present) for x in orbits.orbits(table, maps).collect()}
    given = set(masks) - {None}
    assert out == {m: (min(o := _orbit(m, maps)), len(o), len(o & given)) for m in given}
    assert orbits.orbits(table.limit(0), maps).count() == 0


def test_components_of_long_paths_and_stars(spark):
    """A path takes as many rounds as its length has bits; a hub is met by aggregates."""
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 500)] + [(2001, 2000), (2001, 2001), (7, 9)]
    nodes = [*range(201), *range(1000, 1500), 2000, 2001, 3000]
    out = {x.node: x.root for x in orbits.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {n: 0 if n < 201 else 1000 if n < 1500 else 2000 if n < 3000 else 3000 for n in nodes}
    shuffled = list(range(300))
    random.Random(2).shuffle(shuffled)
    path = list(zip(shuffled, shuffled[1:], strict=False))
    out = orbits.components(spark.range(300).select(F.col("id").alias("node")), spark.createDataFrame(path, "a long, b long")).collect()
    assert {x.root for x in out} == {0}


def _columns(spark, sets):
    return spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "col long, dets array<long>")


def test_permutations_of_a_ring(spark):
    shapes, n = [(0, 1), (0, 2, 5)], 12
    sets = [[(x + r) % n for x in s] for s in shapes for r in range(n)]
    moves = spark.createDataFrame([(s, d, (d + s) % n) for s in range(n) for d in range(n)], "shift long, det long, image long")
    out = orbits.column_permutations(_columns(spark, sets), moves).collect()
    place = {frozenset(s): i for i, s in enumerate(sets)}
    assert {(x.shift, x.col): x.image for x in out} == {(s, i): place[frozenset((d + s) % n for d in x)] for s in range(n) for i, x in enumerate(sets)}
    with pytest.raises(Exception, match="equal detectors"):
        orbits.column_permutations(_columns(spark, [*sets, sets[3][::-1]]), moves).collect()
    with pytest.raises(Exception, match="to no column"):
        orbits.column_permutations(_columns(spark, sets[:-1]), moves).collect()
    with pytest.raises(Exception, match="without an image"):
        orbits.column_permutations(_columns(spark, sets), moves.filter("NOT (shift = 3 AND det = 4)")).collect()


@pytest.mark.parametrize("width", [0.5, 3, 1000])
def test_range_join_equals_all_pairs(spark, width):
    r = random.Random(5)
    spans = [(i, a := r.uniform(-20, 20), a + r.uniform(-1, 9)) for i in range(60)] + [(90, None, 1.0), (91, 0.0, None), (92, 2.0, 2.0)]
    points = [(i, r.uniform(-25, 30)) for i in range(200)] + [(900, None)] + [(901 + i, s[1]) for i, s in enumerate(spans[:5])] + [(950 + i, s[2]) for i, s in enumerate(spans[:5])]
    out = ranges.range_join(spark.createDataFrame(points, "point long, x double"), "x", spark.createDataFrame(spans, "span long, lo double, hi double"), "lo", "hi", width)
    got = sorted((x.point, x.span) for x in out.collect())
    assert got == sorted((p, s) for p, x in points for s, lo, hi in spans if None not in (x, lo, hi) and lo <= x < hi)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_prefix_ranges(spark):
    r = random.Random(6)
    rows = [(k, r.randrange(1, 9)) for k in r.sample(range(5000), 300)]
    out = {x.mech: (x.low, x.high) for x in ranges.prefix_ranges(spark.createDataFrame(rows, "mech long, m long"), "mech", "m", 64).collect()}
    at, expected = 0, {}
    for k, m in sorted(rows):
        expected[k] = (at, at + m)
        at += m
    assert out == expected


def test_merges_name_their_first_sources(spark):
    r = random.Random(7)
    rows = [(r.choice([1, 2, None]), r.choice(["a", None]), r.choice([0.0, 0.1, 0.3, 0.7, None]), i % 400) for i in range(800)]
    rows += [(9, "hot", 0.001, i) for i in range(3000)] + [(8, "half", 0.5, 1), (8, "half", 0.2, 0)]
    out = ranges.merged_with_sources(spark.createDataFrame(rows, "det long, obs string, p double, seq long"), ["det", "obs"], "seq", "p", 4).collect()
    got = {(x.det, x.obs): x for x in out}
    for key in {(d, o) for d, o, _, _ in rows}:
        mine = [(p, s) for d, o, p, s in rows if (d, o) == key]
        odd = 0.0
        for p, _ in mine:
            odd = odd if p is None else odd * (1 - p) + p * (1 - odd)
        assert math.isclose(got[key].p, odd, abs_tol=1e-9) and got[key].merged == len(mine)
        assert got[key].sources == sorted(s for _, s in mine)[:4]
    assert len(got) == len({(d, o) for d, o, _, _ in rows})
