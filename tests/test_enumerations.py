"""Enumerations against plain loops over all combinations."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from raretide.operators import enumeration, subsets


def _logicals(columns, weight):
    """members -> (act, expanded) of closed, observable, irreducible sets of classes."""
    classes = {}
    for mech, dets, obs in columns:
        odd = frozenset(d for d, n in Counter(dets or ()).items() if n % 2)
        if odd:
            classes.setdefault((odd, obs), []).append(mech)
    rows = [(min(m), odd, obs, len(m)) for (odd, obs), m in classes.items()]

    def open_of(chosen):
        out = frozenset()
        for c in chosen:
            out ^= c[1]
        return out

    found = {}
    for chosen in itertools.combinations(rows, weight):
        act = 0
        for c in chosen:
            act ^= c[2]
        if act and not open_of(chosen) and all(open_of(p) for n in range(1, weight) for p in itertools.combinations(chosen, n)):
            found[tuple(sorted(c[0] for c in chosen))] = (act, float(math.prod(c[3] for c in chosen)))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_anchored_equals_all_combinations(spark, monkeypatch, seed):
    monkeypatch.setattr(enumeration, "SLICE", 3)
    r = random.Random(seed)
    columns = [(i, [r.randrange(6) if r.random() < 0.7 else 0 for _ in range(r.choice([1, 2, 2, 3]))], r.randrange(4)) for i in range(22)]
    columns += [(100, [], 1), (101, [2, 2], 1), (102, None, 1)]
    table = spark.createDataFrame([(*c, 9, 9) for c in columns], "mech long, dets array<int>, obs int, next int, pivot int")
    out = {}
    for x in enumeration.anchored(table, (2, 3, 4, 5)).collect():
        assert out.setdefault((x.weight, tuple(x.members)), (x.act, x.expanded)) == (x.act, x.expanded)
    expected = {(w, m): v for w in (2, 3, 4, 5) for m, v in _logicals(columns, w).items()}
    assert out == expected and any(w == 5 for w, _ in out)


@pytest.mark.parametrize("hot", [0, 2, 5])
def test_sets_close_by_pairs_whatever_is_hot(spark, monkeypatch, hot):
    """Pairs that share a detector, that share hot ones only, that share none; also of weights that skip a ply."""
    monkeypatch.setattr(enumeration, "HOT", hot)
    r = random.Random(hot)
    columns = [(i, [r.randrange(7) if r.random() < 0.8 else 0 for _ in range(r.choice([1, 2, 2, 3]))], r.randrange(4)) for i in range(18)]
    table = spark.createDataFrame(columns, "mech long, dets array<int>, obs int")
    got = [(x.weight, tuple(x.members), x.act, x.expanded) for x in enumeration.anchored(table, (3, 6)).collect()]
    assert sorted(got) == sorted((w, m, *v) for w in (3, 6) for m, v in _logicals(columns, w).items()) and any(w == 6 for w, *_ in got)


def test_the_last_two_columns_are_no_plies(spark):
    """Sets of four columns are the largest that are shuffled before a set of six closes: no join follows theirs but to close."""
    table = spark.range(40).select(F.col("id").alias("mech"), F.array(F.col("id") % 9, F.col("id") * 7 % 11).alias("dets"), (F.col("id") % 3).alias("obs"))
    plan = enumeration.anchored(table, (6,))._jdf.queryExecution().optimizedPlan().toString()
    assert "code" in plan and plan.count("concat(members") <= 2 * (3 + 3 + 2)


def test_a_chain_joins_on_keys_only(spark):
    table = spark.range(50).select(F.col("id").alias("mech"), F.array(F.col("id") % 20, F.col("id") % 7).alias("dets"), (F.col("id") % 3).alias("obs"))
    plan = enumeration.anchored(table, (4,))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" in plan
    assert enumeration.anchored(table.limit(0), (3,)).count() == 0 and enumeration.anchored(table, ()).count() == 0


def test_ranks_and_keys(spark):
    for n, k in ((1, 1), (5, 2), (7, 3), (9, 9), (62, 2), (12, 6)):
        members = [3 * i for i in range(n)]
        rows = spark.range(min(math.comb(n, k), 2000)).select("id", F.array(*map(F.lit, members)).alias("m"))
        rows = rows.select("id", subsets.unranked(F.col("m"), F.col("id"), k).alias("s")).select("id", "s", subsets.packed(F.col("s"), k).alias("key"))
        rows = rows.select("id", "s", "key", subsets.unpacked(F.col("key"), k).alias("back")).orderBy("id").collect()
        listed = list(itertools.islice(itertools.combinations(members, k), len(rows)))
        assert [tuple(x.s) for x in rows] == listed == [tuple(x.back) for x in rows]
        assert len({bytes(x.key) for x in rows}) == len(rows) and len(rows[0].key) == 7 * -(-k // 4)
    assert [tuple(x.b) for x in spark.sql("SELECT array(1L, 268435455L, 7L) AS s").select(subsets.unpacked(subsets.packed(F.col("s"), 3, 28), 3, 28).alias("b")).collect()] == [(1, 268435455, 7)]
    with pytest.raises(Exception, match="14 bits"):
        spark.sql("SELECT array(1L, 16384L) AS s").select(subsets.packed(F.col("s"), 2)).collect()
    with pytest.raises(Exception, match="62 members"):
        spark.range(1).select(subsets.choices(F.lit(63), 2)).collect()


def _table(spark, sets):
    return spark.createDataFrame([(i, s, 0, 0) for i, s in enumerate(sets)], "set long, members array<long>, rank int, first int")


def test_restrictions_within_and_beyond_a_budget(spark, monkeypatch):
    monkeypatch.setattr(subsets, "RANKS", 10)
    r = random.Random(2)
    sets = [sorted(r.sample(range(12), r.randrange(0, 9))) for _ in range(40)] + [list(range(15)), list(range(15)), []]
    k = 3
    subs = [c for s in sets for c in itertools.combinations(s, k)]
    table = _table(spark, sets)
    assert tuple(subsets.count_restrictions(table, k, 10**9).first()) == (k, float(len(subs)), float(len(set(subs))), True)
    assert tuple(subsets.count_restrictions(table, k, 600).first()) == (k, float(len(subs)), float(len(set(subs))), True)  # by the sketch
    assert tuple(subsets.count_restrictions(table, k, 100).first()) == (k, float(len(subs)), float(len(subs)), False)
    assert tuple(subsets.count_restrictions(table.limit(0), k, 100).first()) == (k, 0.0, 0.0, True)


def test_capped_subsets(spark):
    sets = [[1, 5, 9], list(range(30)), [4], [], list(range(62)), [7, 8, 9, 10]]
    table = _table(spark, sets)
    every = subsets.capped_subsets(table.filter("set not in (1, 4)"), (2, 3), 10**6, 5).collect()
    expected = sorted((i, k, c) for i in (0, 2, 3, 5) for k in (2, 3) for c in itertools.combinations(sets[i], k))
    assert sorted((x.set, x.k, tuple(x.subset)) for x in every) == expected
    some = subsets.capped_subsets(table, (1, 2, 5), 100, 5).collect()
    for k in (1, 2, 5):
        for i, s in enumerate(sets):
            mine = {tuple(x.subset) for x in some if (x.set, x.k) == (i, k)}
            assert len(mine) == min(100, math.comb(len(s), k)) and all(tuple(sorted(m)) == m and set(m) <= set(s) for m in mine)
    again = subsets.capped_subsets(table.repartition(3), (1, 2, 5), 100, 5).collect()
    assert sorted(map(tuple, ((x.set, x.k, x.rank) for x in again))) == sorted(map(tuple, ((x.set, x.k, x.rank) for x in some)))
    other = subsets.capped_subsets(table, (5,), 100, 6).collect()
    assert {x.rank for x in other if x.set == 4} != {x.rank for x in some if x.set == 4 and x.k == 5}
    wide = [x.rank for x in some if x.set == 4 and x.k == 5]
    assert 0.3 < sum(r < math.comb(62, 5) / 2 for r in wide) / len(wide) < 0.7  # spread over all ranks
