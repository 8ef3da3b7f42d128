"""Steps whose tasks must not grow with the tables: partitions by rows, no join by few keys, no pairs of equal signatures."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from raretide.functions import parts
from raretide.operators import dem, enumeration, library, subsets
from raretide.plans import enumerations, relations, reports, studies


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_grow_with_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [parts.count(spark.range(n), 10) for n in (0, 10 * cores, 100 * cores + 1)] == [cores, cores, 10 * cores + 1]


def test_shared_checks_and_neighbours_in_parts(spark):
    inc = spark.range(600).select((F.col("id") % 37).alias("vertex"), F.expr("id div 7").alias("check"))
    edges = dem.shared_checks(inc, 11)
    assert edges.rdd.getNumPartitions() == 22 and sorted(edges.collect()) == sorted(dem.shared_checks(inc).collect())
    near = dem.adjacency(edges, 13)
    assert near.rdd.getNumPartitions() == 13 and sorted(near.collect()) == sorted(dem.adjacency(edges).collect())


def test_subsets_in_parts(spark):
    members = spark.range(60).select(F.expr("id div 5").alias("config"), (F.col("id") * 7 % 23).alias("mech"))
    pairs = dem.subsets(members, 2, 11)
    assert pairs.rdd.getNumPartitions() == 22 and sorted(pairs.collect()) == sorted(dem.subsets(members, 2).collect())


def test_queries_over_lines_take_partitions_by_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(parts, "count", lambda table, rows=0: 19)
    for query, n in ((relations.shared_check_edges, 38), (relations.adjacency, 76), (relations.logical_symmetric_difference, 19), (studies.packed_restrictions, 38), (reports.specimen_translation, 19)):
        assert query(spark, sf_dir).rdd.getNumPartitions() == n, query
    assert enumerations._sets(spark, sf_dir, 17).rdd.getNumPartitions() == 17


def test_portfolios_do_not_shuffle_by_member(spark):
    answers = spark.createDataFrame([(1, 2, "A", 1, True, 0.5, "A")], "shot long, weight long, truth string, member int, valid boolean, score double, answer string")
    combos = spark.createDataFrame([("both", 1), ("both", 2)], "portfolio string, member int")
    assert "hashpartitioning(member" not in _plan(library.portfolios(answers, combos))


def test_translation_takes_the_first_of_a_signature_before_joining(spark):
    mechs = spark.range(1, 3001).select(F.col("id").alias("mech"), F.lit(1).alias("det"), F.lit(2).alias("obs"))
    specimens = spark.createDataFrame([(1, 7), (1, 3000), (2, 9), (2, 5000), (None, 7)], "config long, mech long")
    out = reports.translated(specimens, mechs, mechs)
    assert sorted(map(tuple, out.collect())) == [(1, 1), (1, 1)]
    assert "min(mech" in _plan(out).replace("partial_", "")


def test_plies_in_parts(spark):
    rows = [(i, [i % 5, (i * 3 + 1) % 7], i % 4) for i in range(14)]
    table = spark.createDataFrame(rows, "mech long, dets array<long>, obs long")
    some = enumeration.anchored(table, (3, 4), 5)
    assert "REPARTITION_BY_NUM" in _plan(some)
    assert sorted(map(str, some.collect())) == sorted(map(str, enumeration.anchored(table, (3, 4)).collect()))


def test_subsets_of_one_block_come_in_order_of_rank(spark):
    table = spark.createDataFrame([([2, 3, 5, 7, 11, 13],), ([1, 2],)], "members array<long>")
    for k in (1, 2, 3, 4):
        assert [tuple(r[0]) for r in subsets.listed(table, k, 1).collect() if r[0][-1] > 2] == [c for c in combinations((2, 3, 5, 7, 11, 13), k) if c[-1] > 2]


def test_a_budget_that_few_sets_exceed_needs_no_sketch(spark, monkeypatch):
    table = spark.range(300).select(F.array(*(F.col("id") * 10 + i for i in range(5))).alias("members"))
    monkeypatch.setattr(F, "approx_count_distinct", lambda *_: 1 / 0)
    assert tuple(subsets.count_restrictions(table, 3, 1000, parts=3).first()) == (3, 3000.0, 3000.0, False)
