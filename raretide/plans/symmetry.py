"""Queries over the symmetries and gate layers of the 72-qubit code."""

from __future__ import annotations

from pyspark.sql import functions as F

from raretide.operators import codes
from raretide.operators import symmetry as Y
from raretide.plans.catalogue import query
from raretide.plans.relations import BB6, BB6_SQL

L, M = BB6[:2]
SHIFTS = "shifts AS (SELECT i // 6 AS a, i % 6 AS b FROM range(0, 36) r(i))"


def _image(q: str) -> str:
    return f"(({q} - {q} % 36) + (({q} % 36) // 6 + a) % 6 * 6 + ({q} % 6 + b) % 6)"


@query(f"WITH {SHIFTS} SELECT a, b, q, {_image('q')} AS image FROM shifts, range(0, 72) qs(q)")
def qubit_permutations(spark, sf):
    return Y.qubit_permutations(spark, L, M)


@query(f"WITH {BB6_SQL}, {SHIFTS}, images AS (SELECT a, b, kind, {_image('row')} AS row, {_image('col')} AS col FROM shifts, checks) SELECT count(*) AS broken, (SELECT count(*) FROM shifts) AS shifts FROM images ANTI JOIN checks USING (kind, row, col)")
def automorphism_check(spark, sf):
    checks = codes.parity_checks(spark, *BB6)
    return Y.broken(checks, L, M).agg(F.count(F.lit(1)).alias("broken")).withColumn("shifts", F.lit(L * M).cast("long"))


@query(f"WITH {SHIFTS}, pairs AS (SELECT x, y FROM range(0, 72) a1(x), range(0, 72) a2(y) WHERE x < y), images AS (SELECT x, y, least({_image('x')}, {_image('y')}) AS i, greatest({_image('x')}, {_image('y')}) AS j FROM pairs, shifts), reps AS (SELECT x, y, min(i * 100 + j) AS r FROM images GROUP BY x, y) SELECT r // 100 AS rx, r % 100 AS ry, count(*) AS size FROM reps GROUP BY r")
def pair_orbits(spark, sf):
    """Orbits of qubit pairs under the shifts: one representative each stands for the orbit."""
    q = spark.range(72)
    pairs = q.select(F.col("id").alias("x")).join(q.select(F.col("id").alias("y")), F.col("x") < F.col("y"))
    return Y.orbits(pairs, L, M).groupBy("rx", "ry").agg(F.count(F.lit(1)).alias("size"))


LAYERS = f"""{BB6_SQL}, monos(layer, part, i, j) AS (VALUES (1, 'A', 3, 0), (2, 'A', 0, 1), (3, 'A', 0, 2), (4, 'B', 0, 3), (5, 'B', 1, 0), (6, 'B', 2, 0)),
    gates AS (SELECT layer, part, r AS x, ((r // 6 + i) % 6) * 6 + (r % 6 + j) % 6 AS y FROM range(0, 36) rows(r), monos)"""


@query(f"WITH {LAYERS} SELECT 'X' AS kind, CAST(x AS BIGINT) AS row, CAST(layer AS BIGINT) AS layer, CAST(y + CASE WHEN part = 'A' THEN 0 ELSE 36 END AS BIGINT) AS qubit FROM gates UNION ALL SELECT 'Z', CAST(y AS BIGINT), CAST(layer AS BIGINT), CAST(x + CASE WHEN part = 'A' THEN 36 ELSE 0 END AS BIGINT) FROM gates")
def gate_layers(spark, sf):
    """Each check's gates in layers, one to a monomial: within a layer and kind no check and no qubit stands twice."""
    return codes.gate_layers(spark, *BB6)


@query(f"WITH {BB6_SQL} SELECT kind, count(*) AS entries, count(DISTINCT row) AS checks, min(n) AS lightest, max(n) AS heaviest FROM (SELECT kind, row, count(*) OVER (PARTITION BY kind, row) AS n FROM checks) GROUP BY kind")
def check_weights(spark, sf):
    by_row = codes.parity_checks(spark, *BB6).groupBy("kind", "row").agg(F.count(F.lit(1)).alias("n"))
    return by_row.groupBy("kind").agg(F.sum("n").alias("entries"), F.count(F.lit(1)).alias("checks"), F.min("n").alias("lightest"), F.max("n").alias("heaviest"))
