"""Queries over polynomials of the codes, exact onsets, distances, and splitting over a decoder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from raretide.functions import gf2, relay
from raretide.operators import codes, memory, onset, replica
from raretide.operators import dem
from raretide.operators import montecarlo as mc
from raretide.plans import base as X
from raretide.plans.catalogue import query
from raretide.plans.kernels import BB18, bb6
from raretide.plans.relations import BB6, BB6_SQL, COLUMNS

#: Parts of polynomials as a table: region i stands for the monomial x^(i mod 6) y^(i div 2 mod 6), nation by nation.
TERMS = "terms AS (SELECT n_regionkey AS poly, n_nationkey % 6 AS i, (n_nationkey // 2) % 6 AS j FROM nation)"


def _terms(spark, sf):
    n = X.read(spark, sf, "nation")
    return n.select(F.col("n_regionkey").alias("poly"), (F.col("n_nationkey") % 6).alias("i"), F.expr("n_nationkey div 2 % 6").alias("j"))


def _odd(rows, *keys):
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").drop("n")


@query(f"WITH {TERMS} SELECT CAST(poly AS BIGINT) AS poly, CAST((i + 2) % 6 AS BIGINT) AS i, CAST((j + 5) % 6 AS BIGINT) AS j FROM terms GROUP BY ALL HAVING count(*) % 2 = 1")
def shifted_polynomials(spark, sf):
    """Each polynomial times x^2 y^5; equal monomials cancel in pairs."""
    t = _odd(_terms(spark, sf), "poly", "i", "j")
    return t.select(F.col("poly").cast("long"), F.pmod(F.col("i") + 2, F.lit(6)).cast("long").alias("i"), F.pmod(F.col("j") + 5, F.lit(6)).cast("long").alias("j"))


VECTORS = f"{TERMS}, halves AS (SELECT poly, i * 6 + j AS q FROM terms UNION ALL SELECT poly, 36 + (((i + 1) % 6) * 6 + j) AS q FROM terms), vectors AS (SELECT poly, q FROM halves GROUP BY ALL HAVING count(*) % 2 = 1)"


def _vectors(spark, sf):
    """poly, q: the operator with p on the left half and x p on the right one."""
    t = _terms(spark, sf)
    left = t.select("poly", (F.col("i") * 6 + F.col("j")).alias("q"))
    right = t.select("poly", (36 + F.pmod(F.col("i") + 1, F.lit(6)) * 6 + F.col("j")).alias("q"))
    return _odd(left.unionByName(right), "poly", "q").select(F.col("poly").cast("long"), F.col("q").cast("long"))


@query(f"WITH {VECTORS} SELECT CAST(poly AS BIGINT) AS poly, CAST(q AS BIGINT) AS q, CASE WHEN q < 36 THEN 'L' ELSE 'R' END AS half, CAST((q % 36) // 6 AS BIGINT) AS i, CAST(q % 6 AS BIGINT) AS j FROM vectors")
def operator_vertices(spark, sf):
    """Supports of operators as qubits, and back as half and exponents."""
    v = _vectors(spark, sf)
    return v.select("poly", "q", F.when(F.col("q") < 36, "L").otherwise("R").alias("half"), F.expr("q % 36 div 6").alias("i"), (F.col("q") % 6).alias("j"))


@query(f"WITH {VECTORS} SELECT CAST(poly AS BIGINT) AS poly, string_agg(CAST(q AS VARCHAR), ',' ORDER BY q) AS support FROM vectors GROUP BY poly")
def operator_supports(spark, sf):
    return _vectors(spark, sf).groupBy("poly").agg(F.array_join(F.transform(F.array_sort(F.collect_list("q")), lambda q: q.cast("string")), ",").alias("support"))


@query(f"WITH {VECTORS}, {BB6_SQL} SELECT CAST(poly AS BIGINT) AS poly, count(*) AS broken FROM (SELECT poly, row FROM vectors JOIN checks ON q = col WHERE kind = 'Z' GROUP BY poly, row HAVING count(*) % 2 = 1) GROUP BY poly")
def broken_checks(spark, sf):
    """Checks that each operator does not commute with; those that commute with all are absent."""
    z = codes.parity_checks(spark, *BB6).filter("kind = 'Z'")
    return _odd(_vectors(spark, sf).join(z, F.col("q") == F.col("col")), "poly", "row").groupBy("poly").agg(F.count(F.lit(1)).alias("broken"))


@query(f"WITH {VECTORS} SELECT CAST(a.poly AS BIGINT) AS a, CAST(b.poly AS BIGINT) AS b, count(*) AS shared, count(*) % 2 = 1 AS anticommute, CASE WHEN count(*) = 1 THEN CAST(min(a.q) AS BIGINT) END AS only_qubit FROM vectors a JOIN vectors b USING (q) WHERE a.poly < b.poly GROUP BY a.poly, b.poly")
def operator_overlaps(spark, sf):
    """Qubits that two operators share, whether they anticommute, and the qubit where it is the only one."""
    v = _vectors(spark, sf)
    both = v.select(F.col("poly").alias("a"), "q").join(v.select(F.col("poly").alias("b"), "q"), "q").filter("a < b")
    n = F.count(F.lit(1))
    return both.groupBy("a", "b").agg(n.alias("shared"), (n % 2 == 1).alias("anticommute"), F.when(n == 1, F.min("q")).alias("only_qubit"))


@query()
def light_logicals(spark, sf):
    """All X logicals of the 18-qubit code by weight: every element of the kernel, less the stabilisers."""
    hx, hz = (np.zeros((9, 18), np.uint8) for _ in "xz")
    for r in codes.parity_checks(spark, *BB18).collect():
        (hx if r.kind == "X" else hz)[r.row, r.col] = 1
    span = lambda rows: [sum(int(b) << i for i, b in enumerate(v)) for v in rows]
    kernel, stabilisers = span(gf2.kernel(hz)), span(gf2.row_space(hx))

    def sums(basis):
        if len(basis) > 22:
            raise ValueError("too large a space to list")
        bit = lambda m: F.call_function("shiftright", F.col("id"), F.lit(m)).bitwiseAND(F.lit(1))
        v = F.lit(0).cast("long")
        for m, b in enumerate(basis):
            v = v.bitwiseXOR(bit(m) * F.lit(b))
        return spark.range(1 << len(basis)).select(v.alias("v"))

    return sums(kernel).join(sums(stabilisers), "v", "left_anti").groupBy(F.bit_count("v").cast("long").alias("weight")).agg(F.count(F.lit(1)).alias("logicals"))


@query()
def shift_actions(spark, sf):
    """What each generator shift does to the 12 logical pairs of the 72-qubit code: order of the matrix and whether it keeps the pairing."""
    hx, hz = bb6(spark)
    x, z = gf2.paired_logicals(hx, hz)
    rows = []
    for name, (a, b) in (("x", (1, 0)), ("y", (0, 1))):
        moved = np.array([(q - q % 36) + ((q % 36 // 6 + a) % 6) * 6 + (q % 6 + b) % 6 for q in range(72)])
        shift = np.zeros((72, 72), np.uint8)
        shift[moved, np.arange(72)] = 1
        on_x, on_z = (shift @ x.T % 2).T @ z.T % 2, (shift @ z.T % 2).T @ x.T % 2
        power, order = on_x.copy(), 1
        while not np.array_equal(power, np.eye(12, dtype=np.uint8)) and order < 100:
            power, order = power @ on_x % 2, order + 1
        rows.append((name, order, bool(np.array_equal(on_x @ on_z.T % 2, np.eye(12, dtype=np.uint8)))))
    return spark.createDataFrame(rows, "shift string, order long, symplectic boolean")


WEIGHED = f"{COLUMNS}, mult AS (SELECT mech, 1 + mech % 3 AS m FROM cols)"
HALVES = f"""{WEIGHED}, pairs AS (SELECT a.mech AS i, b.mech AS j, xor(a.det, b.det) AS s, xor(a.obs, b.obs) AS act FROM cols a JOIN cols b ON a.mech < b.mech),
    logicals AS (SELECT DISTINCT list_sort([x.i, x.j, y.i, y.j]) AS l FROM pairs x JOIN pairs y USING (s) WHERE x.act <> y.act AND x.i < y.i AND x.j <> y.i AND x.j <> y.j AND x.i <> y.j),
    restricted AS (SELECT DISTINCT u.a AS c1, v.b AS c2 FROM (SELECT l, unnest(l) AS a FROM logicals) u JOIN (SELECT l, unnest(l) AS b FROM logicals) v ON u.l = v.l AND u.a < v.b),
    classes AS (SELECT xor(x.det, y.det) AS syndrome, xor(x.obs, y.obs) AS truth, sum(mx.m * my.m) AS rho FROM restricted JOIN cols x ON x.mech = c1 JOIN cols y ON y.mech = c2 JOIN mult mx ON mx.mech = c1 JOIN mult my ON my.mech = c2 GROUP BY ALL)"""


def _columns(spark, sf):
    s = X.read(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("mech"), F.pmod(F.col("s_suppkey") * 2654435761, F.lit(16384)).alias("det"), F.pmod(F.col("s_suppkey") * 40503, F.lit(7)).alias("obs"), (1 + F.col("s_suppkey") % 3).alias("m"))


@query(f"WITH {HALVES} SELECT CAST(coalesce((SELECT sum(fails) FROM (SELECT sum(rho) - max(rho) AS fails FROM classes GROUP BY syndrome)), 0) AS BIGINT) AS fails, (SELECT count(*) FROM logicals) AS logicals, CAST((SELECT sum(m) FROM mult) AS BIGINT) AS expanded")
def exact_onset(spark, sf):
    """Weight-4 logicals by meeting in the middle, and of their halves the expanded sets that an optimal decoder loses."""
    return onset.voted_pairs(_columns(spark, sf)).select(F.col("fails").cast("long"), "logicals", "expanded")


@query(f"""WITH {X.MECH}, odd AS (SELECT config, mech FROM (SELECT l_orderkey AS config, l_partkey AS mech FROM lineitem) GROUP BY ALL HAVING count(*) % 2 = 1), sized AS (SELECT *, count(*) OVER (PARTITION BY config) AS w FROM odd),
    p3 AS (SELECT DISTINCT a.mech AS c1, b.mech AS c2 FROM sized a JOIN sized b ON a.config = b.config AND a.mech < b.mech WHERE a.w = 3), p4 AS (SELECT DISTINCT a.mech AS c1, b.mech AS c2 FROM sized a JOIN sized b ON a.config = b.config AND a.mech < b.mech WHERE a.w = 4),
    m AS (SELECT mech, 1 + mech % 2 AS m FROM mech), sure AS (SELECT sum(x.m * y.m) AS n FROM p3 JOIN m x ON x.mech = c1 JOIN m y ON y.mech = c2),
    classes AS (SELECT xor(x.det, y.det) AS s, xor(x.obs, y.obs) AS o, sum(mx.m * my.m) AS rho FROM p4 ANTI JOIN p3 USING (c1, c2) JOIN mech x ON x.mech = c1 JOIN mech y ON y.mech = c2 JOIN m mx ON mx.mech = c1 JOIN m my ON my.mech = c2 GROUP BY ALL)
    SELECT CAST((SELECT coalesce(n, 0) FROM sure) + coalesce((SELECT sum(f) FROM (SELECT sum(rho) - max(rho) AS f FROM classes GROUP BY s)), 0) AS BIGINT) AS fails""")
def odd_onset(spark, sf):
    """The same for distance 3: every pair inside a lightest set, and the vote over pairs of the next heavier ones."""
    odd = dem.parity_members(X.configurations(spark, sf))
    sizes = odd.groupBy("config").agg(F.count(F.lit(1)).alias("w"))
    of = lambda w: odd.join(sizes.filter(F.col("w") == w).select("config"), "config", "left_semi")
    columns = X.mechanisms(spark, sf).select("mech", "det", "obs", (1 + F.col("mech") % 2).alias("m"))
    return onset.fail_count(of(3), columns, 3, of(4)).select(F.col("fails").cast("long"))


@query()
def min_weight_distance(spark, sf):
    """Distance and onset of the 18-qubit memory's Z sector: the least witness over all products of observables, each verified."""
    model = mc.Model.of(spark, memory.memory_circuit(*BB18, 2, 0.003), kind=0)
    return onset.distance(spark, model)


def _failures(spark):
    model = mc.Model.of(spark, memory.memory_circuit(*BB18, 2, 0.003), kind=0)
    fails = replica.DecoderFails(model, relay.named("relay", legs=2, first_rounds=12, rounds=12, seed=1))
    n = len(model.expanded()[0])
    r = np.random.default_rng(7)
    tried = np.zeros((400, n), np.uint8)
    for row in tried:
        row[r.choice(n, 12, replace=False)] = 1
    failing = tried[fails(tried)]
    return fails, n, replica.strip(failing[:12], fails, r)


@query()
def splitting_over_decoder(spark, sf):
    """Ladder of the 18-qubit memory's failures under a relay decoder, from stripped failing seeds."""
    fails, n, seeds = _failures(spark)
    return replica.multi_seeded(spark, n, fails, seeds, [0.01, 0.007, 0.005], 4, 40, 13, most=80)


@query()
def tempering_over_decoder(spark, sf):
    """The same by replica exchange from one seed."""
    fails, n, seeds = _failures(spark)
    return replica.replica_exchange(spark, n, fails, seeds[0], [0.01, 0.007, 0.005], 4, 10, 8, 13)
