"""Queries that enumerate: light logicals by anchored chains, restrictions under a budget, capped subsets of supports."""

from __future__ import annotations

from pyspark.sql import functions as F

from raretide.functions import lineage, parts
from raretide.operators import dem, enumeration, subsets
from raretide.plans import base as X
from raretide.plans.catalogue import query

WEIGHTS = (3, 5, 6)
#: Detectors that a part flips: two, or three where its size is divisible by four, of a third as many as there are parts.
PLACES = ("p_partkey * 2654435761", "p_partkey * 40503 + p_size * 7919", "p_partkey * 104729 + p_size * 15485863")


def _columns(spark, sf):
    part = X.read(spark, sf, "part")
    of = F.lit(max(part.count() // 3, 1)).cast("long")
    dets = [F.pmod(F.expr(p).cast("long"), of) for p in PLACES]
    some = F.when(F.col("p_size") % 4 == 0, F.array(*dets)).otherwise(F.array(*dets[:2]))
    return part.select(F.col("p_partkey").alias("mech"), some.alias("dets"), (F.col("p_size") % 16).cast("long").alias("obs"))


def _chain() -> str:
    """All sets by the lowest open detector, from every member, each found several times."""
    apart = lambda a, b: f"list_sort(list_concat(list_filter({a}, lambda x: NOT list_contains({b}, x)), list_filter({b}, lambda x: NOT list_contains({a}, x))))"
    return f"""
        WITH RECURSIVE raw AS (SELECT p_partkey AS mech, [x % m.of FOR x IN CASE WHEN p_size % 4 = 0 THEN [{", ".join(PLACES)}] ELSE [{", ".join(PLACES[:2])}] END] AS d, CAST(p_size % 16 AS BIGINT) AS obs FROM part, (SELECT greatest(count(*) // 3, 1) AS of FROM part) m),
        cols AS (SELECT min(mech) AS mech, dets, obs, count(*) AS size FROM (SELECT mech, list_sort(list_filter(list_distinct(d), lambda x: len(list_filter(d, lambda y: y = x)) % 2 = 1)) AS dets, obs FROM raw) WHERE len(dets) > 0 GROUP BY dets, obs),
        flips AS (SELECT unnest(dets) AS det, * FROM cols),
        chain(k, members, parts, residue, act, expanded) AS (
            SELECT 1, [mech], [dets], dets, obs, CAST(size AS DOUBLE) FROM cols
            UNION
            SELECT k + 1, list_sort(list_append(members, mech)), list_append(parts, dets), {apart("residue", "dets")}, xor(act, obs), expanded * size
            FROM chain JOIN flips ON det = residue[1] WHERE k < {max(WEIGHTS)} AND NOT list_contains(members, mech) AND len({apart("residue", "dets")}) <= 3 * ({max(WEIGHTS)} - k - 1))
        SELECT DISTINCT k AS weight, array_to_string(members, ',') AS members, act, expanded FROM chain
        WHERE k IN {WEIGHTS} AND len(residue) = 0 AND act <> 0
        AND NOT list_bool_or([(SELECT_ODD) FOR m IN range(1, CAST(pow(2, k) AS BIGINT) - 1)])
    """.replace("SELECT_ODD", "len(list_filter(list_distinct(flatten(list_filter(parts, lambda p, i: (m >> (i - 1)) & 1 = 1))), lambda x: len(list_filter(flatten(list_filter(parts, lambda p, i: (m >> (i - 1)) & 1 = 1)), lambda y: y = x)) % 2 = 1)) = 0")


@query(_chain())
def anchored_logicals(spark, sf):
    """Undetectable logicals of weights 3, 5 and 6 over the columns that parts play."""
    out = enumeration.anchored(_columns(spark, sf), WEIGHTS, parts.count(X.read(spark, sf, "part"), 1 << 16))
    return out.select("weight", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "act", "expanded")


def _sets(spark, sf, n):
    return dem.supports(parts.dealt(X.configurations(spark, sf), n, "config")).select(F.col("config").alias("set"), F.col("support").alias("members"))


ODD = f"{X.CONF}, odd AS (SELECT config, mech FROM conf GROUP BY config, mech HAVING count(*) % 2 = 1)"
PAIRS = "two AS (SELECT a.config, a.mech AS c1, b.mech AS c2 FROM odd a JOIN odd b ON a.config = b.config AND a.mech < b.mech)"
TRIPLES = "three AS (SELECT t.config, c1, c2, o.mech AS c3 FROM two t JOIN odd o ON o.config = t.config AND o.mech > t.c2)"


@query(f"""WITH {ODD}, {PAIRS}, {TRIPLES}
    SELECT 2 AS k, CAST(count(*) AS DOUBLE) AS subsets, CAST(count(DISTINCT (c1, c2)) AS DOUBLE) AS restrictions, TRUE AS exact FROM two
    UNION ALL SELECT 3, CAST(count(*) AS DOUBLE), CASE WHEN count(DISTINCT (c1, c2, c3)) <= 1000 THEN CAST(count(DISTINCT (c1, c2, c3)) AS DOUBLE) ELSE CAST(count(*) AS DOUBLE) END, count(DISTINCT (c1, c2, c3)) <= 1000 FROM three""")
def restriction_budget(spark, sf):
    """Distinct restrictions of supports: pairs exactly, triples within a budget of 1000, else an upper bound."""
    n = parts.count(X.configurations(spark, sf))
    sets = lineage.cut(_sets(spark, sf, n))  # read several times
    return subsets.count_restrictions(sets, 2, 1 << 50, parts=n).unionByName(subsets.count_restrictions(sets, 3, 1000, parts=n))


CAP, SEED = 3, 7
F_OF = "CAST('0x' || left(md5(concat_ws(':', name, {r}, {h})), 8) AS BIGINT)"


@query(f"""WITH RECURSIVE {ODD}, {PAIRS}, {TRIPLES},
    listed AS (SELECT config AS "set", 2 AS k, row_number() OVER (PARTITION BY config ORDER BY c1, c2) - 1 AS rank, concat_ws(',', c1, c2) AS subset FROM two
               UNION ALL SELECT config, 3, row_number() OVER (PARTITION BY config ORDER BY c1, c2, c3) - 1, concat_ws(',', c1, c2, c3) FROM three),
    sizes AS (SELECT "set", k, count(*) AS total, CAST(greatest(ceil(sqrt(count(*))), 1) AS BIGINT) AS a, concat_ws(':', {SEED}, "set", k) AS name FROM listed GROUP BY "set", k),
    places AS (SELECT *, unnest(range(least({CAP}, total))) AS place FROM sizes),
    walk("set", k, total, a, b, name, place, x, steps) AS (
        SELECT "set", k, total, a, (total + a - 1) // a, name, place, place, 0 FROM places
        UNION ALL
        SELECT "set", k, total, a, b, name, place, l2 + a * r2, steps + 1 FROM (
            SELECT *, (r1 + {F_OF.format(r=3, h="l2")}) % b AS r2 FROM (
                SELECT *, (l1 + {F_OF.format(r=2, h="r1")}) % a AS l2 FROM (
                    SELECT *, (r0 + {F_OF.format(r=1, h="l1")}) % b AS r1 FROM (
                        SELECT *, (x % a + {F_OF.format(r=0, h="x // a")}) % a AS l1, x // a AS r0 FROM walk WHERE steps = 0 OR x >= total)))))
    SELECT "set", k, rank, subset FROM listed JOIN (SELECT "set", k, x AS rank FROM walk WHERE steps > 0 AND x < total) USING ("set", k, rank)""")
def subset_seeds(spark, sf):
    """At most three pairs and three triples of each support, the same ones whenever they are drawn."""
    out = subsets.capped_subsets(_sets(spark, sf, parts.count(X.configurations(spark, sf))), (2, 3), CAP, SEED)
    return out.select("set", "k", "rank", F.array_join(F.col("subset").cast("array<string>"), ",").alias("subset"))
