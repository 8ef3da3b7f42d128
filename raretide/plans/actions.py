"""Queries on symmetry actions, draws of expanded columns, and merges that name their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from raretide.operators import dem, orbits, ranges
from raretide.plans import base as X
from raretide.plans.catalogue import query

#: Maps on 16 bits: a rotation by four places, and on each four bits e0 -> e1, e1 -> e0 + e1, e2 -> e3, e3 -> e2 + e3.
ROTATE = orbits.permutation([(i + 4) % 16 for i in range(16)])
MIX = [c << 4 * b for b in range(4) for c in (2, 3, 8, 12)]
MASK = "(o_orderkey * 2654435761) % 65536"


def _sql_image(columns: list[int], m: str = "m") -> str:
    out = "CAST(0 AS BIGINT)"
    for i, c in enumerate(columns):
        out = f"xor({out}, (({m} >> {i}) & 1) * {c})"
    return out


@query(f"""WITH RECURSIVE given AS (SELECT DISTINCT {MASK} AS mask FROM orders),
    reach(mask, m) AS (SELECT mask, mask FROM given UNION SELECT mask, unnest([{_sql_image(ROTATE)}, {_sql_image(MIX)}]) FROM reach)
    SELECT r.mask, min(m) AS representative, count(*) AS size, count(g.mask) AS present FROM reach r LEFT JOIN given g ON g.mask = m GROUP BY r.mask""")
def mask_orbits(spark, sf):
    """Orbits of the observable masks that orders play: representatives, sizes, and how many of an orbit occur."""
    masks = X.read(spark, sf, "orders").select(F.pmod(F.col("o_orderkey") * 2654435761, F.lit(65536)).alias("mask"))
    return orbits.orbits(masks, (ROTATE, MIX))


RING = 31
DETS = "list_sort(list_distinct([r.r, (r.r + p_partkey) % 31, (r.r + p_partkey * 7 + p_size) % 31]))"


@query(f"""WITH cols AS (SELECT dets, row_number() OVER (ORDER BY dets) AS col FROM (SELECT DISTINCT {DETS} AS dets FROM part, range({RING}) r(r)) WHERE len(dets) > 1),
    moved AS (SELECT s.s AS shift, col, list_sort([(x + s.s) % {RING} FOR x IN dets]) AS dets FROM cols, range(1, {RING}) s(s))
    SELECT CAST(shift AS BIGINT) AS shift, count(*) AS columns, count(DISTINCT image) AS images, count(*) FILTER (col = image) AS fixed, CAST(sum(col * image % 1000003) AS BIGINT) AS digest
    FROM (SELECT shift, m.col, c.col AS image FROM moved m JOIN cols c USING (dets)) GROUP BY shift""")
def shift_permutations(spark, sf):
    """Permutations of columns under all shifts of a ring of 31 detectors; columns are the shapes that parts play, everywhere."""
    part = X.read(spark, sf, "part").select(F.pmod("p_partkey", F.lit(RING)).alias("x"), F.pmod(F.col("p_partkey") * 7 + F.col("p_size"), F.lit(RING)).alias("y")).distinct()
    at = part.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(RING - 1).cast("long"))))
    sets = at.select(F.array_sort(F.array_distinct(F.array("r", (F.col("r") + F.col("x")) % RING, (F.col("r") + F.col("y")) % RING))).alias("dets")).distinct().filter(F.size("dets") > 1)
    # numbered in the order of their sets: at most C(31, 3) + C(31, 2) of them
    cols = sets.select(F.expr("row_number() OVER (ORDER BY dets)").cast("long").alias("col"), "dets")
    moves = spark.range(1, RING).select(F.col("id").alias("shift"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(RING - 1).cast("long"))).alias("det")).withColumn("image", (F.col("det") + F.col("shift")) % RING)
    out = orbits.column_permutations(cols, moves)
    return out.groupBy("shift").agg(F.count(F.lit(1)).alias("columns"), F.countDistinct("image").alias("images"), F.count_if(F.col("col") == F.col("image")).alias("fixed"), F.sum(F.col("col") * F.col("image") % 1000003).alias("digest"))


M = f"{X.MECH}, mult AS (SELECT mech, CAST(greatest(round_even(p / (SELECT min(p) FROM mech), 0), 1) AS BIGINT) AS m FROM mech), ends AS (SELECT mech, sum(m) OVER (ORDER BY mech) - m AS low, sum(m) OVER (ORDER BY mech) AS high FROM mult)"


@query(f"""WITH {M}, draws AS (SELECT (l_orderkey * 2654435761 + l_linenumber * 40503) % (SELECT CAST(sum(m) AS BIGINT) FROM mult) AS u FROM lineitem)
    SELECT mech, count(*) AS draws, CAST(sum(u - low) AS BIGINT) AS offsets FROM draws JOIN ends ON u >= low AND u < high GROUP BY mech""")
def drawn_mechanisms(spark, sf):
    """Draws of expanded columns, one for each line, told apart by the mechanism whose range of columns holds them."""
    mult = dem.multiplicities(X.mechanisms(spark, sf))
    n, kinds = mult.agg(F.sum("m"), F.count(F.lit(1))).first()
    draws = X.read(spark, sf, "lineitem").select(F.pmod(F.col("l_orderkey") * 2654435761 + F.col("l_linenumber") * 40503, F.lit(n)).alias("u"))
    met = ranges.range_join(draws, "u", ranges.prefix_ranges(mult, "mech", "m"), "low", "high", max(1, n // max(1, kinds)))
    return met.groupBy("mech").agg(F.count(F.lit(1)).alias("draws"), F.sum(F.col("u") - F.col("low")).alias("offsets"))


@query("""WITH flips AS (SELECT l_partkey % 256 AS det, l_suppkey % 4 AS obs, l_discount / 3 AS p, l_orderkey * 8 + l_linenumber AS seq FROM lineitem)
    SELECT det, obs, round((1 - exp(sum(ln(1 - 2 * p)))) / 2, 9) AS p, count(*) AS merged, array_to_string(list_sort(list(seq))[1:3], ',') AS sources FROM flips GROUP BY det, obs""")
def merged_sources(spark, sf):
    """Mechanisms merged by what they flip, each with its first three sources."""
    line = X.read(spark, sf, "lineitem")
    flips = line.select((F.col("l_partkey") % 256).alias("det"), (F.col("l_suppkey") % 4).alias("obs"), (F.col("l_discount") / 3).alias("p"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))
    out = ranges.merged_with_sources(flips, ["det", "obs"], "seq", "p", 3)
    return out.select("det", "obs", F.round("p", 9).alias("p"), "merged", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))
