"""Report tables: thresholds and their validity, gates, anchors, asymptotes, summaries of operations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raretide.functions import parts
from raretide.functions.intervals import clopper_pearson
from raretide.operators import circuit as C
from raretide.operators import dem
from raretide.operators import spectrum as S
from raretide.plans import base as X
from raretide.plans import spectra as P
from raretide.plans.catalogue import query
from raretide.plans.relations import NAMES

#: Where tables are read off, and the onset that asymptotes start from.
POINT, W0 = 0.005, 3


def _at_point(spark, spec, by=None):
    return S.with_headroom(spec, spark.createDataFrame([(POINT,)], "p double"), X.N, by)


@query("WITH " + P._crossing_sql(f"{P.RUNS}, {P.FINE}, l AS (SELECT run, p, {X.LER} AS ler FROM spec, fine GROUP BY run, p), curve AS (SELECT p, a.ler AS y1, b.ler AS y2 FROM l a JOIN l b USING (p) WHERE a.run = 'F' AND b.run = 'O'), top AS (SELECT min(pow((-4 + sqrt(16 + 4 * m)) / 2, 2) / {X.N}) AS p_max FROM (SELECT run, max(w) AS m FROM spec GROUP BY run))").replace("AS crossing FROM (SELECT 1) one LEFT JOIN last ON true", "AS p_th, round(p_max, 9) AS p_max_valid, coalesce(round(exp(ln(p0) + CASE WHEN d = d0 THEN 0 ELSE d0 / (d0 - d) END * (ln(p) - ln(p0))), 9) > round(p_max, 9), true) AS bounded FROM top LEFT JOIN last ON true"))
def threshold_summary(spark, sf):
    """The crossing of two codes, the largest rate at which both spectra hold, and whether the threshold is a bound only."""
    runs = P._runs(spark, sf)
    l = S.reweight(runs, P._fine(spark), X.N, ["run"])  # noqa: E741
    curve = l.filter("run = 'F'").select("p", F.col("ler").alias("y1")).join(l.filter("run = 'O'").select("p", F.col("ler").alias("y2")), "p")
    tops = [S.mass_window(runs.filter(F.col("run") == r), X.N, 4.0) for r in ("F", "O")]
    top = tops[0].unionByName(tops[1]).agg(F.round(F.min("p_max"), 9).alias("p_max_valid"))
    both = top.join(S.crossing(curve).select(F.round("crossing", 9).alias("p_th")), F.lit(True), "left")
    return both.select("p_th", "p_max_valid", F.coalesce(F.col("p_th") > F.col("p_max_valid"), F.lit(True)).alias("bounded"))


@query(f"""WITH {X.SHOTS}, channels AS (SELECT DISTINCT channel AS c FROM shots), spec AS (SELECT 0 AS c, run, w, count(*) AS t, count(*) FILTER (fail) AS f FROM shots GROUP BY run, w
    UNION ALL SELECT c, run, w, count(*), count(*) FILTER (fail) FROM shots, channels WHERE channel <> c GROUP BY c, run, w), {X.GRID},
    l AS (SELECT c, run, p, {X.LER} AS ler, {X.SE} AS se FROM spec, grid GROUP BY c, run, p)
    SELECT CAST(a.c AS BIGINT) AS channel, a.run, a.p, round(1 - a.ler / b.ler, 8) AS marginal, round(a.ler / b.ler * sqrt(pow(a.se / a.ler, 2) + pow(b.se / b.ler, 2)), 8) AS sigma
    FROM l a JOIN l b ON a.run = b.run AND a.p = b.p AND b.c = 0 WHERE a.c <> 0""")
def marginal_curves(spark, sf):
    """What each channel's absence takes off the rate, as a part of it, with its error, for two codes along the grid."""
    shots = X.shots(spark, sf)
    channels = shots.select(F.col("channel").alias("c")).distinct()  # seven values
    without = shots.join(F.broadcast(channels), F.col("channel") != F.col("c"))
    l = S.reweight(S.failure_spectrum(without.unionByName(shots.withColumn("c", F.lit(0))), ["c", "run"]), X.grid(spark), X.N, ["c", "run"])  # noqa: E741
    whole = l.filter("c = 0").select("run", "p", F.col("ler").alias("l0"), F.col("ler_se").alias("s0"))
    both = l.filter("c <> 0").join(whole, ["run", "p"])
    ratio = F.col("ler") / F.col("l0")
    return both.select(F.col("c").cast("long").alias("channel"), "run", "p", F.round(1 - ratio, 8).alias("marginal"), F.round(ratio * F.hypot(F.col("ler_se") / F.col("ler"), F.col("s0") / F.col("l0")), 8).alias("sigma"))


GATES = (("enough weights", True, "count(*) >= 20"), ("trials at every weight", True, "min(t) > 0"), ("zero bins below half", False, "avg(CASE WHEN f = 0 THEN 1.0 ELSE 0.0 END) < 0.5"), ("failures grow", False, "max(CASE WHEN f > 0 THEN w END) > min(CASE WHEN f > 0 THEN w END)"))


@query(f"WITH {P.RUNS}, " + ", ".join(f"g{i} AS (SELECT run, '{label}' AS label, {str(hard).lower()} AS hard, {expr} AS ok FROM spec GROUP BY run)" for i, (label, hard, expr) in enumerate(GATES)) + ", gates AS (" + " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(len(GATES))) + ") SELECT run, label, hard, coalesce(ok, false) AS ok, bool_and(coalesce(ok, false) OR NOT hard) OVER (PARTITION BY run) AS passed FROM gates")
def quality_gates(spark, sf):
    """Hard and soft gates of each run, one aggregate; a run passes if no hard gate fails."""
    table = P._runs(spark, sf).groupBy("run").agg(*(F.expr(expr).alias(f"g{i}") for i, (_, _, expr) in enumerate(GATES)))
    rows = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(hard).alias("hard"), F.coalesce(F.col(f"g{i}"), F.lit(False)).alias("ok")) for i, (label, hard, _) in enumerate(GATES)))
    gates = table.select("run", F.explode(rows).alias("g")).select("run", "g.*")
    return gates.withColumn("passed", F.min((F.col("ok") | ~F.col("hard")).cast("int")).over(W.partitionBy("run")) == 1)


@query(f"WITH {P.ABLATED}, sums AS (SELECT sum(contribution) AS total, max(whole) AS whole, sqrt(sum(sigma * sigma)) AS sigma FROM parts) SELECT round(total, 7) AS total, round(whole, 7) AS whole, round(sigma, 7) AS sigma, abs(total - whole) <= greatest(3 * sigma, 0.2 * whole) AS adds_up FROM sums")
def decomposition_identity(spark, sf):
    """Whether the channels' contributions add up to the whole, within three sigmas or a fifth."""
    s = P._ablations(spark, sf).agg(F.sum("contribution").alias("total"), F.max("whole").alias("whole"), F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))).alias("sigma"))
    holds = F.abs(F.col("total") - F.col("whole")) <= F.greatest(3 * F.col("sigma"), 0.2 * F.col("whole"))
    return s.select(*P._r("total", "whole", "sigma", digits=7), holds.alias("adds_up"))


@query(f"""WITH {P.RUNS}, {X.filled('spec', 'full_spec', 'run')}, stats AS (SELECT run, {X.LER} AS ler, {X.SE} AS ler_se, {X.HEAD} AS headroom FROM full_spec, (SELECT CAST({POINT} AS DOUBLE) AS p) GROUP BY run)
    SELECT run, round(ler, 9) AS ler, round(ler_se, 9) AS ler_se, round(headroom, 9) AS headroom, round((SELECT ler FROM stats WHERE run = 'F') / ler, 8) AS improvement FROM stats""")
def decoder_anchors(spark, sf):
    """Rate, error and headroom of each decoder generation (run) at one rate, and how far it betters the first."""
    stats = _at_point(spark, P._runs(spark, sf), ["run"])
    first = stats.filter("run = 'F'").select(F.col("ler").alias("l0"))
    return stats.join(F.broadcast(first), F.lit(True)).select("run", *P._r("ler", "ler_se", "headroom"), F.round(F.col("l0") / F.col("ler"), 8).alias("improvement"))


SUMMARY = f"""WITH {X.SHOTS}, spec AS (SELECT channel, w, count(*) AS t, count(*) FILTER (fail) AS f FROM shots GROUP BY channel, w), {X.filled('spec', 'full_spec', 'channel')},
    stats AS (SELECT channel, {X.LER} AS ler, {X.SE} AS ler_se, {X.HEAD} AS headroom FROM full_spec, (SELECT CAST({POINT} AS DOUBLE) AS p) GROUP BY channel),
    bins AS (SELECT channel, min(w) FILTER (f > 0) AS onset, sum(t) AS shots, avg(CASE WHEN f = 0 THEN 1.0 ELSE 0.0 END) AS zero_bins, pow((-4 + sqrt(16 + 4 * max(w))) / 2, 2) / {X.N} AS p_max FROM spec GROUP BY channel),
    kind AS (SELECT channel, CASE WHEN channel = 1 THEN 12 WHEN channel <= 4 THEN 7 ELSE 6 END AS cycles FROM bins)"""


@query(SUMMARY + f""" SELECT CAST(channel AS BIGINT) AS operation, CAST(cycles AS BIGINT) AS cycles, CAST(onset AS BIGINT) AS onset, CAST(shots AS BIGINT) AS shots, round(ler, 9) AS ler, round(ler_se, 9) AS ler_se, round(headroom, 9) AS headroom,
    round(1 - pow(1 - least(greatest(ler, 0), 1 - 1e-12), 1.0::DOUBLE / cycles), 9) AS eps, round(zero_bins, 6) AS zero_bins, round(p_max, 9) AS p_max, p_max >= {POINT} AS quotable FROM stats JOIN bins USING (channel) JOIN kind USING (channel)""")
def operation_summary(spark, sf):
    """One row for each operation: cycles that its kind counts, onset, rate with error and headroom, rate per cycle, and whether its window lets the rate be quoted."""
    spec = S.failure_spectrum(X.shots(spark, sf), ["channel"])
    bins = spec.groupBy("channel").agg(F.min(F.when(F.col("f") > 0, F.col("w"))).alias("onset"), F.sum("t").alias("shots"), F.avg(F.when(F.col("f") == 0, 1.0).otherwise(0.0)).alias("zero_bins"), (F.pow((-4 + F.sqrt(16 + 4 * F.max("w"))) / 2, 2) / X.N).alias("p_max"))
    cycles = cycles_of(F.when(F.col("channel") == 1, "lpu_idle").when(F.col("channel") <= 4, "joint_pauli").otherwise("memory"), F.when(F.col("channel") > 4, 6), F.lit(7))
    both = bins.join(_at_point(spark, spec, ["channel"]), "channel").withColumn("cycles", cycles)
    eps = 1 - F.pow(1 - F.least(F.greatest("ler", F.lit(0.0)), F.lit(1 - 1e-12)), 1.0 / F.col("cycles"))
    return both.select(F.col("channel").cast("long").alias("operation"), F.col("cycles").cast("long"), F.col("onset").cast("long"), F.col("shots").cast("long"), *P._r("ler", "ler_se", "headroom"), F.round(eps, 9).alias("eps"), F.round("zero_bins", 6).alias("zero_bins"), F.round("p_max", 9).alias("p_max"), (F.col("p_max") >= POINT).alias("quotable"))


def cycles_of(experiment, rounds, measured):
    """Cycles that a rate is divided by: an idle unit's rounds (12 unless given), an operation's measured rounds, a memory's rounds."""
    operation = experiment.startswith("lpu") | experiment.isin("automorphism", "joint_pauli", "inter_module")
    return F.when(experiment == "lpu_idle", F.coalesce(rounds, F.lit(12))).when(operation, measured).otherwise(rounds)


@query(f"""WITH {X.GRID}, l AS (SELECT lgamma({X.N + 1}) - lgamma({W0 + 1}) - lgamma({X.N - W0 + 1}) AS lc) SELECT p, round(0.0000001 * exp(lc + {W0} * ln(p) + ({X.N - W0}) * ln(1 - p)), 12) AS leading, round(0.001 * pow(p / 0.001, {W0}), 12) AS anchored FROM grid, l""")
def onset_asymptotes(spark, sf):
    """The leading term f0 C(N, w0) q^w0 (1 - q)^(N - w0), and the power law through a given point."""
    from raretide.functions.numeric import binomial_weight, log_choose

    rows = log_choose(X.grid(spark).withColumn("w", F.lit(W0)), X.N)
    return rows.select("p", F.round(1e-7 * binomial_weight(F.col("log_c"), F.col("w"), X.N, F.col("p")), 12).alias("leading"), F.round(0.001 * F.pow(F.col("p") / 0.001, F.lit(W0)), 12).alias("anchored"))


@query(f"WITH {X.MECH}, {X.GRID}, m AS (SELECT sum(p) AS s FROM mech) SELECT grid.p, round(s * grid.p / 0.001, 8) AS faults FROM grid, m")
def expected_faults(spark, sf):
    total = X.mechanisms(spark, sf).agg(F.sum("p").alias("s"))
    return X.grid(spark).join(F.broadcast(total), F.lit(True)).select("p", F.round(F.col("s") * F.col("p") / 0.001, 8).alias("faults"))


DETS = "dets AS (SELECT mech, p, obs, unnest([i FOR i IN range(0, 8) IF (det >> i) & 1 = 1]) AS d FROM mech)"


def _detectors(mechs):
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.call_function("shiftright", F.col("det"), i).bitwiseAND(F.lit(1).cast("long")) == 1)
    return mechs.withColumn("dets", bits)


@query(f"WITH {X.MECH}, {DETS} SELECT mech, round(max(p), 9) AS p, string_agg('t' || CAST(d // 4 AS VARCHAR) || ' c' || CAST(d % 4 AS VARCHAR), ', ' ORDER BY d) AS detectors, max(obs) AS obs FROM dets GROUP BY mech")
def mechanism_cards(spark, sf):
    """Each visible mechanism with its prior, its detectors by cycle and check, and its observables."""
    label = lambda d: F.concat(F.lit("t"), F.floor(d / 4).cast("string"), F.lit(" c"), (d % 4).cast("string"))
    cards = _detectors(X.mechanisms(spark, sf)).filter("size(dets) > 0")
    return cards.select("mech", F.round("p", 9).alias("p"), F.array_join(F.transform("dets", label), ", ").alias("detectors"), "obs")


@query(f"WITH {X.MECH}, {X.CONF}, {DETS}, flips AS (SELECT config, d, count(*) AS n FROM conf JOIN dets USING (mech) GROUP BY config, d HAVING count(*) % 2 = 1) SELECT CAST(d AS BIGINT) AS detector, count(*) AS configurations FROM flips GROUP BY d")
def detector_tally(spark, sf):
    """In how many configurations each detector flips; an even number of flips cancels."""
    rows = X.configurations(spark, sf).join(_detectors(X.mechanisms(spark, sf)).select("mech", F.explode("dets").alias("d")), "mech")
    odd = rows.groupBy("config", "d").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
    return odd.groupBy(F.col("d").cast("long").alias("detector")).agg(F.count(F.lit(1)).alias("configurations"))


@query(f"""WITH {P.RUNS}, {X.GRID}, l AS (SELECT run, p, {X.LER} AS ler FROM spec, grid GROUP BY run, p), steps AS (SELECT run, p, ler, lead(p) OVER o AS p1, lead(ler) OVER o AS l1 FROM l WINDOW o AS (PARTITION BY run ORDER BY p)),
    asked(q) AS (VALUES (CAST(0.0003 AS DOUBLE)), (CAST(0.003 AS DOUBLE))), vals AS (SELECT run, q, ler + (q - p) / (p1 - p) * (l1 - ler) AS v FROM steps JOIN asked ON q >= p AND q < p1)
    SELECT q, round(max(v) FILTER (run = 'F'), 9) AS f, round(max(v) FILTER (run = 'O'), 9) AS o, round(max(v) FILTER (run = 'O') / max(v) FILTER (run = 'F'), 8) AS ratio, max(v) FILTER (run = 'O') / max(v) FILTER (run = 'F') BETWEEN 0.5 AND 2 AS within_two FROM vals GROUP BY q""")
def estimator_table(spark, sf):
    """Estimators (runs) at asked rates, read off their curves in a straight line, with their ratio and whether it is within two."""
    over = W.partitionBy("run").orderBy("p")  # as many rows as the grid has rates
    steps = S.reweight(P._runs(spark, sf), X.grid(spark), X.N, ["run"]).select("run", "p", "ler", F.lead("p").over(over).alias("p1"), F.lead("ler").over(over).alias("l1"))
    asked = spark.createDataFrame([(0.0003,), (0.003,)], "q double")
    at = steps.join(F.broadcast(asked), (F.col("q") >= F.col("p")) & (F.col("q") < F.col("p1"))).withColumn("v", F.col("ler") + (F.col("q") - F.col("p")) / (F.col("p1") - F.col("p")) * (F.col("l1") - F.col("ler")))
    wide = at.groupBy("q").agg(*(F.max(F.when(F.col("run") == r.upper(), F.col("v"))).alias(r) for r in ("f", "o")))
    ratio = F.col("o") / F.col("f")
    return wide.select("q", *P._r("f", "o"), F.round(ratio, 8).alias("ratio"), ratio.between(0.5, 2).alias("within_two"))


@query("SELECT CAST(l_linenumber AS BIGINT) AS quantity, coalesce(CAST(max(l_quantity) FILTER (l_linestatus = 'F') AS VARCHAR), chr(8212)) AS first, coalesce(CAST(max(l_quantity) FILTER (l_linestatus = 'O' AND l_linenumber < 7) AS VARCHAR), chr(8212)) AS second FROM (SELECT l_linenumber, l_linestatus, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem) GROUP BY l_linenumber")
def side_by_side(spark, sf):
    """Two runs in two columns; what one of them lacks is a dash."""
    line = X.read(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("quantity"), "l_linestatus", F.col("l_quantity").cast("long").alias("v"))
    of = lambda when: F.coalesce(F.max(F.when(when, F.col("v"))).cast("string"), F.lit("—"))
    return line.groupBy("quantity").agg(of(F.col("l_linestatus") == "F").alias("first"), of((F.col("l_linestatus") == "O") & (F.col("quantity") < 7)).alias("second"))


@query("SELECT o_orderpriority AS ladder, CAST(sum(l_quantity) AS BIGINT) AS steps, count(DISTINCT l_linenumber) AS levels, CAST(sum(l_quantity) * count(DISTINCT l_linenumber) AS BIGINT) AS decodes FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def ladder_cost(spark, sf):
    """Decodes of a ladder: the chain steps of all its levels, times its instances."""
    both = X.read(spark, sf, "orders").join(X.read(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    n, steps = F.count_distinct("l_linenumber"), F.sum("l_quantity")
    return both.groupBy(F.col("o_orderpriority").alias("ladder")).agg(steps.cast("long").alias("steps"), n.alias("levels"), (steps * n).cast("long").alias("decodes"))


@query()
def exact_intervals(spark, sf):
    """The exact binomial interval of the failures at every weight."""

    @F.pandas_udf("struct<low: double, high: double>")
    def interval(f: pd.Series, t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson(int(a), int(b)) for a, b in zip(f, t, strict=True)], columns=["low", "high"])

    return S.failure_spectrum(X.shots(spark, sf)).withColumn("i", interval("f", "t")).select(F.col("w").cast("long").alias("w"), "t", "f", "i.low", "i.high")


@query(f"""WITH {P.RUNS}, {X.GRID}, l AS (SELECT run, p, {X.LER} AS ler FROM spec, grid GROUP BY run, p) SELECT run, p, round(min(ler) OVER (PARTITION BY p), 9) AS best, round(ler / min(ler) OVER (PARTITION BY p), 8) AS times_best FROM l""")
def family_comparison(spark, sf):
    """Each family's rate against the best at the same physical rate."""
    l = S.reweight(P._runs(spark, sf), X.grid(spark), X.N, ["run"])  # noqa: E741
    best = F.min("ler").over(W.partitionBy("p"))
    return l.select("run", "p", F.round(best, 9).alias("best"), F.round(F.col("ler") / best, 8).alias("times_best"))


@query("""WITH s AS (SELECT user_id AS circuit, event_id AS seq, event_type AS name, lag(event_type) OVER o AS b, lead(event_type) OVER o AS a FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
    marked AS (SELECT circuit, seq, name, CASE WHEN name <> 'error' THEN NULL WHEN b = 'click' THEN 'cz' WHEN a = 'purchase' THEN 'meas' WHEN b = 'signup' THEN 'prep' ELSE 'idle' END AS channel FROM s)
    SELECT circuit, count(*) AS instructions, count(*) FILTER (channel IS NULL OR channel <> 'cz') AS without_cz, count(*) FILTER (channel IS NULL OR channel = 'cz') AS cz_alone FROM marked GROUP BY circuit""")
def channel_ablation_sizes(spark, sf):
    """Instructions of each stream whole, without one channel and with that channel's noise alone."""
    marked = C.classified(X.read(spark, sf, "events").select(F.col("user_id").alias("circuit"), F.col("event_id").alias("seq"), F.col("event_type").alias("name")), **NAMES)
    quiet = F.col("channel").isNull()
    count = lambda when: F.count(F.when(when, 1))
    return marked.groupBy("circuit").agg(F.count(F.lit(1)).alias("instructions"), count(quiet | (F.col("channel") != "cz")).alias("without_cz"), count(quiet | (F.col("channel") == "cz")).alias("cz_alone"))


def first_existing(candidates, found):
    """candidates (name, priority, path), found (path): each name's path of the best priority that exists."""
    return candidates.join(found, "path").groupBy("name").agg(F.min_by("path", "priority").alias("path"))


def translated(specimens, sub, full, dealt=None):
    """Specimens (config, mech of the sub-model) as mechanisms of the full model of the same signature; incomplete ones go.

    The smallest mechanism of a signature is found before the models are joined, so that no pair of equal ones is listed.
    With ``dealt``, specimens are shuffled into as many partitions by config.
    """
    first = full.groupBy("det", "obs").agg(F.min("mech").alias("to"))
    names = sub.select("mech", "det", "obs").join(first, ["det", "obs"]).groupBy("mech").agg(F.min("to").alias("to"))
    joined = parts.dealt(specimens.join(names, "mech", "left"), dealt, "config")
    whole = joined.withColumn("lost", F.max(F.col("to").isNull()).over(W.partitionBy("config")))
    return whole.filter("NOT lost AND config IS NOT NULL").select("config", F.col("to").alias("mech"))


@query(f"""WITH {X.MECH}, {X.CONF}, sub AS (SELECT * FROM mech WHERE p_size <= 40), names AS (SELECT s.mech, min(f.mech) AS "to" FROM sub s JOIN mech f USING (det, obs) GROUP BY s.mech),
    joined AS (SELECT config, "to" FROM conf LEFT JOIN names USING (mech)), whole AS (SELECT config FROM joined GROUP BY config HAVING count(*) = count("to")) SELECT config, "to" AS mech FROM joined JOIN whole USING (config)""")
def specimen_translation(spark, sf):
    """Specimens found in a sub-model, named by the full model's mechanisms of equal signature."""
    mechs = X.mechanisms(spark, sf)
    return translated(X.configurations(spark, sf), mechs.filter("p_size <= 40"), mechs, parts.count(X.configurations(spark, sf)))


@query(f"""WITH {X.CONF} SELECT config, coalesce(nullif(p_brand, 'Brand#11'), 'unknown') AS model, count(*) AS n FROM conf JOIN part ON mech = p_partkey GROUP BY ALL""")
def provenance_backfill(spark, sf):
    """A default where a specimen's provenance is missing."""
    part = X.read(spark, sf, "part").select(F.col("p_partkey").alias("mech"), "p_brand")
    model = F.coalesce(F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")), F.lit("unknown"))
    return X.configurations(spark, sf).join(part, "mech").groupBy("config", model.alias("model")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {X.MECH}, {X.CONF}, odd AS (SELECT config, mech FROM conf GROUP BY config, mech HAVING count(*) % 2 = 1), kept AS (SELECT config, mech FROM odd), dropped AS (SELECT a.config, a.mech AS without, b.mech FROM kept a JOIN kept b ON a.config = b.config AND a.mech <> b.mech)
    SELECT config, without, count(*) AS w, bit_xor(det) AS syndrome, bit_xor(obs) AS truth FROM dropped JOIN mech USING (mech) GROUP BY config, without""")
def drop_one_candidates(spark, sf):
    """Each configuration less one of its mechanisms: what a descent to lighter failures tries next, in one pass."""
    mechs = X.mechanisms(spark, sf).select("mech", "det", "obs")
    odd = dem.parity_members(X.configurations(spark, sf)).join(mechs, "mech")
    whole = odd.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("det").alias("s"), F.bit_xor("obs").alias("o"))
    each = odd.join(whole, "config").filter("n > 1")  # the rest is the whole with one taken out again
    return each.select("config", F.col("mech").alias("without"), (F.col("n") - 1).alias("w"), F.col("s").bitwiseXOR(F.col("det")).alias("syndrome"), F.col("o").bitwiseXOR(F.col("obs")).alias("truth"))
