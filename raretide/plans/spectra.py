"""Queries over failure spectra: aggregation, filling, reweighting, ratios, thresholds and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from raretide.functions.numeric import binomial_weight, clipped, log_choose
from raretide.operators import spectrum as S
from raretide.plans import base as X
from raretide.plans.catalogue import query


def _r(*names: str, digits: int = 9):
    return [F.round(F.col(n), digits).alias(n) for n in names]


def _spec(spark, sf):
    return S.failure_spectrum(X.shots(spark, sf))


def _strided(spark, sf):
    return _spec(spark, sf).filter("w <= 15 OR w % 2 = 0")


def _runs(spark, sf):
    return S.failure_spectrum(X.shots(spark, sf), ["run"])


def _rare(spark, sf):
    return S.failure_spectrum(X.shots(spark, sf).withColumn("fail", F.col("rare")))


STRIDED = f"{X.SPEC}, strided AS (SELECT * FROM spec WHERE w <= 15 OR w % 2 = 0)"
RUNS = f"{X.SHOTS}, spec AS (SELECT run, w, count(*) AS t, count(*) FILTER (fail) AS f FROM shots GROUP BY run, w)"
RARE = f"{X.SHOTS}, spec AS (SELECT w, count(*) AS t, count(*) FILTER (rare) AS f FROM shots GROUP BY w)"
STATS = f"stats AS (SELECT p, {X.LER} AS ler, {X.SE} AS ler_se, {X.HEAD} AS headroom FROM full_spec, grid GROUP BY p)"


@query(f"WITH {X.SPEC} SELECT CAST(w AS BIGINT) AS w, t, f, round(CASE WHEN t = 0 THEN 0 ELSE f / t END, 9) AS rate FROM spec")
def failure_spectrum(spark, sf):
    from raretide.functions.numeric import rate

    return _spec(spark, sf).select(F.col("w").cast("long").alias("w"), "t", "f", F.round(rate(F.col("f"), F.col("t")), 9).alias("rate"))


@query(f"WITH {X.SPEC}, {X.GRID} SELECT p, round({X.LER}, 9) AS ler, round({X.SE}, 9) AS ler_se FROM spec, grid GROUP BY p")
def reweighted_ler(spark, sf):
    return S.reweight(_spec(spark, sf), X.grid(spark), X.N).select("p", *_r("ler", "ler_se"))


@query(f"""WITH {X.SHOTS}, spec AS (SELECT channel, w, count(*) AS t, count(*) FILTER (fail) AS f FROM shots GROUP BY channel, w), {X.GRID}
    SELECT CAST(channel AS BIGINT) AS channel, p, round({X.LER}, 9) AS ler, round({X.SE}, 9) AS ler_se FROM spec, grid GROUP BY channel, p""")
def reweighted_ler_by_channel(spark, sf):
    spec = S.failure_spectrum(X.shots(spark, sf), ["channel"])
    return S.reweight(spec, X.grid(spark), X.N, ["channel"]).select(F.col("channel").cast("long").alias("channel"), "p", *_r("ler", "ler_se"))


@query(f"WITH {STRIDED}, {X.filled('strided', 'full_spec')} SELECT CAST(w AS BIGINT) AS w, t, f FROM full_spec")
def gap_filled_spectrum(spark, sf):
    return S.fill(_strided(spark, sf)).select(F.col("w").cast("long").alias("w"), "t", "f")


@query(f"WITH {STRIDED}, {X.filled('strided', 'full_spec', only='= 2')} SELECT CAST(w AS BIGINT) AS w, t, f FROM full_spec")
def legacy_fill(spark, sf):
    return S.fill(_strided(spark, sf), only_gap=2).select(F.col("w").cast("long").alias("w"), "t", "f")


@query(f"WITH {STRIDED}, {X.filled('strided', 'full_spec')}, {X.GRID} SELECT p, round({X.LER}, 9) AS ler FROM full_spec, grid GROUP BY p")
def filled_ler(spark, sf):
    return S.reweight(S.fill(_strided(spark, sf)), X.grid(spark), X.N).select("p", *_r("ler"))


@query(f"WITH {X.SPEC} SELECT CAST(w AS BIGINT) AS w, t, f FROM spec WHERE w < 10 OR (w - (SELECT min(w) FROM spec)) % 4 = 0 OR w = (SELECT max(w) FROM spec)")
def decimated_spectrum(spark, sf):
    return S.decimate(_spec(spark, sf), 4, 10).select(F.col("w").cast("long").alias("w"), "t", "f")


@query(f"WITH {RUNS} SELECT CAST(w AS BIGINT) AS w, CAST(sum(t) AS BIGINT) AS t, CAST(sum(f) AS BIGINT) AS f FROM spec GROUP BY w")
def pooled_spectrum(spark, sf):
    runs = _runs(spark, sf)
    parts = [runs.filter(F.col("run") == r).drop("run") for r in ("F", "O")]
    return S.pool(*parts, constants=[(X.N, 1.0, 1.0)] * 2).select(F.col("w").cast("long").alias("w"), "t", "f")


@query(f"WITH {RARE}, {X.filled('spec', 'full_spec')}, {X.GRID}, {STATS} SELECT p, round(ler, 12) AS ler, round(ler_se, 12) AS ler_se, round(headroom, 12) AS headroom FROM stats")
def ler_with_headroom(spark, sf):
    return S.with_headroom(_rare(spark, sf), X.grid(spark), X.N).select("p", *_r("ler", "ler_se", "headroom", digits=12))


@query(f"WITH {RARE}, {X.filled('spec', 'full_spec')}, {X.GRID}, {STATS} SELECT p, round({X.EPS}, 12) AS eps, round({X.EPS_SE}, 12) AS eps_se, round({X.EPS_HEAD}, 12) AS eps_headroom FROM stats")
def per_round_eps(spark, sf):
    stats = S.with_headroom(_rare(spark, sf), X.grid(spark), X.N)
    return S.eps(stats, X.ROUNDS).select("p", *_r("eps", "eps_se", "eps_headroom", digits=12))


@query(f"WITH {X.SPEC} SELECT CAST(max(w) AS BIGINT) AS w_max, round(pow((-3 + sqrt(9 + 4 * max(w))) / 2, 2) / {X.N}, 12) AS p_max FROM spec")
def mass_window(spark, sf):
    return S.mass_window(_spec(spark, sf), X.N).select("w_max", *_r("p_max", digits=12))


@query(f"WITH {RARE} SELECT round(avg(CASE WHEN f = 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS zero_fraction, count(*) AS bins FROM spec")
def zero_bin_fraction(spark, sf):
    return S.zero_bins(_rare(spark, sf)).select(*_r("zero_fraction"), "bins")


@query(f"WITH {RARE}, {X.GRID} SELECT p, round(sum(3.0::DOUBLE / t * {X.B}), 12) AS upper FROM spec, grid WHERE f = 0 AND w >= 5 AND t > 0 GROUP BY p")
def rule_of_three(spark, sf):
    return S.rule_of_three(_rare(spark, sf), X.grid(spark), X.N, 5).select("p", *_r("upper", digits=12))


@query(f"""WITH {X.SPEC}, {X.GRID}, g AS (SELECT p, w, {X.RATE} * {X.B} AS g FROM spec, grid),
    cdf AS (SELECT p, w, sum(g) OVER (PARTITION BY p ORDER BY w) / sum(g) OVER (PARTITION BY p) AS cdf FROM g),
    steps AS (SELECT *, lag(w) OVER o AS w1, lag(cdf) OVER o AS c1 FROM cdf WINDOW o AS (PARTITION BY p ORDER BY w)),
    q(q) AS (VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.95 AS DOUBLE)))
    SELECT p, q, round(CASE WHEN c1 IS NULL THEN w ELSE w1 + (q - c1) / (cdf - c1) * (w - w1) END, 6) AS weight FROM steps, q WHERE cdf >= q AND (c1 IS NULL OR c1 < q)""")
def weight_percentiles(spark, sf):
    return S.weight_percentiles(_spec(spark, sf), X.grid(spark), X.N, [0.05, 0.5, 0.95]).select("p", "q", *_r("weight", digits=6))


def _eps_of_runs(spark, sf):
    """Per-round statistics of the small (F) and the large (O) code."""
    stats = S.eps(S.with_headroom(_runs(spark, sf), X.grid(spark), X.N, ["run"]), X.ROUNDS)
    return stats.filter("run = 'F'"), stats.filter("run = 'O'")


EPS_RUNS = f"""{RUNS}, {X.filled('spec', 'full_spec', 'run')}, {X.GRID},
    stats AS (SELECT run, p, {X.LER} AS ler, {X.SE} AS ler_se, {X.HEAD} AS headroom FROM full_spec, grid GROUP BY run, p),
    eps AS (SELECT run, p, {X.EPS} AS e, {X.EPS_SE} AS s, {X.EPS_HEAD} AS h FROM stats),
    pairs AS (SELECT l.p, l.e AS el, l.s AS sl, l.h AS hl, s.e AS es, s.s AS ss, s.h AS hs FROM eps l JOIN eps s USING (p) WHERE l.run = 'O' AND s.run = 'F'),
    inv AS (SELECT p, el / es AS inv_lambda, el / es * sqrt(pow(sl / el, 2) + pow(ss / es, 2)) AS sigma, el / (es + hs) AS lo, (el + hl) / es AS hi FROM pairs)"""


@query(f"WITH {EPS_RUNS} SELECT p, round(inv_lambda, 8) AS inv_lambda, round(sigma, 8) AS sigma, round(lo, 8) AS lo, round(hi, 8) AS hi FROM inv")
def inv_lambda(spark, sf):
    return S.inv_lambda(*_eps_of_runs(spark, sf)).select("p", *_r("inv_lambda", "sigma", "lo", "hi", digits=8))


@query(f"""WITH {EPS_RUNS}, top AS (SELECT min(pow((-3 + sqrt(9 + 4 * m)) / 2, 2) / {X.N}) AS p_max FROM (SELECT run, max(w) AS m FROM spec GROUP BY run))
    SELECT p, round(1 / inv_lambda, 8) AS lambda FROM inv, top WHERE p <= p_max""")
def lambda_curve(spark, sf):
    runs = _runs(spark, sf)
    top = [S.mass_window(runs.filter(F.col("run") == r), X.N) for r in ("F", "O")]
    window = top[0].unionByName(top[1]).agg(F.min("p_max").alias("p_max"))
    curve = S.inv_lambda(*_eps_of_runs(spark, sf)).join(F.broadcast(window), F.col("p") <= F.col("p_max"))
    return curve.select("p", F.round(1 / F.col("inv_lambda"), 8).alias("lambda"))


FINE = "fine(p) AS (SELECT pow(10, -4 + 0.1 * i) FROM range(0, 25) r(i))"


def _fine(spark):
    return spark.range(25).select(F.pow(F.lit(10.0), -4 + 0.1 * F.col("id")).alias("p"))


def _crossing_sql(curve: str) -> str:
    return f"""{curve}, d AS (SELECT p, ln(greatest(y1, 1e-300)) - ln(greatest(y2, 1e-300)) AS d FROM curve),
    steps AS (SELECT p, d, lag(p) OVER (ORDER BY p) AS p0, lag(d) OVER (ORDER BY p) AS d0 FROM d),
    last AS (SELECT * FROM steps WHERE sign(d0) <> sign(d) ORDER BY p DESC LIMIT 1)
    SELECT round(exp(ln(p0) + CASE WHEN d = d0 THEN 0 ELSE d0 / (d0 - d) END * (ln(p) - ln(p0))), 9) AS crossing FROM (SELECT 1) one LEFT JOIN last ON true"""


@query("WITH " + _crossing_sql(f"{RUNS}, {FINE}, l AS (SELECT run, p, {X.LER} AS ler FROM spec, fine GROUP BY run, p), curve AS (SELECT p, a.ler AS y1, b.ler AS y2 FROM l a JOIN l b USING (p) WHERE a.run = 'F' AND b.run = 'O')"))
def crossing(spark, sf):
    l = S.reweight(_runs(spark, sf), _fine(spark), X.N, ["run"])  # noqa: E741
    curve = l.filter("run = 'F'").select("p", F.col("ler").alias("y1")).join(l.filter("run = 'O'").select("p", F.col("ler").alias("y2")), "p")
    return S.crossing(curve).select(*_r("crossing"))


@query("WITH " + _crossing_sql(f"{RARE}, {FINE}, curve AS (SELECT p, {X.LER} AS y1, p AS y2 FROM spec, fine GROUP BY p)"))
def pseudo_threshold(spark, sf):
    curve = S.reweight(_rare(spark, sf), _fine(spark), X.N).select("p", F.col("ler").alias("y1"), F.col("p").alias("y2"))
    return S.crossing(curve).select(*_r("crossing"))


ABLATED = f"""{X.SHOTS}, channels AS (SELECT DISTINCT channel AS c FROM shots), {X.GRID},
    spec AS (SELECT c, run, w, count(*) AS t, count(*) FILTER (fail) AS f FROM shots, channels WHERE channel <> c GROUP BY c, run, w
             UNION ALL SELECT 0, run, w, count(*), count(*) FILTER (fail) FROM shots GROUP BY run, w),
    {X.filled('spec', 'full_spec', 'c, run')},
    stats AS (SELECT c, run, {X.LER} AS ler, {X.SE} AS ler_se, {X.HEAD} AS headroom FROM full_spec, (SELECT CAST(0.005 AS DOUBLE) AS p) GROUP BY c, run),
    eps AS (SELECT c, run, {X.EPS} AS e, {X.EPS_SE} AS s, {X.EPS_HEAD} AS h FROM stats),
    inv AS (SELECT c, l.e / s.e AS v, l.e / s.e * sqrt(pow(l.s / l.e, 2) + pow(s.s / s.e, 2)) AS sigma, l.e / (s.e + s.h) AS lo, (l.e + l.h) / s.e AS hi
            FROM eps l JOIN eps s USING (c) WHERE l.run = 'O' AND s.run = 'F'),
    parts AS (SELECT a.c AS channel, b.v - a.v AS contribution, sqrt(pow(a.sigma, 2) + pow(b.sigma, 2)) AS sigma, b.lo - a.hi AS lo, b.hi - a.lo AS hi, b.v AS whole
              FROM inv a, inv b WHERE a.c <> 0 AND b.c = 0)"""
VERDICT = "CASE WHEN abs(contribution) < 2 * sigma THEN 'consistent with zero' WHEN lo < 0 AND hi > 0 THEN 'unresolved' ELSE 'resolved' END"


def _ablations(spark, sf):
    """Each channel left out in turn: one pass that sends a shot to the other channels' spectra."""
    shots = X.shots(spark, sf)
    channels = shots.select(F.col("channel").alias("c")).distinct()  # seven values
    without = shots.join(F.broadcast(channels), F.col("channel") != F.col("c"))
    spec = S.failure_spectrum(without.unionByName(shots.withColumn("c", F.lit(0))), ["c", "run"])
    point = spark.createDataFrame([(0.005,)], "p double")
    stats = S.eps(S.with_headroom(spec, point, X.N, ["c", "run"]), X.ROUNDS)
    pick = lambda r, s: stats.filter(F.col("run") == r).select("c", *(F.col(x).alias(f"{y}{s}") for x, y in (("eps", "e"), ("eps_se", "s"), ("eps_headroom", "h"))))
    both = pick("O", "l").join(pick("F", "s"), "c")
    v = F.col("el") / F.col("es")
    inv = both.select("c", v.alias("v"), (v * F.hypot(F.col("sl") / F.col("el"), F.col("ss") / F.col("es"))).alias("sg"), (F.col("el") / (F.col("es") + F.col("hs"))).alias("l"), ((F.col("el") + F.col("hl")) / F.col("es")).alias("h"))
    whole = inv.filter("c = 0").select(F.col("v").alias("v0"), F.col("sg").alias("s0"), F.col("l").alias("l0"), F.col("h").alias("h0"))
    parts = inv.filter("c <> 0").join(F.broadcast(whole), F.lit(True))
    return parts.select(F.col("c").cast("long").alias("channel"), (F.col("v0") - F.col("v")).alias("contribution"), F.hypot("sg", "s0").alias("sigma"), (F.col("l0") - F.col("h")).alias("lo"), (F.col("h0") - F.col("l")).alias("hi"), F.col("v0").alias("whole"))


@query(f"WITH {ABLATED} SELECT CAST(channel AS BIGINT) AS channel, round(contribution, 7) AS contribution, round(sigma, 7) AS sigma, round(lo, 7) AS lo, round(hi, 7) AS hi, round(contribution / whole, 7) AS share, round(sum(contribution) OVER (), 7) AS total FROM parts")
def lambda_decomposition(spark, sf):
    return _ablations(spark, sf).select("channel", *_r("contribution", "sigma", "lo", "hi", digits=7), F.round(F.col("contribution") / F.col("whole"), 7).alias("share"), F.round(F.sum("contribution").over(W.partitionBy()), 7).alias("total"))


@query(f"WITH {ABLATED} SELECT CAST(channel AS BIGINT) AS channel, {VERDICT} AS verdict FROM parts")
def verdicts(spark, sf):
    return _ablations(spark, sf).select("channel", S.verdict(*(F.col(c) for c in ("contribution", "sigma", "lo", "hi"))).alias("verdict"))


@query(f"""WITH {X.SHOTS}, spec AS (SELECT channel, w, count(*) AS t, count(*) FILTER (fail) AS f FROM shots GROUP BY channel, w),
    l AS (SELECT channel, sum({X.RATE} * {X.B}) AS ler FROM spec, (SELECT CAST(0.005 AS DOUBLE) AS p) GROUP BY channel),
    named AS (SELECT channel, CASE WHEN channel <= 2 THEN 'spam' WHEN channel <= 4 THEN 'idle' ELSE 'gate' END AS class, ler FROM l)
    SELECT coalesce(class, 'total') AS class, coalesce(CAST(channel AS BIGINT), -1) AS channel, round(sum(ler), 9) AS ler, round(sum(ler) / (SELECT sum(ler) FROM l), 9) AS share FROM named GROUP BY ROLLUP(class, channel)""")
def error_budget(spark, sf):
    point = spark.createDataFrame([(0.005,)], "p double")
    l = S.reweight(S.failure_spectrum(X.shots(spark, sf), ["channel"]), point, X.N, ["channel"])  # noqa: E741
    named = l.select("channel", F.when(F.col("channel") <= 2, "spam").when(F.col("channel") <= 4, "idle").otherwise("gate").alias("class"), "ler")
    whole = named.agg(F.sum("ler").alias("whole"))
    rolled = named.rollup("class", "channel").agg(F.sum("ler").alias("ler")).join(F.broadcast(whole), F.lit(True))
    return rolled.select(F.coalesce("class", F.lit("total")).alias("class"), F.coalesce(F.col("channel").cast("long"), F.lit(-1).cast("long")).alias("channel"), F.round("ler", 9).alias("ler"), F.round(F.col("ler") / F.col("whole"), 9).alias("share"))


@query(f"""WITH {RUNS}, both_runs AS (SELECT a.w, a.f / a.t AS fa, b.f / b.t AS fb FROM spec a JOIN spec b USING (w) WHERE a.run = 'F' AND b.run = 'O' AND a.f > 0 AND b.f > 0)
    SELECT CAST(w AS BIGINT) AS w, round(fb / fa, 9) AS ratio FROM both_runs QUALIFY row_number() OVER (ORDER BY w) <= 4""")
def ab_ratio(spark, sf):
    runs = _runs(spark, sf).filter("f > 0").withColumn("r", F.col("f") / F.col("t"))
    both = runs.filter("run = 'F'").select("w", F.col("r").alias("a")).join(runs.filter("run = 'O'").select("w", F.col("r").alias("b")), "w")
    return both.orderBy("w").limit(4).select(F.col("w").cast("long").alias("w"), F.round(F.col("b") / F.col("a"), 9).alias("ratio"))


@query(f"""WITH {RUNS} SELECT CAST(w AS BIGINT) AS w, round((b.f / b.t - a.f / a.t) / sqrt(greatest(a.f, 1) / (a.t * a.t)::DOUBLE + greatest(b.f, 1) / (b.t * b.t)::DOUBLE), 8) AS z
    FROM spec a JOIN spec b USING (w) WHERE a.run = 'F' AND b.run = 'O' AND a.t > 0 AND b.t > 0""")
def device_ratio_z(spark, sf):
    runs = _runs(spark, sf).select("run", "w", (F.col("f") / F.col("t")).alias("r"), (F.greatest(F.col("f"), F.lit(1)) / (F.col("t") * F.col("t"))).alias("v"))
    both = runs.filter("run = 'F'").select("w", F.col("r").alias("ra"), F.col("v").alias("va")).join(runs.filter("run = 'O'").select("w", F.col("r").alias("rb"), F.col("v").alias("vb")), "w")
    return both.select(F.col("w").cast("long").alias("w"), F.round((F.col("rb") - F.col("ra")) / F.sqrt(F.col("va") + F.col("vb")), 8).alias("z"))


@query(f"""WITH {X.SPEC}, target(target) AS (SELECT unnest(range(1, 61, 6))),
    near AS (SELECT target, w, ln(f / t) AS y FROM spec, target WHERE f > 0 AND f < t AND w <> target QUALIFY row_number() OVER (PARTITION BY target ORDER BY abs(w - target), w) <= 4)
    SELECT CAST(target AS BIGINT) AS target, round(greatest(least(exp(regr_intercept(y, w) + regr_slope(y, w) * target), 1), 1e-12), 9) AS predicted FROM near GROUP BY target""")
def predicted_fraction(spark, sf):
    target = spark.range(1, 61, 6).select(F.col("id").alias("target"))
    usable = _spec(spark, sf).filter("f > 0 AND f < t").select("w", F.log(F.col("f") / F.col("t")).alias("y"))
    nearest = W.partitionBy("target").orderBy(F.abs(F.col("w") - F.col("target")), "w")
    near = usable.join(F.broadcast(target), F.col("w") != F.col("target")).withColumn("nth", F.row_number().over(nearest)).filter("nth <= 4")
    line = near.groupBy("target").agg(F.regr_intercept("y", "w").alias("a"), F.regr_slope("y", "w").alias("b"))
    return line.select("target", F.round(F.greatest(F.least(F.exp(F.col("a") + F.col("b") * F.col("target")), F.lit(1.0)), F.lit(1e-12)), 9).alias("predicted"))


@query(f"WITH {X.SPEC} SELECT CAST(w AS BIGINT) AS w, CAST(CASE WHEN f = 0 THEN 100000 ELSE least(greatest(ceil(50 / (f / t)), 200), 100000) END AS BIGINT) AS shots FROM spec")
def adaptive_shots(spark, sf):
    wanted = F.least(F.greatest(F.ceil(50 / (F.col("f") / F.col("t"))), F.lit(200)), F.lit(100000))
    return _spec(spark, sf).select(F.col("w").cast("long").alias("w"), F.when(F.col("f") == 0, F.lit(100000)).otherwise(wanted).cast("long").alias("shots"))


@query(f"WITH {X.SPEC}, {X.GRID}, g AS (SELECT p, w, {X.RATE} * {X.B} AS g FROM spec, grid) SELECT p, round(CASE WHEN sum(g) < 1e-290 THEN min(w) ELSE sum(w * g) / sum(g) END, 8) AS mean_weight FROM g GROUP BY p")
def mean_failure_weight(spark, sf):
    from raretide.functions.numeric import rate

    at = S.weights_at(_spec(spark, sf), X.grid(spark), X.N).withColumn("g", rate(F.col("f"), F.col("t")) * F.col("b"))
    return at.groupBy("p").agg(F.round(F.when(F.sum("g") < 1e-290, F.min("w").cast("double")).otherwise(F.sum(F.col("w") * F.col("g")) / F.sum("g")), 8).alias("mean_weight"))


@query(f"WITH {X.SPEC}, {X.GRID}, l AS (SELECT p, {X.LER} AS ler FROM spec, grid GROUP BY p) SELECT p, round(ln(ler / lag(ler) OVER (ORDER BY p)) / ln(p / lag(p) OVER (ORDER BY p)), 8) AS slope FROM l QUALIFY lag(p) OVER (ORDER BY p) IS NOT NULL")
def loglog_slope(spark, sf):
    over = W.orderBy("p")
    l = S.reweight(_spec(spark, sf), X.grid(spark), X.N).select("p", "ler", F.lag("p").over(over).alias("p0"), F.lag("ler").over(over).alias("l0"))  # noqa: E741
    return l.filter("p0 IS NOT NULL").select("p", F.round(F.log(F.col("ler") / F.col("l0")) / F.log(F.col("p") / F.col("p0")), 8).alias("slope"))


@query(f"""WITH {RUNS}, {X.GRID}, l AS (SELECT run, p, {X.LER} AS ler, {X.SE} AS se FROM spec, grid GROUP BY run, p)
    SELECT p, round(abs(a.ler - b.ler) / sqrt(a.se * a.se + b.se * b.se), 8) AS z FROM l a JOIN l b USING (p) WHERE a.run = 'F' AND b.run = 'O'""")
def is_vs_mc_z(spark, sf):
    l = S.reweight(_runs(spark, sf), X.grid(spark), X.N, ["run"])  # noqa: E741
    a, b = (l.filter(F.col("run") == r).select("p", F.col("ler").alias(f"l{r}"), F.col("ler_se").alias(f"s{r}")) for r in ("F", "O"))
    return a.join(b, "p").select("p", F.round(F.abs(F.col("lF") - F.col("lO")) / F.hypot("sF", "sO"), 8).alias("z"))


@query(f"""WITH {STRIDED}, {X.filled('strided', 'full_spec')}, {X.GRID}, gaps AS (SELECT median(g) AS spacing FROM (SELECT lead(w) OVER (ORDER BY w) - w AS g FROM strided)),
    a AS (SELECT p, {X.LER} AS raw FROM strided, grid GROUP BY p), b AS (SELECT p, {X.LER} AS filled FROM full_spec, grid GROUP BY p)
    SELECT p, round(spacing, 3) AS spacing, round(raw, 9) AS raw, round(filled, 9) AS filled, round(raw / filled, 8) AS ratio FROM a JOIN b USING (p), gaps""")
def stride_audit(spark, sf):
    spec = _strided(spark, sf)
    spacing = spec.select((F.lead("w").over(W.orderBy("w")) - F.col("w")).alias("g")).agg(F.median("g").alias("spacing"))
    raw = S.reweight(spec, X.grid(spark), X.N).select("p", F.col("ler").alias("raw"))
    filled = S.reweight(S.fill(spec), X.grid(spark), X.N).select("p", F.col("ler").alias("filled"))
    return raw.join(filled, "p").join(F.broadcast(spacing), F.lit(True)).select("p", *_r("spacing", digits=3), *_r("raw", "filled"), F.round(F.col("raw") / F.col("filled"), 8).alias("ratio"))


ANSATZ = "0.5::DOUBLE * (1 - exp(-(0.01::DOUBLE / 0.5 * pow(w / 3.0::DOUBLE, 4))))"


def ansatz(w, w0: float, f0: float, a: float, gamma: float):
    """a (1 - exp(-(f0 / a) (w / w0)**gamma)) from w0 on, 0 below: the three-parameter failure spectrum."""
    return F.when(w < w0, 0.0).otherwise(a * (1 - F.exp(-(f0 / a) * F.pow(w / w0, F.lit(gamma)))))


@query(f"SELECT w, round(CASE WHEN w < 3 THEN 0 ELSE {ANSATZ} END, 9) AS f FROM range(0, 61) r(w)")
def ansatz_curve(spark, sf):
    return spark.range(61).select(F.col("id").alias("w"), F.round(ansatz(F.col("id"), 3.0, 0.01, 0.5, 4.0), 9).alias("f"))


@query(f"WITH {X.GRID} SELECT p, round(sum({ANSATZ} * {X.B}), 9) AS ler FROM range(3, {X.N + 1}) r(w), grid GROUP BY p")
def ansatz_extrapolation(spark, sf):
    bins = log_choose(spark.range(3, X.N + 1).select(F.col("id").alias("w")), X.N).join(F.broadcast(X.grid(spark)), F.lit(True))
    term = ansatz(F.col("w"), 3.0, 0.01, 0.5, 4.0) * binomial_weight(F.col("log_c"), F.col("w"), X.N, clipped(F.col("p")))
    return bins.groupBy("p").agg(F.round(F.sum(term), 9).alias("ler"))
