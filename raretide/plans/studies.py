"""Queries over whole studies: sampling plans, decoder ensembles, gates, audits, polynomials and noise rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raretide.functions import parts
from raretide.functions.numeric import rate
from raretide.operators import circuit as C
from raretide.operators import dem
from raretide.operators import spectrum as S
from raretide.plans import base as X
from raretide.plans.catalogue import query
from raretide.plans.relations import NAMES, SYND


def _spec(spark, sf):
    return S.failure_spectrum(X.shots(spark, sf))


@query(f"WITH {X.MECH}, m AS (SELECT sum(p) * 0.02 / 1.0::DOUBLE AS mu FROM mech) SELECT unnest(range(1, CAST(greatest(10, ceil(mu + 4 * sqrt(mu))) AS BIGINT) + 1)) AS w FROM m")
def weight_window(spark, sf):
    """Weights 1 .. max(10, ceil(mu + 4 sqrt(mu))) for the mean weight at the largest rate."""
    mu = X.mechanisms(spark, sf).agg((F.sum("p") * 0.02).alias("mu"))
    return mu.select(F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(10), F.ceil(F.col("mu") + 4 * F.sqrt("mu"))).cast("long"))).alias("w"))


@query(f"WITH {X.SPEC}, top AS (SELECT max(w) AS hi FROM spec) SELECT w FROM top, LATERAL (SELECT unnest(range(1, hi + 1)) AS w) WHERE w <= 15 OR w % 2 = 0")
def dense_then_strided_plan(spark, sf):
    top = _spec(spark, sf).agg(F.max("w").cast("long").alias("hi"))
    return top.select(F.explode(F.concat(F.sequence(F.lit(1).cast("long"), F.least(F.lit(15), "hi")), F.when(F.col("hi") >= 16, F.sequence(F.lit(16).cast("long"), F.col("hi"), F.lit(2).cast("long"))).otherwise(F.array().cast("array<long>")))).alias("w"))


@query(f"""WITH {X.SHOTS}, spec AS (SELECT w, count(*) AS t, count(*) FILTER (rare) AS f FROM shots GROUP BY w), o AS (SELECT min(w) FILTER (f > 0) AS onset FROM spec)
    SELECT CAST(onset AS BIGINT) AS onset, CAST((SELECT max(w) FROM spec WHERE f = 0 AND (w < onset OR onset IS NULL)) AS BIGINT) AS last_zero FROM o""")
def onset_scan(spark, sf):
    spec = S.failure_spectrum(X.shots(spark, sf).withColumn("fail", F.col("rare")))
    onset = spec.agg(F.min(F.when(F.col("f") > 0, F.col("w"))).alias("onset"))
    both = spec.join(F.broadcast(onset), F.lit(True))
    return both.agg(F.max("onset").cast("long").alias("onset"), F.max(F.when((F.col("f") == 0) & (F.col("onset").isNull() | (F.col("w") < F.col("onset"))), F.col("w"))).cast("long").alias("last_zero"))


MEMBERS = "members AS (SELECT l_orderkey AS shot, l_linenumber AS member, l_returnflag <> 'N' AS valid, l_extendedprice AS score, l_linestatus AS answer, CAST(l_quantity AS BIGINT) AS w FROM lineitem)"


def _members(spark, sf):
    """Each shot's ensemble: whether a member's answer meets the syndrome, its likelihood, its answer."""
    line = X.read(spark, sf, "lineitem")
    return line.select(F.col("l_orderkey").alias("shot"), F.col("l_linenumber").alias("member"), (F.col("l_returnflag") != "N").alias("valid"), F.col("l_extendedprice").alias("score"), F.col("l_linestatus").alias("answer"), F.col("l_quantity").cast("long").alias("w"))


WINNERS = f"{MEMBERS}, winners AS (SELECT shot, member, answer, valid FROM members QUALIFY row_number() OVER (PARTITION BY shot ORDER BY valid DESC, CASE WHEN valid THEN score END DESC NULLS LAST, member, score DESC, answer) = 1)"


def _winners(spark, sf):
    """The likeliest valid member, the earlier one on ties; without a valid one the first."""
    order = W.partitionBy("shot").orderBy(F.col("valid").desc(), F.when(F.col("valid"), F.col("score")).desc_nulls_last(), "member", F.col("score").desc(), "answer")
    return _members(spark, sf).withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("shot", "member", "answer", "valid")


@query(f"WITH {WINNERS} SELECT shot, CAST(member AS BIGINT) AS winner, answer, valid AS any_valid FROM winners")
def ensemble_winner(spark, sf):
    return _winners(spark, sf).select("shot", F.col("member").cast("long").alias("winner"), "answer", F.col("valid").alias("any_valid"))


@query(f"WITH {WINNERS} SELECT CAST(member AS BIGINT) AS member, count(*) AS wins FROM winners GROUP BY member")
def winner_histogram(spark, sf):
    return _winners(spark, sf).groupBy(F.col("member").cast("long").alias("member")).agg(F.count(F.lit(1)).alias("wins"))


@query(f"WITH {WINNERS} SELECT CAST(m.member AS BIGINT) AS member, count(*) AS shots, round(avg(CASE WHEN m.answer <> w.answer THEN 1.0::DOUBLE ELSE 0 END), 9) AS disagreement FROM members m JOIN winners w USING (shot) GROUP BY m.member")
def decoder_disagreement(spark, sf):
    best = _winners(spark, sf).select("shot", F.col("answer").alias("best"))
    both = _members(spark, sf).join(best, "shot")
    return both.groupBy(F.col("member").cast("long").alias("member")).agg(F.count(F.lit(1)).alias("shots"), F.round(F.avg(F.when(F.col("answer") != F.col("best"), 1.0).otherwise(0.0)), 9).alias("disagreement"))


@query(f"WITH {MEMBERS} SELECT w, CAST(member AS BIGINT) AS member, count(*) AS shots, count(*) FILTER (NOT valid) AS fails FROM members GROUP BY w, member")
def member_failures_by_weight(spark, sf):
    return _members(spark, sf).groupBy("w", F.col("member").cast("long").alias("member")).agg(F.count(F.lit(1)).alias("shots"), F.count(F.when(~F.col("valid"), 1)).alias("fails"))


@query(f"WITH {MEMBERS}, s AS (SELECT shot, bool_or(NOT valid) AS either, bool_and(NOT valid) AS every FROM members GROUP BY shot) SELECT count(*) AS shots, count(*) FILTER (either) AS any_fails, count(*) FILTER (every) AS oracle_fails, count(*) FILTER (either AND NOT every) AS flaky FROM s")
def portfolio_certificate(spark, sf):
    s = _members(spark, sf).groupBy("shot").agg(F.bool_or(~F.col("valid")).alias("either"), F.bool_and(~F.col("valid")).alias("every"))
    n = lambda c: F.count(F.when(c, 1))
    return s.agg(F.count(F.lit(1)).alias("shots"), n(F.col("either")).alias("any_fails"), n(F.col("every")).alias("oracle_fails"), n(F.col("either") & ~F.col("every")).alias("flaky"))


@query(f"WITH {MEMBERS}, p AS (SELECT a.w, a.valid AS va, b.valid AS vb FROM members a JOIN members b ON a.shot = b.shot WHERE a.member = 1 AND b.member = 2) SELECT coalesce(w, -1) AS w, count(*) FILTER (va AND NOT vb) AS b01, count(*) FILTER (NOT va AND vb) AS b10 FROM p GROUP BY ROLLUP (w)")
def mcnemar_by_weight(spark, sf):
    """Two members on the same shots, by weight and over all."""
    m = _members(spark, sf)
    pairs = m.filter("member = 1").select("shot", "w", F.col("valid").alias("va")).join(m.filter("member = 2").select("shot", F.col("valid").alias("vb")), "shot")
    rolled = pairs.rollup("w").agg(F.count(F.when(F.col("va") & ~F.col("vb"), 1)).alias("b01"), F.count(F.when(~F.col("va") & F.col("vb"), 1)).alias("b10"))
    return rolled.select(F.coalesce("w", F.lit(-1).cast("long")).alias("w"), "b01", "b10")


@query(f"""WITH {X.MECH}, {X.CONF}, odd AS (SELECT config, mech FROM conf GROUP BY config, mech HAVING count(*) % 2 = 1), m AS (SELECT mech, CAST(greatest(round_even(p / (SELECT min(p) FROM mech), 0), 1) AS BIGINT) AS m FROM mech)
    SELECT w, round(log10(sum(prod)), 8) AS log10_expanded, count(*) AS supports FROM (SELECT config, count(*) AS w, product(m) AS prod FROM odd JOIN m USING (mech) GROUP BY config) GROUP BY w""")
def expanded_count(spark, sf):
    """Configurations that the supports stand for: exact products of multiplicities, in decimals."""
    m = dem.multiplicities(X.mechanisms(spark, sf))
    rows = dem.parity_members(X.configurations(spark, sf)).join(m, "mech").groupBy("config").agg(F.collect_list("m").alias("ms"))
    product = F.aggregate("ms", F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))
    return rows.select(F.size("ms").cast("long").alias("w"), product.alias("n")).groupBy("w").agg(F.round(F.log10(F.sum("n").cast("double")), 8).alias("log10_expanded"), F.count(F.lit(1)).alias("supports"))


@query(f"WITH {SYND}, classes AS (SELECT syndrome, truth, count(*) AS rho FROM synd GROUP BY ALL), v AS (SELECT sum(fails) AS fails FROM (SELECT sum(rho) - max(rho) AS fails FROM classes GROUP BY syndrome)) SELECT CAST(fails AS BIGINT) AS fails, round((ln(fails) - (lgamma({X.N} + 1) - lgamma(3 + 1) - lgamma({X.N} - 3 + 1))) / ln(10), 8) AS log10_f0 FROM v")
def onset_fraction(spark, sf):
    """Failing sets of onset weight 3 as part of all C(N, 3)."""
    votes = dem.class_votes(dem.syndromes(X.configurations(spark, sf), X.mechanisms(spark, sf)).withColumn("rho", F.lit(1).cast("long")))
    log_c = F.log(F.lit(X.N * (X.N - 1) * (X.N - 2) / 6.0))
    return votes.agg(F.sum("fails").alias("fails")).select("fails", F.round((F.log("fails") - log_c) / F.log(F.lit(10.0)), 8).alias("log10_f0"))


@query(f"WITH {X.CONF}, odd AS (SELECT config, mech FROM conf GROUP BY config, mech HAVING count(*) % 2 = 1), pairs AS (SELECT DISTINCT a.mech AS a, b.mech AS b FROM odd a JOIN odd b ON a.config = b.config AND a.mech < b.mech) SELECT a * 16777216 + b AS packed, a, b FROM pairs")
def packed_restrictions(spark, sf):
    """Pairs as one key of 24 bits each, unpacked again."""
    n = parts.count(X.configurations(spark, sf))
    odd = dem.parity_members(parts.dealt(X.configurations(spark, sf), n, "config"))
    packed = dem.subsets(odd, 2, n).select((F.col("c1") * 16777216 + F.col("c2")).alias("packed"))
    return packed.select("packed", F.shiftright("packed", 24).alias("a"), F.pmod("packed", F.lit(16777216)).alias("b"))


CHAINS = "chains AS (SELECT event_type AS rung, user_id AS walker, avg(value) AS x, count(*) AS n FROM events GROUP BY ALL)"


@query(f"WITH {CHAINS} SELECT rung, count(*) AS walkers, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS spread, round(stddev_samp(x) / sqrt(count(*)) / avg(x), 8) AS relative_se FROM chains GROUP BY rung")
def rung_spread(spark, sf):
    """Mean and spread over walkers of each rung."""
    chains = X.read(spark, sf, "events").groupBy(F.col("event_type").alias("rung"), "user_id").agg(F.avg("value").alias("x"))
    return chains.groupBy("rung").agg(F.count(F.lit(1)).alias("walkers"), F.round(F.avg("x"), 8).alias("mean"), F.round(F.stddev_samp("x"), 8).alias("spread"), F.round(F.stddev_samp("x") / F.sqrt(F.count(F.lit(1))) / F.avg("x"), 8).alias("relative_se"))


@query("""WITH s AS (SELECT event_type AS rung, user_id AS walker, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type, user_id) AS n FROM events)
    SELECT rung, round(max(abs(a - h) / a), 8) AS discrepancy FROM (SELECT rung, walker, avg(value) AS a, avg(value) FILTER (i <= (n + 1) // 2) AS h FROM s GROUP BY rung, walker) WHERE a <> 0 GROUP BY rung""")
def half_chain_discrepancy(spark, sf):
    """How far the first half of each walker is from its whole."""
    one = W.partitionBy("event_type", "user_id")
    s = X.read(spark, sf, "events").select("event_type", "user_id", "value", F.row_number().over(one.orderBy("event_id")).alias("i"), F.count(F.lit(1)).over(one).alias("n"))
    halves = s.groupBy(F.col("event_type").alias("rung"), "user_id").agg(F.avg("value").alias("a"), F.avg(F.when(F.col("i") <= F.expr("(n + 1) div 2"), F.col("value"))).alias("h")).filter("a <> 0")
    return halves.groupBy("rung").agg(F.round(F.max(F.abs(F.col("a") - F.col("h")) / F.col("a")), 8).alias("discrepancy"))


@query(f"""WITH {X.SHOTS}, spec AS (SELECT channel, w, count(*) AS t, count(*) FILTER (rare) AS f FROM shots GROUP BY channel, w)
    SELECT CAST(channel AS BIGINT) AS channel, count(*) AS bins, CAST(sum(t) AS BIGINT) AS trials, round(avg(CASE WHEN f = 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS zero_part, round(pow((-3 + sqrt(9 + 4 * max(w))) / 2, 2) / {X.N}, 12) AS p_max, bool_and(t > 0) AND count(*) >= 40 AS passes FROM spec GROUP BY channel""")
def run_health(spark, sf):
    """Per run: bins, trials, empty bins, the largest supported rate, and the hard gate."""
    spec = S.failure_spectrum(X.shots(spark, sf).withColumn("fail", F.col("rare")), ["channel"])
    root = (F.sqrt(9 + 4 * F.max("w")) - 3) / 2
    return spec.groupBy(F.col("channel").cast("long").alias("channel")).agg(
        F.count(F.lit(1)).alias("bins"), F.sum("t").alias("trials"), F.round(F.avg(F.when(F.col("f") == 0, 1.0).otherwise(0.0)), 9).alias("zero_part"), F.round(root * root / X.N, 12).alias("p_max"), (F.bool_and(F.col("t") > 0) & (F.count(F.lit(1)) >= 40)).alias("passes"),
    )


@query(f"""WITH {X.SHOTS}, spec AS (SELECT run, w, count(*) AS t, count(*) FILTER (fail) AS f FROM shots GROUP BY run, w), {X.GRID}, l AS (SELECT run, p, {X.LER} AS ler FROM spec, grid GROUP BY run, p)
    SELECT p, round(max(ler) FILTER (run = 'F'), 9) AS F, round(max(ler) FILTER (run = 'O'), 9) AS O FROM l GROUP BY p""")
def model_matrix(spark, sf):
    """Rates by p and model, side by side."""
    l = S.reweight(S.failure_spectrum(X.shots(spark, sf), ["run"]), X.grid(spark), X.N, ["run"])  # noqa: E741
    return l.groupBy("p").pivot("run", ["F", "O"]).agg(F.round(F.max("ler"), 9))


def _stride_sql() -> str:
    parts = []
    for s in (2, 3, 4, 5):
        parts.append(f"""dec{s} AS (SELECT * FROM spec WHERE w < 10 OR (w - (SELECT min(w) FROM spec)) % {s} = 0 OR w = (SELECT max(w) FROM spec)),
        {X.filled(f'dec{s}', f'fil{s}')}, err{s} AS (SELECT {s} AS stride, p, {X.LER} AS ler FROM fil{s}, grid GROUP BY p)""")
    return f"WITH {X.SPEC}, {X.GRID}, {', '.join(parts)}, exact AS (SELECT p, {X.LER} AS ler0 FROM spec, grid GROUP BY p) SELECT CAST(stride AS BIGINT) AS stride, p, round(ler / ler0 - 1, 8) + 0.0 AS error FROM ({' UNION ALL '.join(f'SELECT * FROM err{s}' for s in (2, 3, 4, 5))}) JOIN exact USING (p)"


@query(_stride_sql())
def stride_cost(spark, sf):
    """The error that thinning the weights and filling the gaps costs, by stride and rate."""
    spec, grid = _spec(spark, sf), X.grid(spark)
    exact = S.reweight(spec, grid, X.N).select("p", F.col("ler").alias("ler0"))
    out = None
    for s in (2, 3, 4, 5):
        part = S.reweight(S.fill(S.decimate(spec, s, 10)), grid, X.N).select(F.lit(s).cast("long").alias("stride"), "p", "ler")
        out = part if out is None else out.unionByName(part)
    return out.join(exact, "p").select("stride", "p", (F.round(F.col("ler") / F.col("ler0") - 1, 8) + 0.0).alias("error"))


@query(f"""WITH {X.SPEC}, {X.GRID}, l AS (SELECT p, {X.LER} AS ler FROM spec, grid GROUP BY p), steps AS (SELECT p, ler, lead(p) OVER (ORDER BY p) AS p1, lead(ler) OVER (ORDER BY p) AS l1 FROM l), asked(q) AS (VALUES (CAST(0.0002 AS DOUBLE)), (CAST(0.002 AS DOUBLE)), (CAST(0.01 AS DOUBLE)))
    SELECT q, round(exp(ln(ler) + (ln(q) - ln(p)) / (ln(p1) - ln(p)) * (ln(l1) - ln(ler))), 9) AS ler FROM asked JOIN steps ON q >= p AND q < p1""")
def curve_at(spark, sf):
    """A curve between its points, straight in logarithms: each asked rate meets the step around it."""
    l = S.reweight(_spec(spark, sf), X.grid(spark), X.N)  # noqa: E741
    over = W.orderBy("p")  # as many rows as the grid has rates
    steps = l.select("p", "ler", F.lead("p").over(over).alias("p1"), F.lead("ler").over(over).alias("l1"))
    asked = spark.createDataFrame([(0.0002,), (0.002,), (0.01,)], "q double")
    met = steps.join(F.broadcast(asked), (F.col("q") >= F.col("p")) & (F.col("q") < F.col("p1")))
    part = (F.log("q") - F.log("p")) / (F.log("p1") - F.log("p"))
    return met.select("q", F.round(F.exp(F.log("ler") + part * (F.log("l1") - F.log("ler"))), 9).alias("ler"))


@query("SELECT split_part(o_orderpriority, '-', 1) AS task, count(*) AS tasks, round(sum(o_totalprice), 2) AS elapsed, CAST(max(o_orderdate) AS VARCHAR) AS finished FROM orders GROUP BY 1")
def task_catalogue(spark, sf):
    orders = X.read(spark, sf, "orders")
    return orders.groupBy(F.split("o_orderpriority", "-")[0].alias("task")).agg(F.count(F.lit(1)).alias("tasks"), F.round(F.sum("o_totalprice"), 2).alias("elapsed"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("finished"))


@query("SELECT user_id AS circuit, event_id AS seq, event_type AS name, row_number() OVER o - count(*) OVER (PARTITION BY user_id) - 1 AS back FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)")
def relative_record(spark, sf):
    """Each measurement's place counted from the end of its circuit (-1 is the last)."""
    e = X.read(spark, sf, "events").select(F.col("user_id").alias("circuit"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"))
    one = W.partitionBy("circuit")
    return e.select("circuit", "seq", "name", (F.row_number().over(one.orderBy("seq")) - F.count(F.lit(1)).over(one) - 1).alias("back"))


@query("""WITH s AS (SELECT user_id AS circuit, event_id AS seq, event_type AS name, value, lag(event_type) OVER o AS b FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
    SELECT circuit, seq, round(CASE WHEN name = 'error' AND b = 'click' THEN value * 5 ELSE value END, 9) AS rate FROM s""")
def scaled_channel(spark, sf):
    """One channel's rates times five, the others as they are."""
    e = X.read(spark, sf, "events").select(F.col("user_id").alias("circuit"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), "value")
    marked = C.classified(e, **NAMES)
    return marked.select("circuit", "seq", F.round(F.when(F.col("channel") == "cz", F.col("value") * 5).otherwise(F.col("value")), 9).alias("rate"))


@query("""WITH pool AS (SELECT DISTINCT l_suppkey AS q FROM lineitem), layers AS (SELECT DISTINCT l_linenumber AS layer FROM lineitem), active AS (SELECT DISTINCT l_linenumber AS layer, l_suppkey AS q FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
    SELECT CAST(layer AS BIGINT) AS layer, count(*) AS idle FROM (SELECT layer, q FROM layers, pool EXCEPT SELECT layer, q FROM active) GROUP BY layer""")
def idle_qubits(spark, sf):
    """Qubits of the pool that a layer leaves alone: the size of the pool less the layer's active ones; layers that use all are absent."""
    line = X.read(spark, sf, "lineitem")
    pool = line.agg(F.countDistinct("l_suppkey").alias("n"))
    active = line.groupBy(F.col("l_linenumber").cast("long").alias("layer")).agg(F.countDistinct(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), F.col("l_suppkey"))).alias("busy"))
    return active.join(F.broadcast(pool), F.lit(True)).select("layer", (F.col("n") - F.col("busy")).alias("idle")).filter("idle > 0")


POLY_A, POLY_B = [(3, 0), (0, 1), (0, 2)], [(0, 3), (1, 0), (2, 0)]
POLY_SQL = "a(i, j) AS (VALUES (3, 0), (0, 1), (0, 2)), b(i, j) AS (VALUES (0, 3), (1, 0), (2, 0))"


@query(f"WITH {POLY_SQL} SELECT CAST((a.i + b.i) % 6 AS BIGINT) AS i, CAST((a.j + b.j) % 6 AS BIGINT) AS j FROM a, b GROUP BY ALL HAVING count(*) % 2 = 1")
def polynomial_product(spark, sf):
    """Product over GF(2) of two polynomials in x and y with x^6 = y^6 = 1: even multiplicities cancel."""
    a, b = spark.createDataFrame(POLY_A, "i long, j long"), spark.createDataFrame(POLY_B, "i2 long, j2 long")
    terms = a.join(F.broadcast(b), F.lit(True)).select(((F.col("i") + F.col("i2")) % 6).alias("i"), ((F.col("j") + F.col("j2")) % 6).alias("j"))
    return terms.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select("i", "j")


@query(f"WITH {POLY_SQL} SELECT CAST((6 - i) % 6 AS BIGINT) AS i, CAST((6 - j) % 6 AS BIGINT) AS j FROM a")
def polynomial_inverse(spark, sf):
    return spark.createDataFrame(POLY_A, "i long, j long").select(F.pmod(-F.col("i"), F.lit(6)).alias("i"), F.pmod(-F.col("j"), F.lit(6)).alias("j"))


@query(f"WITH {X.SPEC} SELECT CAST(w AS BIGINT) AS w, round(f / t, 9) AS f, round(sqrt(greatest(f / t, 1e-9) * (1 - f / t) / t), 9) AS se FROM spec")
def monte_carlo_error(spark, sf):
    m = rate(F.col("f"), F.col("t"))
    return _spec(spark, sf).select(F.col("w").cast("long").alias("w"), F.round(m, 9).alias("f"), F.round(F.sqrt(F.greatest(m, F.lit(1e-9)) * (1 - m) / F.col("t")), 9).alias("se"))


@query(f"WITH {X.MECH} SELECT p_type AS model, CAST(min(bit_count(det)) AS BIGINT) AS d, count(*) AS mechs, CASE WHEN min(bit_count(det)) <= 1 THEN 'hook' WHEN min(bit_count(det)) <= 2 THEN 'reduced' ELSE 'full' END AS diagnosis FROM mech GROUP BY p_type")
def distance_diagnosis(spark, sf):
    d = F.min(F.bit_count("det"))
    return X.mechanisms(spark, sf).groupBy(F.col("p_type").alias("model")).agg(d.cast("long").alias("d"), F.count(F.lit(1)).alias("mechs"), F.when(d <= 1, "hook").when(d <= 2, "reduced").otherwise("full").alias("diagnosis"))
