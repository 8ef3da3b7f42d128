"""Queries over mechanisms, configurations, instruction streams, codes, graphs, ladders and specimen libraries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raretide.functions import parts
from raretide.operators import circuit as C
from raretide.operators import codes, dem
from raretide.plans import base as X
from raretide.plans.catalogue import query

SYND = f"{X.MECH}, {X.CONF}, synd AS (SELECT config, bit_xor(det) AS syndrome, bit_xor(obs) AS truth FROM conf JOIN mech USING (mech) GROUP BY config)"
ODD = f"{X.CONF}, odd AS (SELECT config, mech FROM conf GROUP BY config, mech HAVING count(*) % 2 = 1)"
SUPPORT = f"{ODD}, support AS (SELECT config, count(*) AS w, string_agg(mech, ',' ORDER BY mech) AS support FROM odd GROUP BY config)"


def _synd(spark, sf):
    return dem.syndromes(X.configurations(spark, sf), X.mechanisms(spark, sf))


def _supports(spark, sf):
    return dem.supports(X.configurations(spark, sf)).select("config", "w", F.array_join(F.col("support").cast("array<string>"), ",").alias("support"))


@query(f"WITH {SYND} SELECT config, syndrome, truth FROM synd")
def syndrome_xor(spark, sf):
    return _synd(spark, sf)


@query(f"WITH {SUPPORT} SELECT config, w, support FROM support")
def config_parity_support(spark, sf):
    return _supports(spark, sf)


@query(f"WITH {X.MECH}, m AS (SELECT mech, CAST(greatest(round_even(p / (SELECT min(p) FROM mech), 0), 1) AS BIGINT) AS m FROM mech) SELECT mech, m, CAST(sum(m) OVER (ORDER BY mech) - m AS BIGINT) AS first_column FROM m")
def expanded_multiplicity(spark, sf):
    m = dem.multiplicities(X.mechanisms(spark, sf)).withColumn("block", F.expr("mech div 1024"))
    # a prefix sum by blocks: the window without a partition runs over one row for each block
    blocks = m.groupBy("block").agg(F.sum("m").alias("s"))
    blocks = blocks.select("block", (F.sum("s").over(W.orderBy("block")) - F.col("s")).alias("base"))
    inner = F.sum("m").over(W.partitionBy("block").orderBy("mech")) - F.col("m")
    return m.withColumn("inner", inner).join(blocks, "block").select("mech", "m", (F.col("base") + F.col("inner")).alias("first_column"))


@query(f"""WITH {X.MECH}, seen AS (SELECT det & 15 AS det, obs, p FROM mech WHERE (det & 15) <> 0 OR obs <> 0)
    SELECT det, obs, round((1 - exp(sum(ln(1 - 2 * p)))) / 2, 10) AS p, count(*) AS merged FROM seen GROUP BY det, obs""")
def sector_merge(spark, sf):
    return dem.sector(X.mechanisms(spark, sf), 15).select("det", "obs", F.round("p", 10).alias("p"), "merged")


@query(f"WITH {X.MECH}, seen AS (SELECT det & 15 AS det, obs, p FROM mech) SELECT det, obs, round(sum(p), 9) AS p FROM seen GROUP BY det, obs")
def additive_merge(spark, sf):
    seen = X.mechanisms(spark, sf).select(F.col("det").bitwiseAND(F.lit(15)).alias("det"), "obs", "p")
    return seen.groupBy("det", "obs").agg(F.round(F.sum("p"), 9).alias("p"))


@query(f"WITH {X.MECH} SELECT det, count(DISTINCT obs) AS actions, count(*) AS mechs FROM mech GROUP BY det HAVING count(DISTINCT obs) > 1")
def degeneracy_scan(spark, sf):
    return dem.degenerate(X.mechanisms(spark, sf))


@query(f"WITH {X.MECH} SELECT p_brand AS model, count(*) AS mechs, round(sum(p), 9) AS rate FROM mech GROUP BY p_brand")
def mechanisms_by_model(spark, sf):
    return X.mechanisms(spark, sf).groupBy(F.col("p_brand").alias("model")).agg(F.count(F.lit(1)).alias("mechs"), F.round(F.sum("p"), 9).alias("rate"))


COLUMNS = "cols AS (SELECT s_suppkey AS mech, (s_suppkey * 2654435761) % 16384 AS det, (s_suppkey * 40503) % 7 AS obs FROM supplier)"


@query(f"""WITH {COLUMNS}, pairs AS (SELECT a.mech AS i, b.mech AS j, xor(a.det, b.det) AS s, xor(a.obs, b.obs) AS act FROM cols a JOIN cols b ON a.mech < b.mech)
    SELECT DISTINCT array_to_string(list_sort([x.i, x.j, y.i, y.j]), ',') AS members FROM pairs x JOIN pairs y USING (s) WHERE x.act <> y.act AND x.i < y.i AND x.j <> y.i AND x.j <> y.j AND x.i <> y.j""")
def half_mitm_pairs(spark, sf):
    s = X.read(spark, sf, "supplier")
    columns = s.select(F.col("s_suppkey").alias("mech"), F.pmod(F.col("s_suppkey") * 2654435761, F.lit(16384)).alias("det"), F.pmod(F.col("s_suppkey") * 40503, F.lit(7)).alias("obs"))
    return dem.half_pairs(columns).select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


OF_WEIGHT = "members{k} AS (SELECT config, mech FROM odd WHERE config IN (SELECT config FROM odd GROUP BY config HAVING count(*) = {k}))"
PAIRS = "pairs{k} AS (SELECT DISTINCT a.mech AS c1, b.mech AS c2 FROM members{k} a JOIN members{k} b ON a.config = b.config AND a.mech < b.mech)"


def _of_weight(spark, sf, k):
    odd = dem.parity_members(parts.dealt(X.configurations(spark, sf), parts.count(X.configurations(spark, sf)), "config"))
    return odd.join(odd.groupBy("config").count().filter(F.col("count") == k).select("config"), "config", "left_semi")


@query(f"WITH {ODD}, {OF_WEIGHT.format(k=4)}, {PAIRS.format(k=4)} SELECT c1, c2 FROM pairs4")
def restriction_distinct(spark, sf):
    return dem.subsets(_of_weight(spark, sf, 4), 2)


@query(f"WITH {ODD}, {OF_WEIGHT.format(k=3)}, {OF_WEIGHT.format(k=4)}, {PAIRS.format(k=3)}, {PAIRS.format(k=4)} SELECT c1, c2 FROM pairs4 EXCEPT SELECT c1, c2 FROM pairs3")
def odd_onset_antijoin(spark, sf):
    return dem.subsets(_of_weight(spark, sf, 4), 2).join(dem.subsets(_of_weight(spark, sf, 3), 2), ["c1", "c2"], "left_anti")


@query(f"WITH {SYND}, classes AS (SELECT syndrome, truth, count(*) AS rho FROM synd GROUP BY ALL) SELECT CAST(sum(fails) AS BIGINT) AS fails, count(*) AS syndromes FROM (SELECT syndrome, sum(rho) - max(rho) AS fails FROM classes GROUP BY syndrome)")
def max_class_vote(spark, sf):
    votes = dem.class_votes(_synd(spark, sf).withColumn("rho", F.lit(1).cast("long")))
    return votes.agg(F.sum("fails").alias("fails"), F.count(F.lit(1)).alias("syndromes"))


@query(f"""WITH {X.MECH}, {ODD}, cust AS (SELECT o_orderkey AS config, o_custkey AS chain FROM orders), links AS (SELECT config, lag(config) OVER (PARTITION BY chain ORDER BY config) AS other FROM cust),
    members AS (SELECT l.config, o.mech FROM links l JOIN odd o ON o.config = l.config WHERE l.other IS NOT NULL UNION ALL SELECT l.config, o.mech FROM links l JOIN odd o ON o.config = l.other),
    kept AS (SELECT config, mech FROM members GROUP BY config, mech HAVING count(*) = 1)
    SELECT config, count(*) AS w, bit_xor(det) AS syndrome, bit_xor(obs) AS truth FROM kept JOIN mech USING (mech) GROUP BY config""")
def logical_symmetric_difference(spark, sf):
    """Each chain's configuration against the one before it: what stands in one of the two only."""
    n = parts.count(X.configurations(spark, sf))
    odd = dem.parity_members(parts.dealt(X.configurations(spark, sf), n, "config"))
    orders = parts.dealt(X.read(spark, sf, "orders").select(F.col("o_orderkey").alias("config"), F.col("o_custkey").alias("chain")), n, "chain")
    links = orders.select("config", F.lag("config").over(W.partitionBy("chain").orderBy("config")).alias("other")).filter("other IS NOT NULL")
    own = parts.dealt(links.select("config"), n, "config").join(odd, "config")
    others = parts.dealt(links, n, "other").join(odd.withColumnRenamed("config", "other"), "other").select("config", "mech")
    kept = parts.dealt(own.unionByName(others), n, "config", "mech").groupBy("config", "mech").count().filter(F.col("count") == 1)
    joined = parts.dealt(kept, n, "mech").join(X.mechanisms(spark, sf).select("mech", "det", "obs"), "mech")
    return parts.dealt(joined, n, "config").groupBy("config").agg(F.count(F.lit(1)).alias("w"), F.bit_xor("det").alias("syndrome"), F.bit_xor("obs").alias("truth"))


@query(f"WITH {SYND}, n AS (SELECT syndrome, truth, count(*) AS n FROM synd GROUP BY ALL), best AS (SELECT syndrome, truth AS guess FROM n QUALIFY row_number() OVER (PARTITION BY syndrome ORDER BY n DESC, truth) = 1) SELECT config, syndrome, truth, guess, truth <> guess AS failed FROM synd JOIN best USING (syndrome)")
def distinct_syndrome_lookup(spark, sf):
    synd = _synd(spark, sf)
    return synd.join(dem.lookup(synd), "syndrome").select("config", "syndrome", "truth", "guess", (F.col("truth") != F.col("guess")).alias("failed"))


def _stream(spark, sf):
    return X.read(spark, sf, "events").select(F.col("user_id").alias("circuit"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"))


NAMES = {"noise": "error", "gate": "click", "measure": "purchase", "reset": "signup"}
CHANNEL = """stream AS (SELECT user_id AS circuit, event_id AS seq, event_type AS name, lag(event_type) OVER o AS b, lead(event_type) OVER o AS a FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
    classified AS (SELECT circuit, seq, name, CASE WHEN name <> 'error' THEN NULL WHEN b = 'click' THEN 'cz' WHEN a = 'purchase' THEN 'meas' WHEN b = 'signup' THEN 'prep' WHEN a = 'click' THEN 'gate_idle' WHEN b = 'purchase' THEN 'meas_idle' ELSE 'idle' END AS channel FROM stream)"""


@query(f"WITH {CHANNEL} SELECT circuit, seq, name, channel FROM classified")
def channel_classification(spark, sf):
    return C.classified(_stream(spark, sf), **NAMES).select("circuit", "seq", "name", "channel")


@query(f"WITH {CHANNEL} SELECT circuit, seq, name FROM classified WHERE channel IS NULL OR channel = 'cz'")
def channel_filter(spark, sf):
    return C.only_channel(_stream(spark, sf), "cz", **NAMES).select("circuit", "seq", "name")


@query("""WITH stream AS (SELECT user_id AS circuit, event_type AS name, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS layer FROM events)
    SELECT circuit, layer, count(*) FILTER (name = 'click') AS click, count(*) FILTER (name = 'error') AS error, count(*) FILTER (name = 'purchase') AS purchase, count(*) FILTER (name = 'signup') AS signup FROM stream GROUP BY circuit, layer""")
def schedule_pivot(spark, sf):
    pivoted = C.layers(_stream(spark, sf), "view").groupBy("circuit", "layer").pivot("name", ["click", "error", "purchase", "signup"]).agg(F.count(F.lit(1)))
    return pivoted.select("circuit", F.col("layer").cast("long").alias("layer"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("click", "error", "purchase", "signup")))


#: The [[72, 12, 6]] code's polynomials (fixed values): x^3 + y + y^2 and y^3 + x + x^2 over Z_6 x Z_6.
BB6 = (6, 6, [(3, 0), (0, 1), (0, 2)], [(0, 3), (1, 0), (2, 0)])
BB6_SQL = """cells AS (SELECT r AS row, mono.part AS part, ((r // 6 + mono.i) % 6) * 6 + (r % 6 + mono.j) % 6 AS col
        FROM range(0, 36) rows(r), (VALUES ('A', 3, 0), ('A', 0, 1), ('A', 0, 2), ('B', 0, 3), ('B', 1, 0), ('B', 2, 0)) mono(part, i, j)),
    checks AS (SELECT 'X' AS kind, row, CASE WHEN part = 'A' THEN col ELSE col + 36 END AS col FROM cells
               UNION ALL SELECT 'Z', col, CASE WHEN part = 'B' THEN row ELSE row + 36 END FROM cells)"""


@query(f"WITH {BB6_SQL} SELECT kind, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col FROM checks")
def bb_parity_checks(spark, sf):
    return codes.parity_checks(spark, *BB6)


@query(f"WITH {BB6_SQL} SELECT count(*) AS odd_pairs FROM (SELECT x.row, z.row FROM checks x JOIN checks z USING (col) WHERE x.kind = 'X' AND z.kind = 'Z' GROUP BY x.row, z.row HAVING count(*) % 2 = 1)")
def css_commutation(spark, sf):
    return codes.odd_overlaps(codes.parity_checks(spark, *BB6)).agg(F.count(F.lit(1)).alias("odd_pairs"))


EDGES = "inc AS (SELECT DISTINCT l_partkey AS v, l_orderkey AS c FROM lineitem), edges AS (SELECT x.v AS a, y.v AS b, count(*) AS shared FROM inc x JOIN inc y ON x.c = y.c AND x.v < y.v GROUP BY ALL)"


def _edges(spark, sf):
    line = X.read(spark, sf, "lineitem")
    return dem.shared_checks(line.select(F.col("l_partkey").alias("vertex"), F.col("l_orderkey").alias("check")), parts.count(line))


@query(f"WITH {EDGES} SELECT a, b, shared FROM edges")
def shared_check_edges(spark, sf):
    return _edges(spark, sf)


@query(f"WITH {EDGES}, ends AS (SELECT a AS v, b AS n FROM edges UNION ALL SELECT b, a FROM edges) SELECT v AS vertex, count(*) AS degree, string_agg(n, ',' ORDER BY n) AS neighbours FROM ends GROUP BY v")
def adjacency(spark, sf):
    return dem.adjacency(_edges(spark, sf), 4 * parts.count(X.read(spark, sf, "lineitem"))).select("vertex", "degree", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


LADDER = "levels AS (SELECT event_type AS chain, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS level, max(value) AS top FROM events GROUP BY ALL), means AS (SELECT l.chain, l.level, l.top + ln(avg(exp(e.value - l.top))) AS lme, count(*) AS n FROM levels l JOIN events e ON e.event_type = l.chain AND date_diff('day', DATE '1970-01-01', CAST(e.ts AS DATE)) = l.level GROUP BY l.chain, l.level, l.top)"


def _ladder(spark, sf):
    """chain, level, lme: ln of the mean of exp(value), with the largest value taken out first."""
    e = X.read(spark, sf, "events").select(F.col("event_type").alias("chain"), F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("level"), "value")
    top = e.groupBy("chain", "level").agg(F.max("value").alias("top"))
    means = e.join(top, ["chain", "level"]).groupBy("chain", "level", "top").agg(F.avg(F.exp(F.col("value") - F.col("top"))).alias("m"), F.count(F.lit(1)).alias("n"))
    return means.select("chain", F.col("level").cast("long").alias("level"), (F.col("top") + F.log("m")).alias("lme"), "n")


@query(f"WITH {LADDER} SELECT chain, level, round(lme, 8) AS lme, n FROM means")
def ladder_log_mean_exp(spark, sf):
    return _ladder(spark, sf).select("chain", "level", F.round("lme", 8).alias("lme"), "n")


@query(f"WITH {LADDER} SELECT chain, level, round(sum(lme) OVER (PARTITION BY chain ORDER BY level), 6) AS log_ratio FROM means")
def ladder_cumulative(spark, sf):
    return _ladder(spark, sf).select("chain", "level", F.round(F.sum("lme").over(W.partitionBy("chain").orderBy("level")), 6).alias("log_ratio"))


RUNGS = "rungs AS (SELECT event_type AS chain, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS level, avg(CASE WHEN CAST(floor(value) AS BIGINT) % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS accept, avg(value) AS weight FROM events GROUP BY ALL), numbered AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY level) - 1 AS i, lag(weight) OVER (PARTITION BY chain ORDER BY level) AS w0 FROM rungs)"


def _rungs(spark, sf):
    e = X.read(spark, sf, "events").select(F.col("event_type").alias("chain"), F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias("level"), "value")
    rungs = e.groupBy("chain", "level").agg(F.avg(F.when(F.floor("value") % 2 == 0, 1.0).otherwise(0.0)).alias("accept"), F.avg("value").alias("weight"))
    over = W.partitionBy("chain").orderBy("level")
    return rungs.select("*", (F.row_number().over(over) - 1).alias("i"), F.lag("weight").over(over).alias("w0"))


@query(f"WITH {RUNGS} SELECT chain, coalesce(min(i) FILTER (accept <= 0.5 OR weight > 1.02 * w0), max(i) + 1) AS depth FROM numbered GROUP BY chain")
def swap_gate(spark, sf):
    stop = F.min(F.when((F.col("accept") <= 0.5) | (F.col("weight") > 1.02 * F.col("w0")), F.col("i")))
    return _rungs(spark, sf).groupBy("chain").agg(F.coalesce(stop, F.max("i") + 1).cast("long").alias("depth"))


@query(f"WITH {RUNGS} SELECT chain, i, level, round(accept, 9) AS accept FROM numbered QUALIFY i % 4 = 0 OR i = max(i) OVER (PARTITION BY chain)")
def controller_every_4th(spark, sf):
    rows = _rungs(spark, sf).withColumn("last", F.max("i").over(W.partitionBy("chain")))
    return rows.filter("i % 4 = 0 OR i = last").select("chain", F.col("i").cast("long").alias("i"), "level", F.round("accept", 9).alias("accept"))


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS b01, count(*) FILTER (quality = 0 AND toxic = 0) AS b10, count(*) AS pairs FROM labels")
def mcnemar_pairs(spark, sf):
    a, b = F.col("quality") == 0, F.col("toxic") == 1
    return X.read(spark, sf, "labels").agg(F.count(F.when(~a & b, 1)).alias("b01"), F.count(F.when(a & ~b, 1)).alias("b10"), F.count(F.lit(1)).alias("pairs"))


@query("""WITH b AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS b01, count(*) FILTER (quality = 0 AND toxic = 0) AS b10 FROM labels)
    SELECT round(sum(exp(lgamma(b01 + b10 + 1) - lgamma(k + 1) - lgamma(b01 + b10 - k + 1) - (b01 + b10) * ln(2))), 9) AS p FROM b, LATERAL (SELECT unnest(range(b10, b01 + b10 + 1)) AS k)""")
def exact_binomial_tail(spark, sf):
    """P(at least b10 of b01 + b10 fall on one side), each with probability a half; terms by running products."""
    b = mcnemar_pairs(spark, sf).select(F.col("b10"), (F.col("b01") + F.col("b10")).alias("n"))
    terms = b.select("b10", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("k"))
    log = F.sum(F.when(F.col("k") > 0, F.log((F.col("n") - F.col("k") + 1) / F.col("k"))).otherwise(0.0)).over(W.orderBy("k"))
    return terms.withColumn("log_c", log).filter("k >= b10").agg(F.round(F.sum(F.exp(F.col("log_c") - F.col("n") * F.log(F.lit(2.0)))), 9).alias("p"))


@query(f"""WITH {X.SHOTS}, spec AS (SELECT channel, w, count(*) AS t, count(*) FILTER (fail) AS f FROM shots GROUP BY channel, w),
    risk AS (SELECT channel, sum(f / t * {X.B}) AS risk, min(w) FILTER (f > 0) AS onset, CAST(sum(f) AS BIGINT) AS fails FROM spec, (SELECT CAST(0.005 AS DOUBLE) AS p) GROUP BY channel)
    SELECT CAST(channel AS BIGINT) AS decoder, round(risk, 9) AS risk, CAST(onset AS BIGINT) AS onset, row_number() OVER (ORDER BY risk, fails, channel) AS place FROM risk""")
def bench_risk_rank(spark, sf):
    from raretide.operators import spectrum as S

    at = S.weights_at(S.failure_spectrum(X.shots(spark, sf), ["channel"]), spark.createDataFrame([(0.005,)], "p double"), X.N)
    risk = at.groupBy("channel").agg(F.sum(F.col("f") / F.col("t") * F.col("b")).alias("risk"), F.min(F.when(F.col("f") > 0, F.col("w"))).alias("onset"), F.sum("f").alias("fails"))
    place = F.row_number().over(W.orderBy("risk", "fails", "channel"))  # one row for each decoder
    return risk.select(F.col("channel").cast("long").alias("decoder"), F.round("risk", 9).alias("risk"), F.col("onset").cast("long").alias("onset"), place.cast("long").alias("place"))


STATUS = "status AS (SELECT o_orderkey AS config, o_orderstatus AS status FROM orders)"


@query(f"WITH {SUPPORT}, {STATUS}, s AS (SELECT * FROM support JOIN status USING (config)) SELECT support, w, min(config) AS first_config FROM s WHERE status <> 'F' AND support NOT IN (SELECT support FROM s WHERE status = 'F') GROUP BY support, w")
def specimen_dedup(spark, sf):
    """Supports not yet in the library (those of finished orders), each once with its first source."""
    s = _supports(spark, sf).join(X.read(spark, sf, "orders").select(F.col("o_orderkey").alias("config"), F.col("o_orderstatus").alias("status")), "config")
    new = s.filter("status <> 'F'").join(s.filter("status = 'F'").select("support").distinct(), "support", "left_anti")
    return new.groupBy("support", "w").agg(F.min("config").alias("first_config"))


@query(f"WITH {SUPPORT} SELECT w, count(*) AS entries, count(DISTINCT support) AS kinds FROM support GROUP BY w")
def weight_histogram(spark, sf):
    return _supports(spark, sf).groupBy("w").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("support").alias("kinds"))


@query(f"WITH {SUPPORT} SELECT min(w) AS w_hat, count(*) FILTER (w <= (SELECT min(w) FROM support) + 1) AS near, count(*) FILTER (w <= (SELECT min(w) FROM support) + 1) >= 10 AS enough FROM support")
def census(spark, sf):
    by_w = _supports(spark, sf).groupBy("w").count()
    low = by_w.agg(F.min("w").alias("w_hat"))
    near = by_w.join(F.broadcast(low), F.lit(True)).agg(F.min("w_hat").alias("w_hat"), F.sum(F.when(F.col("w") <= F.col("w_hat") + 1, F.col("count")).otherwise(0)).alias("near"))
    return near.select("w_hat", "near", (F.col("near") >= 10).alias("enough"))


@query("SELECT CAST(l_quantity AS BIGINT) AS w, l_orderkey AS config, CAST(l_linenumber AS BIGINT) AS line FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_quantity ORDER BY l_orderkey, l_linenumber) <= 200")
def specimen_cap(spark, sf):
    """At most 200 failing specimens of each weight: the cap is the feature."""
    rows = X.read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_quantity").cast("long").alias("w"), F.col("l_orderkey").alias("config"), F.col("l_linenumber").cast("long").alias("line"))
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("w").orderBy("config", "line"))).filter("nth <= 200").drop("nth")


@query("WITH first AS (SELECT user_id, min(CAST(ts AS DATE)) AS day FROM events GROUP BY user_id) SELECT CAST(day AS VARCHAR) AS day, CAST(sum(count(*)) OVER (ORDER BY day) AS BIGINT) AS seen FROM first GROUP BY day")
def saturation_trace(spark, sf):
    """Distinct circuits seen up to each day: by first days, so that only days meet in one window."""
    first = X.read(spark, sf, "events").groupBy("user_id").agg(F.min(F.to_date("ts")).alias("day"))
    return first.groupBy("day").count().select(F.col("day").cast("string").alias("day"), F.sum("count").over(W.orderBy("day")).alias("seen"))


@query("SELECT coalesce(o_orderpriority, 'GRAND TOTAL') AS section, coalesce(o_orderstatus, 'all') AS status, count(*) AS tasks, round(sum(o_totalprice), 2) AS elapsed FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def task_cost_rollup(spark, sf):
    rolled = X.read(spark, sf, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.sum("o_totalprice"), 2).alias("elapsed"))
    return rolled.select(F.coalesce("o_orderpriority", F.lit("GRAND TOTAL")).alias("section"), F.coalesce("o_orderstatus", F.lit("all")).alias("status"), "tasks", "elapsed")


@query(f"WITH {X.SPEC} SELECT w FROM range(1, 61) r(w) WHERE w NOT IN (SELECT w FROM spec WHERE t >= 1000)")
def resume_antijoin(spark, sf):
    from raretide.operators import spectrum as S

    done = S.failure_spectrum(X.shots(spark, sf)).filter("t >= 1000").select(F.col("w").cast("long").alias("w"))
    return spark.range(1, 61).select(F.col("id").alias("w")).join(done, "w", "left_anti")


#: Expanded columns, columns per unit of rate and distance of the 72-qubit memory (fixed values).
LADDER18 = """WITH RECURSIVE ladder(i, p) AS (SELECT 0, CAST(6e-3 AS DOUBLE) UNION ALL
    SELECT i + 1, p * power(2.0, -1.0 / sqrt(greatest(CAST(6 AS DOUBLE) / 2, 46224 * p / 15))) FROM ladder WHERE p > 3e-3 AND i < 200)
    SELECT CAST(i AS BIGINT) AS i, round(p, 12) AS p FROM ladder"""


@query(LADDER18.replace("2.0", "2.0::DOUBLE"))
def eq18_ladder(spark, sf):
    """Rates from 6e-3 down, each by 2 ** (-1 / sqrt(mean weight there)), of a code of distance 6."""
    from raretide.operators.splitting import rungs

    return spark.createDataFrame(list(enumerate(rungs(6e-3, 3e-3, 46224 / 15, 6))), "i long, p double").select("i", F.round("p", 12).alias("p"))


@query("WITH n AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) SELECT coalesce(r_name, 'all') AS family, CAST(sum(n) AS BIGINT) AS codes FROM n JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name)")
def code_registry(spark, sf):
    joined = X.read(spark, sf, "nation").join(F.broadcast(X.read(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name").agg(F.count(F.lit(1)).alias("codes")).select(F.coalesce("r_name", F.lit("all")).alias("family"), "codes")


@query("""WITH bits AS (SELECT vec_id, label, list_reduce(list_transform(embedding[1:32], lambda x, i: CASE WHEN x > 0 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0::BIGINT END), lambda a, b: a | b) AS lo,
        list_reduce(list_transform(embedding[33:64], lambda x, i: CASE WHEN x > 0 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0::BIGINT END), lambda a, b: a | b) AS hi FROM embeddings)
    SELECT CAST(label AS BIGINT) AS label, count(*) AS vectors, bit_xor(lo) AS lo, bit_xor(hi) AS hi, round(avg(bit_count(lo) + bit_count(hi)), 6) AS weight FROM bits GROUP BY label""")
def binary_signatures(spark, sf):
    """Sign bits of vectors as two masks, and their parity by class."""
    half = lambda at: F.aggregate(F.transform(F.slice("embedding", at, 32), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    bits = X.read(spark, sf, "embeddings").select("label", half(1).alias("lo"), half(33).alias("hi"))
    return bits.groupBy(F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("vectors"), F.bit_xor("lo").alias("lo"), F.bit_xor("hi").alias("hi"), F.round(F.avg(F.bit_count("lo") + F.bit_count("hi")), 6).alias("weight"))
