"""Queries that certify layouts, hold portfolios of decoders against a library, and fit spectra with standard errors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raretide.functions import parts
from raretide.operators import certify, fit
from raretide.operators import library as L
from raretide.operators import spectrum as S
from raretide.plans import base as X
from raretide.plans import studies
from raretide.plans.catalogue import query

#: An order is a layout: suppliers are checks, parts vertices, its lines in their order the edges, the bridge (those with tax)
#: and, by status, the cycles, closed in orders of even number; the first line names the hub.
LAYOUTS = """line AS (SELECT l_orderkey AS graph, l_partkey % 8 AS v, l_suppkey % 3 AS "check", l_tax > 0.01 AS taxed, l_linestatus AS cycle, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 8) - 1 AS place FROM lineitem),
    inc AS (SELECT DISTINCT graph, "check", v FROM line), vertices AS (SELECT DISTINCT graph, v FROM line), hubs AS (SELECT graph, v AS hub FROM line WHERE place = 0),
    follow AS (SELECT graph, v, lead(v) OVER (PARTITION BY graph ORDER BY place) AS n FROM line),
    edges AS (SELECT DISTINCT graph, least(v, n) AS a, greatest(v, n) AS b FROM follow WHERE v <> n),
    near AS (SELECT graph, a, b FROM edges UNION ALL SELECT graph, b, a FROM edges),
    rungs AS (SELECT graph, v, row_number() OVER (PARTITION BY graph ORDER BY place) - 1 AS place FROM line WHERE taxed),
    on_bridge AS (SELECT graph, v, count(*) AS n FROM rungs GROUP BY graph, v),
    inner_v AS (SELECT graph, v FROM vertices ANTI JOIN (SELECT graph, hub AS v FROM hubs) h USING (graph, v)),
    covered AS (SELECT e.graph, e.a, e.b, x."check" FROM edges e JOIN inc x ON x.graph = e.graph AND x.v = e.a JOIN inc y ON y.graph = e.graph AND y.v = e.b AND y."check" = x."check"),
    walks AS (SELECT graph, cycle, v, place FROM line UNION ALL SELECT graph, cycle, arg_min(v, place), 1000 FROM line WHERE graph % 2 = 0 GROUP BY graph, cycle),
    stepped AS (SELECT graph, cycle, v AS a, lead(v) OVER (PARTITION BY graph, cycle ORDER BY place) AS b FROM walks),
    broken AS (SELECT graph, 'edge_without_check' AS rule, a, b FROM edges ANTI JOIN covered USING (graph, a, b)
        UNION ALL SELECT graph, 'check_not_linked', "check", d * (d - 1) // 2 - coalesce(n, 0) FROM (SELECT graph, "check", count(*) AS d FROM inc GROUP BY ALL) LEFT JOIN (SELECT graph, "check", count(*) AS n FROM covered GROUP BY ALL) USING (graph, "check") WHERE d * (d - 1) // 2 > coalesce(n, 0)
        UNION ALL SELECT graph, 'off_bridge', v, -1 FROM inner_v ANTI JOIN on_bridge USING (graph, v)
        UNION ALL SELECT graph, 'not_for_bridge', v, -1 FROM on_bridge ANTI JOIN inner_v USING (graph, v)
        UNION ALL SELECT graph, 'twice_on_bridge', v, n FROM on_bridge WHERE n > 1
        UNION ALL SELECT graph, 'bridge_gap', a, b FROM (SELECT graph, v AS a, lead(v) OVER (PARTITION BY graph ORDER BY place) AS b FROM rungs) ANTI JOIN near USING (graph, a, b) WHERE b IS NOT NULL
        UNION ALL SELECT graph, 'open_triangle', a, b FROM (SELECT graph, hub AS a, v AS b FROM hubs JOIN rungs USING (graph) WHERE place = 0) ANTI JOIN near USING (graph, a, b)
        UNION ALL SELECT graph, 'open_cycle', a, b FROM (SELECT graph, arg_min(v, place) AS a, arg_max(v, place) AS b FROM walks GROUP BY graph, cycle) WHERE a <> b
        UNION ALL SELECT graph, 'step_without_edge', a, b FROM (SELECT DISTINCT graph, cycle, a, b FROM stepped WHERE a <> b) ANTI JOIN near USING (graph, a, b))"""


def _layouts(spark, sf):
    """Lines by order, rows of all kinds made of them, and the number of their partitions."""
    table, c = X.read(spark, sf, "lineitem"), F.col
    n = parts.count(table, 1 << 16)  # a line gives some ten entries
    line = table.select(c("l_orderkey").alias("graph"), (c("l_partkey") % 8).alias("v"), (c("l_suppkey") % 3).alias("check"), (c("l_tax") > 0.01).alias("taxed"), c("l_linestatus").alias("cycle"), "l_linenumber")
    line = parts.dealt(line, n, "graph")
    order = W.partitionBy("graph").orderBy("l_linenumber", "v")
    rung = F.sum(F.coalesce(c("taxed"), F.lit(False)).cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1
    placed = line.select("*", (F.row_number().over(order) - 1).alias("place"), F.lead("v").over(order).alias("to"), rung.alias("rung"))
    walk, even = W.partitionBy("graph", "cycle"), c("graph") % 2 == 0
    placed = placed.select("*", (F.row_number().over(walk.orderBy("place")) - 1).alias("step"), F.count_if(c("place") < 1000).over(walk).alias("close"))
    rows = F.array(
        certify.row("incidence", check=c("check"), v=c("v")), certify.row("edge", v=c("v"), to=c("to")), F.when(c("place") == 0, certify.row("hub", v=c("v"))), F.when(c("taxed"), certify.row("rung", place=c("rung"), v=c("v"))),
        certify.row("cycle", cycle=c("cycle"), place=c("step") + F.when(even & (c("place") >= 1000), 1).otherwise(0), v=c("v")), F.when(even & (c("step") == 0), certify.row("cycle", cycle=c("cycle"), place=c("close"), v=c("v"))),
    )
    return line, placed.select("graph", F.inline(rows)), n


@query(f"WITH {LAYOUTS} SELECT graph, rule, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM broken")
def layout_violations(spark, sf):
    """What breaks which rule in which layout."""
    _, rows, n = _layouts(spark, sf)
    return certify.judged(rows, n)


@query(f"WITH {LAYOUTS}, of AS (SELECT graph, string_agg(DISTINCT rule, ',' ORDER BY rule) AS reasons FROM broken GROUP BY graph) SELECT coalesce(reasons, '') AS reasons, count(*) AS layouts FROM (SELECT DISTINCT graph FROM line) LEFT JOIN of USING (graph) GROUP BY 1")
def layout_census(spark, sf):
    """How many layouts fail for the same reasons; sound ones have none."""
    line, rows, n = _layouts(spark, sf)
    return certify.census(certify.judged(rows, n), line)


#: Members alone, then the portfolios made of them.
COMBINATIONS = (("1", 1), ("2", 2), ("3", 3), ("4", 4), ("1+2", 1), ("1+2", 2), ("3+4", 3), ("3+4", 4), ("2+3+4", 2), ("2+3+4", 3), ("2+3+4", 4))
COMBINATIONS_SQL = "combos(portfolio, member) AS (VALUES " + ", ".join(f"('{c}', {m})" for c, m in COMBINATIONS) + ")"


@query(f"""WITH {studies.MEMBERS}, {COMBINATIONS_SQL}, entry AS (SELECT m.*, o_orderstatus AS truth, min(w) OVER (PARTITION BY shot) AS weight FROM members m JOIN orders ON o_orderkey = shot),
    each AS (SELECT portfolio, truth, weight, answer, bool_or(answer = truth) OVER (PARTITION BY portfolio, shot) AS can FROM entry JOIN combos USING (member)
        QUALIFY row_number() OVER (PARTITION BY portfolio, shot ORDER BY valid DESC, CASE WHEN valid THEN score END DESC NULLS LAST, member, score DESC, answer DESC) = 1)
    SELECT portfolio, count(*) AS entries, count(*) FILTER (answer = truth) AS fixes, min(weight) FILTER (answer <> truth) AS lightest_failure, count(*) FILTER (can) AS ceiling FROM each GROUP BY portfolio""")
def portfolio_on_library(spark, sf):
    """What each portfolio of decoders mends of a library, its lightest failure, and what its best member would mend."""
    truth = X.read(spark, sf, "orders").select(F.col("o_orderkey").alias("shot"), F.col("o_orderstatus").alias("truth"))
    n = parts.count(X.read(spark, sf, "lineitem"))
    # all that follows goes by shot: lines and orders are shuffled once
    members = parts.dealt(studies._members(spark, sf), n, "shot").withColumn("weight", F.min("w").over(W.partitionBy("shot")))
    answers = members.drop("w").join(parts.dealt(truth, n, "shot"), "shot")
    return L.portfolios(answers, spark.createDataFrame(COMBINATIONS, "portfolio string, member int"))


@query()
def fits_with_errors(spark, sf):
    """Each channel's spectrum fitted freely and, for the tail from two above the onset on, with the onset's fraction pinned."""
    spec = S.failure_spectrum(X.shots(spark, sf), ["channel"])
    onset = spec.filter("f > 0").groupBy("channel").agg(F.min("w").alias("w0"), F.min_by(F.col("f") / F.col("t"), "w").alias("at"))
    both = spec.join(onset, "channel", "left").select("channel", F.explode(F.array(F.lit(False), F.lit(True))).alias("pinned"), "w", "t", "f", "w0", "at")
    both = both.filter("NOT pinned OR w = w0 OR w >= w0 + 2").withColumn("f0", F.when(F.col("pinned"), F.col("at"))).drop("at")
    return fit.fit_with_errors(both, ["channel", "pinned"])
