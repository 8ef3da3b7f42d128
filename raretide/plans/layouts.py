"""Queries over layout graphs and study runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from raretide.operators import layout as L
from raretide.operators import runner
from raretide.plans import base as X
from raretide.plans.catalogue import query

#: One graph a market segment, over the 25 nations: a customer links its nation with the one its number names.
GRAPHS = """pairs AS (SELECT DISTINCT c_mktsegment AS graph, least(c_nationkey, c_custkey * 7 % 25) AS a, greatest(c_nationkey, c_custkey * 7 % 25) AS b FROM customer WHERE c_nationkey <> c_custkey * 7 % 25),
    edges AS (SELECT graph, CAST(row_number() OVER (PARTITION BY graph ORDER BY a, b) - 1 AS BIGINT) AS edge, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM pairs),
    ends AS (SELECT graph, edge, a AS v, b AS n FROM edges UNION ALL SELECT graph, edge, b, a FROM edges)"""
TREES = f"""{GRAPHS}, reach(graph, root, v) AS (SELECT DISTINCT graph, v, v FROM ends UNION SELECT r.graph, r.root, e.n FROM reach r JOIN ends e ON e.graph = r.graph AND e.v = r.v),
    roots AS (SELECT graph, v, min(root) AS root FROM reach GROUP BY graph, v),
    far(graph, v, n) AS (SELECT graph, v, 0 FROM roots WHERE v = root UNION SELECT f.graph, e.n, f.n + 1 FROM far f JOIN ends e ON e.graph = f.graph AND e.v = f.v WHERE f.n < 25),
    level AS (SELECT graph, v, min(n) AS level FROM far GROUP BY graph, v),
    up AS (SELECT l.graph, l.v, min(e.n) AS parent, arg_min(e.edge, e.n) AS edge FROM level l JOIN ends e ON e.graph = l.graph AND e.v = l.v JOIN level k ON k.graph = l.graph AND k.v = e.n AND k.level = l.level - 1 GROUP BY l.graph, l.v)"""


def _edges(spark, sf):
    customers = X.read(spark, sf, "customer")
    return L.numbered(customers.select(F.col("c_mktsegment").alias("graph"), F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") * 7 % 25).alias("b")))


def _text(numbers):
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",")


@query(f"WITH {GRAPHS} SELECT graph, v AS vertex, count(*) AS degree, string_agg(edge, ',' ORDER BY edge) AS edges FROM ends GROUP BY graph, v")
def incident_edges(spark, sf):
    return L.incident(_edges(spark, sf)).select("graph", "vertex", "degree", _text("edges").alias("edges"))


@query(f"WITH RECURSIVE {TREES} SELECT graph, v AS vertex, root, CAST(level AS BIGINT) AS level, coalesce(parent, -1) AS parent, coalesce(edge, -1) AS edge FROM roots JOIN level USING (graph, v) LEFT JOIN up USING (graph, v)")
def spanning_trees(spark, sf):
    trees = L.spanning_trees(_edges(spark, sf))
    return trees.select("graph", "vertex", "root", "level", F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"), F.coalesce("edge", F.lit(-1)).cast("long").alias("edge"))


@query(f"""WITH RECURSIVE {TREES}, path(graph, v, top, edge) AS (SELECT graph, v, parent, edge FROM up UNION ALL SELECT p.graph, p.v, u.parent, u.edge FROM path p JOIN up u ON u.graph = p.graph AND u.v = p.top),
    outside AS (SELECT graph, edge, a, b FROM edges ANTI JOIN up USING (graph, edge)),
    parts AS (SELECT o.graph, o.edge, p.edge AS part FROM outside o JOIN path p ON p.graph = o.graph AND p.v IN (o.a, o.b) GROUP BY ALL HAVING count(*) = 1 UNION ALL SELECT graph, edge, edge FROM outside)
    SELECT graph, edge, string_agg(part, ',' ORDER BY part) AS cycle FROM parts GROUP BY graph, edge""")
def cycle_basis(spark, sf):
    """One cycle for each edge that the spanning trees leave out."""
    edges = _edges(spark, sf)
    return L.cycle_basis(edges, L.spanning_trees(edges)).select("graph", "edge", _text("cycle").alias("cycle"))


@query(f"WITH RECURSIVE {TREES}, e AS (SELECT graph, count(*) AS edges FROM edges GROUP BY graph), r AS (SELECT graph, count(*) AS vertices, count(DISTINCT root) AS components FROM roots GROUP BY graph) SELECT graph, vertices, edges, components, edges - vertices + components AS cycles FROM r JOIN e USING (graph)")
def layout_sizes(spark, sf):
    edges = _edges(spark, sf)
    return L.sizes(edges, L.spanning_trees(edges))


@query(f"""WITH {GRAPHS}, v AS (SELECT DISTINCT graph, v FROM ends), steps AS (SELECT graph, v, coalesce(lead(v) OVER (PARTITION BY graph ORDER BY v), min(v) OVER (PARTITION BY graph)) AS n FROM v)
    SELECT graph, s.v, s.n AS "to", coalesce(edge, -1) AS edge FROM steps s LEFT JOIN ends USING (graph, v, n)""")
def walk_steps(spark, sf):
    """The closed walk through each graph's vertices in their order, step by step; -1 where a step is no edge."""
    edges = _edges(spark, sf)
    tour = L.ends(edges).groupBy("graph").agg(F.array_sort(F.collect_set("vertex")).alias("vs"))
    walks = tour.select("graph", F.lit(0).alias("walk"), F.posexplode(F.array_append("vs", F.get("vs", F.lit(0)))).alias("place", "v"))
    return L.walk_edges(walks, edges).select("graph", "v", "to", F.coalesce("edge", F.lit(-1)).cast("long").alias("edge"))


#: Regions, linked where nations with consecutive numbers lie in them.
REGIONS = """near AS (SELECT DISTINCT x.n_regionkey AS v, y.n_regionkey AS n FROM nation x JOIN nation y ON abs(x.n_nationkey - y.n_nationkey) = 1 AND x.n_regionkey <> y.n_regionkey),
    paths(path) AS (SELECT [n] FROM near WHERE v = 0 UNION ALL SELECT list_append(path, n) FROM paths JOIN near ON v = path[-1] WHERE n <> 0 AND NOT list_contains(path, n)),
    whole AS (SELECT path, row_number() OVER (ORDER BY path) AS nth FROM paths WHERE len(path) = (SELECT count(*) - 1 FROM region))"""


def _covering(spark, sf):
    nations = X.read(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("a"))
    after = nations.select((F.col("k") - 1).alias("k"), F.col("a").alias("b"))
    edges = L.numbered(nations.join(after, "k").select(F.lit(0).alias("graph"), "a", "b"))
    return L.covering_paths(edges, X.read(spark, sf, "region").count(), F.lit(0))


@query(f"WITH RECURSIVE {REGIONS} SELECT array_to_string(path, ',') AS path FROM whole")
def covering_paths(spark, sf):
    """All ways through the regions but one, from a neighbour of that one."""
    return _covering(spark, sf).select(_text("path").alias("path"))


@query(f"""WITH RECURSIVE {REGIONS}, top AS (SELECT path FROM whole WHERE nth = 1), k AS (SELECT path, unnest(range(1, len(path))) AS k FROM top)
    SELECT CAST(k - 1 AS BIGINT) AS cycle, array_to_string([path[k], path[k + 1], path[k + 1] + 100, path[k] + 100, path[k]], ',') AS walk FROM k
    UNION ALL SELECT CAST(len(path) - 1 AS BIGINT), array_to_string([0, path[1], path[1] + 100, 0], ',') FROM top""")
def ladder_cycles(spark, sf):
    """Squares and the closing triangle of a ladder between the first covering path and its copy."""
    top = _covering(spark, sf).agg(F.min("path").alias("top"))
    walks = L.ladder(F.col("top"), F.transform("top", lambda v: v + 100), F.lit(0))
    return top.filter("top IS NOT NULL").select(F.posexplode(walks).alias("cycle", "walk")).select(F.col("cycle").cast("long").alias("cycle"), _text("walk").alias("walk"))


@query("""WITH last AS (SELECT o_custkey, o_orderstatus AS s FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
    SELECT c_mktsegment || '/' || c_custkey AS task, CASE WHEN s IS NULL THEN 'missing' WHEN s = 'P' AND c_nationkey <> 0 THEN 'stale' WHEN c_mktsegment = 'BUILDING' THEN 'forced' ELSE 'cached' END AS status FROM customer LEFT JOIN last ON o_custkey = c_custkey""")
def task_status(spark, sf):
    """Which tasks are kept, run again or new: a task a customer, stored by its last order, whose open ones have another nation."""
    c = X.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.concat_ws("/", "c_mktsegment", "c_custkey").alias("task"), "c_mktsegment", F.col("c_nationkey").cast("string").alias("n"))
    last = X.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("s"))
    wanted = c.select("task", F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("n")).alias("config"))
    had = c.join(last, "k").select("task", F.create_map(F.lit("nation"), F.when(F.col("s") == "P", "0").otherwise(F.col("n")), F.lit("segment"), F.col("c_mktsegment")).alias("config"))
    return runner.status(wanted, had, "BUILDING/")


@query("""WITH channels AS (SELECT DISTINCT l_linenumber AS c FROM lineitem), kinds(kind, k) AS (VALUES ('iso', 'noise_channel'), ('abl', 'ablate_channel')),
    made AS (SELECT n_name || '__' || kind || '_' || c AS name, k, c, n_regionkey AS r FROM nation, channels, kinds)
    SELECT name, 'label' AS key, name AS value FROM made UNION ALL SELECT name, 'rounds', CAST(r AS VARCHAR) FROM made UNION ALL SELECT name, 'adaptive', 'true' FROM made UNION ALL SELECT name, k, CAST(c AS VARCHAR) FROM made""")
def config_clones(spark, sf):
    """Every nation's configuration, once with each channel alone and once without it; plans of weights are not inherited."""
    text = lambda name: F.col(name).cast("string")
    parents = X.read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.create_map(F.lit("label"), F.col("n_name"), F.lit("rounds"), text("n_regionkey"), F.lit("weights"), F.lit("1-9"), F.lit("adaptive"), F.lit("false")).alias("config"))
    channels = X.read(spark, sf, "lineitem").select("l_linenumber").distinct()  # seven values
    kinds = spark.createDataFrame([("iso", "noise_channel"), ("abl", "ablate_channel")], "kind string, k string")
    variants = channels.join(F.broadcast(kinds), F.lit(True)).select(F.concat_ws("_", "kind", "l_linenumber").alias("variant"), F.create_map(F.lit("adaptive"), F.lit("true"), F.col("k"), text("l_linenumber")).alias("changes"))
    return runner.clones(parents, variants, ["weights", "outdir"]).select("name", F.explode("config").alias("key", "value"))
