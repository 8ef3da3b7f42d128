"""Graphs of check layouts: edges are rows graph, edge, a, b with a < b; many graphs are handled side by side."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(pairs: DataFrame) -> DataFrame:
    """graph, a, b -> graph, edge, a, b: each unordered pair of unequal vertices once, numbered within its graph."""
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    once = pairs.filter("a <> b").select("graph", low, high).distinct()
    return once.select("graph", (F.row_number().over(W.partitionBy("graph").orderBy("a", "b")) - 1).cast("long").alias("edge"), "a", "b")


def ends(edges: DataFrame) -> DataFrame:
    """graph, edge, vertex, to: each edge from both of its ends."""
    pair = F.inline(F.array(F.struct(F.col("a").alias("vertex"), F.col("b").alias("to")), F.struct(F.col("b").alias("vertex"), F.col("a").alias("to"))))
    return edges.select("graph", "edge", pair)


def incident(edges: DataFrame) -> DataFrame:
    """graph, vertex, degree, edges (ascending)."""
    return ends(edges).groupBy("graph", "vertex").agg(F.count(F.lit(1)).alias("degree"), F.array_sort(F.collect_list("edge")).alias("edges"))


def walk_edges(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, walk, place, v -> graph, walk, place, v, to, edge: the edge of every step, null where there is none."""
    step = walks.withColumn("to", F.lead("v").over(W.partitionBy("graph", "walk").orderBy("place"))).filter("to IS NOT NULL")
    return step.join(ends(edges).withColumnRenamed("vertex", "v"), ["graph", "v", "to"], "left").select("graph", "walk", "place", "v", "to", "edge")


def spanning_trees(edges: DataFrame) -> DataFrame:
    """graph, vertex, root, level, parent, edge, path (edges down from the root), breadth first.

    Every component has a tree, rooted in its smallest vertex; a vertex hangs on the smallest neighbour one level up. A
    search is sequential by nature, so each graph is one group of an Arrow function: graphs run side by side, and one graph
    must fit in a task.
    """
    kinds = dict(edges.dtypes)

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for edge, a, b in zip(rows["edge"], rows["a"], rows["b"]):
            near.setdefault(a, []).append((b, edge))
            near.setdefault(b, []).append((a, edge))
        found: dict = {}
        for root in sorted(near):
            if root in found:
                continue
            found[root] = (root, 0, None, None, [])
            level = [root]
            while level:
                below = []
                for v in sorted(level):  # ascending, so that the first to reach a vertex is its smallest parent
                    for to, edge in near[v]:
                        if to not in found:
                            found[to] = (root, found[v][1] + 1, v, edge, [*found[v][4], edge])
                            below.append(to)
                level = below
        graph = rows["graph"].iloc[0]
        return pd.DataFrame([(graph, v, *at) for v, at in found.items()], columns=["graph", "vertex", "root", "level", "parent", "edge", "path"])

    schema = f"graph {kinds['graph']}, vertex {kinds['a']}, root {kinds['a']}, level long, parent {kinds['a']}, edge long, path array<long>"
    return edges.groupBy("graph").applyInPandas(search, schema)


def cycle_basis(edges: DataFrame, trees: DataFrame) -> DataFrame:
    """graph, edge, cycle: for every edge outside the trees, itself and what the paths to its two ends do not share."""
    paths = trees.select("graph", "vertex", "path")
    outside = edges.join(trees.filter("edge IS NOT NULL").select("graph", "edge"), ["graph", "edge"], "left_anti")
    both = outside.join(paths.select("graph", F.col("vertex").alias("a"), F.col("path").alias("pa")), ["graph", "a"])
    both = both.join(paths.select("graph", F.col("vertex").alias("b"), F.col("path").alias("pb")), ["graph", "b"])
    return both.select("graph", "edge", F.array_sort(F.array_append(F.concat(F.array_except("pa", "pb"), F.array_except("pb", "pa")), F.col("edge"))).alias("cycle"))


def sizes(edges: DataFrame, trees: DataFrame) -> DataFrame:
    """graph, vertices, edges, components, cycles (edges - vertices + components)."""
    parts = trees.groupBy("graph").agg(F.count(F.lit(1)).alias("vertices"), F.sum((F.col("level") == 0).cast("long")).alias("components"))
    both = parts.join(edges.groupBy("graph").agg(F.count(F.lit(1)).alias("edges")), "graph")
    return both.select("graph", "vertices", "edges", "components", (F.col("edges") - F.col("vertices") + F.col("components")).alias("cycles"))


def covering_paths(edges: DataFrame, vertices: int, hub: Column, beside: bool = True) -> DataFrame:
    """graph, path: all paths that visit each of ``vertices`` vertices but ``hub`` once; by default from a neighbour of it.

    One join a vertex; a graph has as many rows as it has such beginnings, so this is for graphs of some ten vertices.
    """
    steps = ends(edges).select("graph", "vertex", "to")
    inner = steps.filter((F.col("vertex") != hub) & (F.col("to") != hub))
    starts = steps.filter(F.col("vertex") == hub).select("graph", F.col("to").alias("v")) if beside else inner.select("graph", F.col("vertex").alias("v"))
    paths = starts.distinct().select("graph", F.array("v").alias("path"))
    for _ in range(vertices - 2):
        paths = paths.withColumn("vertex", F.element_at("path", -1)).join(inner, ["graph", "vertex"])
        paths = paths.filter(~F.array_contains("path", F.col("to"))).select("graph", F.array_append("path", F.col("to")).alias("path"))
    return paths


def ladder(top: Column, bottom: Column, hub: Column) -> Column:
    """Closed walks of a ladder with rungs top[k] - bottom[k]: a square between neighbouring rungs, then the hub's triangle."""
    at = lambda side, k: F.get(side, k)
    rungs = F.sequence(F.lit(0), F.size(top) - 1)
    squares = F.transform(F.filter(rungs, lambda k: k + 1 < F.size(top)), lambda k: F.array(at(top, k), at(top, k + 1), at(bottom, k + 1), at(bottom, k), at(top, k)))
    return F.concat(squares, F.array(F.array(hub, at(top, F.lit(0)), at(bottom, F.lit(0)), hub)))
