"""Graph operators over edge tables (src, dst): bounded walks, simple paths, cycles, levels.

Each step is a join of the frontier with the edges on the node, so a step shuffles the frontier once; steps are bounded by a
depth, and lineage stays as long as the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Nodes within `depth` steps of each seed (node): seed, node, distance. A node reached again is not walked again."""
    edges = edges.select("src", "dst").distinct()
    frontier = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("distance"))
    found = None
    for d in range(1, depth + 1):
        step = frontier.join(edges, frontier.node == edges.src).select("seed", F.col("dst").alias("node")).distinct()
        new = step if found is None else step.join(found.select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = new.withColumn("distance", F.lit(d))
        found = frontier if found is None else found.unionByName(frontier)
    return found


def call_paths(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Simple paths from the starts (node), up to `depth` edges; a node that is already on the path ends it but is still given.

    Columns: path (array), depth, closed (the last node was on the path before).
    """
    edges = edges.select("src", "dst").distinct()
    frontier = start.select(F.array("node").alias("path"), F.col("node").alias("last"))
    out = None
    for d in range(1, depth + 1):
        step = frontier.join(edges, frontier.last == edges.src).select(F.col("path").alias("before"), F.col("dst").alias("last"))
        step = step.select(F.array_append("before", F.col("last")).alias("path"), "last", F.array_contains("before", F.col("last")).alias("closed"))
        rows = step.select("path", F.lit(d).alias("depth"), "closed")
        out = rows if out is None else out.unionByName(rows)
        frontier = step.filter("not closed").select("path", "last")
    return out


def cycles(edges: DataFrame, longest: int = 6) -> DataFrame:
    """Cycles of up to `longest` nodes, each once, from its least node on: cycle (array)."""
    edges = edges.select("src", "dst").distinct()
    frontier = edges.filter("src <= dst").select(F.array("src").alias("path"), F.col("src").alias("first"), F.col("dst").alias("last"))
    out = frontier.filter("first = last").select(F.col("path").alias("cycle"))
    frontier = frontier.filter("first < last").select(F.array_append("path", F.col("last")).alias("path"), "first", "last")
    for _ in range(longest - 1):
        step = frontier.join(edges, frontier.last == edges.src).select("path", "first", F.col("dst").alias("last"))
        out = out.unionByName(step.filter("first = last").select(F.col("path").alias("cycle")))
        step = step.filter((F.col("last") > F.col("first")) & ~F.array_contains("path", F.col("last")))
        frontier = step.select(F.array_append("path", F.col("last")).alias("path"), "first", "last")
    return out


def build_levels(edges: DataFrame, depth: int) -> DataFrame:
    """Level of each node of an acyclic graph (src depends on dst): leaves are 0, others one above their highest dependency.

    Nodes from which a walk of more than `depth` steps starts (on the way to a cycle, or deeper) are left out.
    """
    edges = edges.select("src", "dst").distinct()
    leaves = edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    frontier, reached = nodes, leaves.withColumn("level", F.lit(0))
    for d in range(1, depth + 1):
        # Starts of walks of d steps.
        frontier = edges.join(frontier, edges.dst == frontier.node).select(F.col("src").alias("node")).distinct()
        reached = reached.unionByName(frontier.withColumn("level", F.lit(d)))
    beyond = edges.join(frontier, edges.dst == frontier.node).select(F.col("src").alias("node")).distinct()
    return reached.join(beyond, "node", "left_anti").groupBy("node").agg(F.max("level").alias("level"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree."""
    each = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("dst"), F.lit(0), F.lit(1)))
    return each.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def impact(edges: DataFrame, changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """What changed nodes (node) touch: their direct callers, split by `nodes` (node, is_test)."""
    callers = edges.join(changed.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
    return callers.join(nodes, "node").groupBy("is_test").agg(F.count(F.lit(1)).alias("callers"))
