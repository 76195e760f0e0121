"""Graphs with cycles of any length: strong components, shortest cycles, build order, chains of parents.

Nothing here enumerates paths. Every round is one or two joins of what is still open with the edges on a node, written to the shared
folder so that lineage stays short; only counts come to the driver. Degrees and labels are aggregated before they are shuffled, so a
node with very many edges costs its join alone, which adaptive execution may split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.sources.staging import drop, parted, written

#: Trimming goes on while a round takes away at least one of so many edges; what it leaves is found by colouring all the same.
WORTH = 10
#: Written steps that a plan reads side by side.
FOLD = 8


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges (written) without those at nodes that nothing reaches, or that reach nothing; and their number."""
    left = edges.count()
    while left:
        core = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        core = written(core.select("src", "dst"), "core")
        now = core.count()
        drop(edges)
        edges, gone, left = core, left - now, now
        if gone * WORTH < left or not gone:
            break
    return edges, left


def _coloured(edges: DataFrame) -> DataFrame:
    """The largest node that reaches each node, itself included: node, colour. Only nodes whose colour has changed pass theirs on."""
    colours = written(_nodes(edges).withColumn("colour", F.col("node")).withColumn("new", F.lit(True)), "colours")
    while True:
        sent = colours.filter("new").join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("sent"))
        higher = F.coalesce(F.col("sent") > F.col("colour"), F.lit(False))
        after = written(colours.join(sent, "node", "left").select("node", F.when(higher, F.col("sent")).otherwise(F.col("colour")).alias("colour"), higher.alias("new")), "colours")
        drop(colours)
        colours = after
        if colours.filter("new").isEmpty():
            return colours.drop("new")


def _rooted(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """Nodes that reach the node that gave them their colour, along edges of one colour: node, colour. Those are its component."""
    reached = frontier = written(colours.filter("node = colour"), "reached")
    inside = edges.join(colours.select(F.col("node").alias("src"), "colour"), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst").filter("colour = other").select("src", "dst", "colour")
    inside = written(inside, "inside")
    steps = [reached]
    while not frontier.isEmpty():
        back = inside.join(frontier.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "colour").distinct()
        frontier = written(back.join(_together(steps), "node", "left_anti"), "reached")
        steps = _folded([*steps, frontier])
    drop(inside)
    return _together(steps)


def _together(steps: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, steps)


def _folded(steps: list[DataFrame]) -> list[DataFrame]:
    """Written steps as fewer ones, so that plans don't grow with the rounds. The last one stays as it is."""
    if len(steps) < 2 * FOLD:
        return steps
    one = written(_together(steps[:-1]), "steps")
    drop(*steps[:-1])
    return [one, steps[-1]]


def strong_components(edges: DataFrame) -> DataFrame:
    """Strong components of the graph of `edges` (src, dst): node, component (its least node), size. Every node of an edge is there;
    one that lies on no cycle is a component of its own. Repeated edges and loops don't matter, nulls take no part; no edges, no rows.

    Trim, colour by the largest ancestor, and take each colour's nodes that reach back to it; what is left goes on within its colours.
    """
    edges = written(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")
    whole = _nodes(edges)
    found = None
    rest, left = _trimmed(written(edges.filter("src <> dst"), "edges"))
    while left:
        colours = written(_coloured(rest), "coloured")
        reached = _rooted(rest, colours)
        found = reached if found is None else written(found.unionByName(reached), "components")
        open_ = colours.join(reached.select("node"), "node", "left_anti")
        kept = rest.join(open_.select(F.col("node").alias("src"), "colour"), "src").join(open_.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst").filter("colour = other")
        after = written(kept.select("src", "dst"), "edges")
        drop(rest, colours)
        rest, left = _trimmed(after)
    drop(rest)
    if found is None:
        return whole.select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("size"))
    named = found.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("size"))
    own = found.join(named, "colour").select("node", "component", "size")
    return whole.join(own, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1).cast("long")).alias("size"))


def cyclic_nodes(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Nodes that lie on a cycle of any length, loops included: node, component, size."""
    components = strong_components(edges) if components is None else components
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
    return components.join(loops, "node", "left").filter("size > 1 or loop").select("node", "component", "size")


def shortest_cycles(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """A shortest cycle through the least node of each component with a cycle: component, length, cycle (nodes from the least on; of
    equally short ones the first in order). One row a node is kept at every distance, so components of any size take as many
    rounds as their cycle is long."""
    inner = written(cyclic_nodes(edges, components), "cyclic")
    within = edges.select("src", "dst").distinct().join(inner.select(F.col("node").alias("src"), "component"), "src").join(inner.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst").filter("component = other").select("src", "dst", "component")
    within = written(within, "within")
    frontier = inner.filter("node = component").select("component", "node", F.array("node").alias("path"))
    seen, found = [frontier.select("component", "node")], None
    while not frontier.isEmpty():
        step = frontier.join(within.select(F.col("src").alias("node"), "dst"), "node").groupBy("component", F.col("dst").alias("node")).agg(F.min("path").alias("before"))
        closed, on = parted(step.join(_together(seen).filter("node <> component"), ["component", "node"], "left_anti"), "step", "node = component")
        cycles = closed.select("component", F.size("before").alias("length"), F.col("before").alias("cycle"))
        found = cycles if found is None else found.unionByName(cycles)
        frontier = on.join(closed.select("component"), "component", "left_anti").select("component", "node", F.array_append("before", F.col("node")).alias("path"))
        seen.append(on.select("component", "node"))
        if len(seen) == 2 * FOLD:
            seen, found = [written(_together(seen), "seen")], written(found, "found")
    return found if found is not None else inner.select("component", F.lit(0).alias("length"), F.array("node").alias("cycle")).limit(0)


def ends_of_chains(parents: DataFrame) -> DataFrame:
    """The last ancestor of every node of `parents` (node, parent; one parent each): node, last, distance, by pointer doubling. Nodes on a
    cycle, or on the way to one, have a null `last` and distance. A parent that is null or isn't a node itself ends a chain.

    Depths below a chain's end have no gaps, so a round in which no node arrives shows that all others lead to cycles.
    """
    spark = parents.sparkSession
    ptr = written(parents.select("node", F.col("parent").alias("last"), F.lit(1).cast("long").alias("distance")).filter("last is not null"), "pointers")
    open_ = -1
    while True:
        ahead = ptr.select(F.col("node").alias("last"), F.col("last").alias("next"), F.col("distance").alias("further"))
        after = written(ptr.join(ahead, "last", "left").select("node", F.coalesce("next", "last").alias("last"), (F.col("distance") + F.coalesce("further", F.lit(0).cast("long"))).alias("distance"), F.col("next").isNotNull().alias("open")), "pointers")
        drop(ptr)
        ptr, before = after.drop("open"), open_
        open_ = after.filter("open").count()
        if not open_ or open_ == before:
            break
        ptr.written_at = after.written_at
    done = after.filter("not open") if open_ else after
    roots = parents.filter("parent is null").select("node", F.col("node").alias("last"), F.lit(0).cast("long").alias("distance"))
    ended = done.select("node", "last", "distance").unionByName(roots)
    return parents.select("node").join(ended, "node", "left") if open_ else ended


def build_order(edges: DataFrame) -> DataFrame:
    """Level of each node (src depends on dst): leaves are 0, others one above their highest dependency, at any depth. Nodes on a cycle,
    or that depend on one, have a null level.

    Nodes with one dependency hang below it at a known distance: chains of them are folded by pointer doubling first. The others are
    peeled: each keeps the number of dependencies that are still open; a round places those that have none and takes what they
    settle from the numbers of the nodes above.
    """
    edges = written(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")
    nodes = _nodes(edges)
    needs = edges.groupBy("src").agg(F.count("*").alias("n"), F.first("dst").alias("parent"))
    state = written(nodes.join(needs, nodes.node == needs.src, "left").select("node", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "parent"), "needs")
    # Where chains of single dependencies end: at leaves, at nodes with several, or nowhere.
    single = state.filter("n = 1").select("node", "parent")
    folded = written(ends_of_chains(single), "folded")
    knots = state.filter("n <> 1").select("node", "n")
    # A knot's dependencies, each moved to the knot behind it: above, below, steps between; null where there is none.
    own = edges.join(knots.select(F.col("node").alias("src")), "src", "left_semi")
    far = own.join(folded.select(F.col("node").alias("dst"), "last", "distance", F.lit(True).alias("chained")), "dst", "left")
    links = written(far.select(F.col("src").alias("above"), F.when(F.col("chained"), F.col("last")).otherwise(F.col("dst")).alias("below"), F.when(F.col("chained"), F.col("distance") + 1).otherwise(F.lit(1).cast("long")).alias("steps")), "links")
    frontier, waiting = parted(knots.withColumn("level", F.lit(0).cast("long")), "knots", "n = 0")
    placed = [frontier]
    while not frontier.isEmpty():
        settled = links.join(frontier.select(F.col("node").alias("below"), F.col("level").alias("of")), "below").groupBy(F.col("above").alias("node")).agg(F.count("*").alias("k"), F.max(F.col("of") + F.col("steps")).alias("least"))
        none = F.lit(0).cast("long")
        now = waiting.join(settled, "node", "left").select("node", (F.col("n") - F.coalesce("k", none)).alias("n"), F.greatest("level", F.coalesce("least", none)).alias("level"))
        before, (frontier, waiting) = waiting, parted(now, "knots", "n = 0")
        drop(before)
        placed = _folded([*placed, frontier])
    placed = _together(placed).select("node", "level")
    placed = written(placed, "levels")
    chained = folded.join(placed.select(F.col("node").alias("last"), "level"), "last", "left").select("node", (F.col("level") + F.col("distance")).alias("level"))
    return placed.unionByName(waiting.select("node", F.lit(None).cast("long").alias("level"))).unionByName(chained)


def resolved(parents: DataFrame, defined: DataFrame) -> DataFrame:
    """What each node inherits: for every node of `parents` (node, parent) and every name that it or an ancestor defines (`defined`: node,
    name, value), the value at the nearest of them: node, name, value, origin, distance. Nodes on a cycle, or below one, inherit what
    the chain holds before it comes back to itself: their own definitions come first in any case.

    A node looks 1, 2, 4, ... ancestors ahead: what is known of the node so far ahead is added to what is known of itself, until no
    chain goes on. Names are kept once a node, the nearest; of several values of one name at one node the least.
    """
    keep = lambda rows: rows.groupBy("node", "name").agg(F.min(F.struct("distance", "value", "origin")).alias("d")).select("node", "name", "d.value", "d.origin", "d.distance")
    known = written(keep(defined.select("node", "name", "value", F.col("node").alias("origin"), F.lit(0).cast("long").alias("distance"))), "known")
    ptr = written(parents.filter("parent is not null").select("node", F.col("parent").alias("to"), F.lit(1).cast("long").alias("ahead")), "pointers")
    most = parents.count()
    reach = 1
    while not ptr.isEmpty():
        ahead = ptr.join(known.withColumnRenamed("node", "to"), "to").select("node", "name", "value", "origin", (F.col("distance") + F.col("ahead")).alias("distance"))
        more = written(keep(known.unionByName(ahead)), "known")
        reach *= 2
        # Beyond as many steps as there are nodes, a chain is a cycle.
        doubled = ptr.join(ptr.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("ahead").alias("further")), "to").select("node", F.col("next").alias("to"), (F.col("ahead") + F.col("further")).alias("ahead"))
        further = written(doubled if reach <= most else doubled.limit(0), "pointers")
        drop(known, ptr)
        known, ptr = more, further
    return known
