"""Graphs with cycles over the star schema, and inheritance along conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalens.operators import cyclic as C
from stratalens.plans.graph_queries import TRADE, _trade
from stratalens.registry import query
from stratalens.sources.tables import table

#: Parts that follow one another in an order, where the first is bought in bulk.
BULK = 47
FOLLOWS = f"(SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS dst, l_quantity FROM lineitem) WHERE dst IS NOT NULL AND l_quantity > {BULK})"


def _follows(spark, sf_dir):
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), following.alias("dst"), "l_quantity")
    return line.filter(F.col("dst").isNotNull() & (F.col("l_quantity") > BULK)).select("src", "dst").distinct()


#: Components by the closure: nodes that reach one another.
_CLOSURE = """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {edges}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r AS (SELECT src AS x, dst AS y FROM e UNION SELECT r.x, e.dst FROM r JOIN e ON r.y = e.src),
m AS (SELECT a.x, a.y FROM r a JOIN r b ON a.x = b.y AND a.y = b.x),
c AS (SELECT node, least(node, coalesce(min(y), node)) AS component, greatest(count(y), 1) AS size, count(y) > 0 AS cyclic FROM n LEFT JOIN m ON node = x GROUP BY node)""".format


@query(_CLOSURE(edges=FOLLOWS) + " SELECT node, component, size FROM c")
def q_components(spark, sf_dir):
    return C.strong_components(_follows(spark, sf_dir))


@query(_CLOSURE(edges=TRADE) + " SELECT node, component, size FROM c WHERE cyclic")
def q_trade_cycles(spark, sf_dir):
    """Nations that lie on a cycle of trade, of any length."""
    return C.cyclic_nodes(_trade(spark, sf_dir))


@query(
    _CLOSURE(edges=FOLLOWS)
    + """, i AS (SELECT e.src, e.dst, a.component FROM e JOIN c a ON e.src = a.node AND a.cyclic JOIN c b ON e.dst = b.node AND b.component = a.component),
  t AS (SELECT DISTINCT component, component AS node, 0 AS d FROM i UNION SELECT t.component, i.src, d + 1 FROM t JOIN i ON i.component = t.component AND i.dst = t.node WHERE d < 60 AND NOT (d > 0 AND t.node = t.component)),
  f AS (SELECT component, node, min(d) AS d FROM t WHERE node <> component GROUP BY ALL UNION ALL SELECT component, node, min(d) FROM t WHERE node = component AND d > 0 GROUP BY ALL),
  p AS (SELECT component, [component] AS cycle, d AS rest FROM f WHERE node = component UNION ALL SELECT p.component, list_append(cycle, i.dst), rest - 1 FROM p JOIN i ON i.component = p.component AND i.src = cycle[-1] JOIN f ON f.component = p.component AND f.node = i.dst AND f.d = rest - 1 WHERE rest > 1)
SELECT component, CAST(len(min(cycle)) AS INTEGER) AS length, min(cycle) AS cycle FROM p WHERE rest = 1 GROUP BY component"""
)
def q_shortest_cycles(spark, sf_dir):
    return C.shortest_cycles(_follows(spark, sf_dir))


#: Parts wait for those that follow them and have lower keys; pairs both ways round (a cycle of two) among the rest stay.
WAITS = f"(SELECT src, dst FROM {FOLLOWS} WHERE src > dst OR dst % 10 = 0)"


@query(
    _CLOSURE(edges=WAITS)
    + """, blocked AS (SELECT node FROM c WHERE cyclic UNION SELECT r.x FROM r JOIN c ON r.y = c.node AND c.cyclic),
  w AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT src FROM e) UNION SELECT e.src, w.level + 1 FROM w JOIN e ON w.node = e.dst WHERE e.src NOT IN (SELECT node FROM blocked))
SELECT node, CASE WHEN node NOT IN (SELECT node FROM blocked) THEN CAST(max(level) AS BIGINT) END AS level FROM n LEFT JOIN w USING (node) GROUP BY node"""
)
def q_build_order(spark, sf_dir):
    return C.build_order(_follows(spark, sf_dir).filter("src > dst or dst % 10 = 0"))


_TURNS = "(SELECT conv_id * 1000 + turn AS node, lag(conv_id * 1000 + turn) OVER (ORDER BY conv_id, turn) AS parent, role, lower(left(text, 1)) AS letter, row_number() OVER (ORDER BY conv_id, turn) AS k FROM conversations)"


@query(f"""WITH t AS {_TURNS}, d AS (SELECT node, k, 'role ' || role AS name FROM t UNION ALL SELECT node, k, 'letter ' || letter FROM t WHERE letter IS NOT NULL),
  a AS (SELECT t.node, t.k, d.name, max(d.k) AS place FROM t JOIN d ON d.k <= t.k GROUP BY ALL)
SELECT a.node, name, b.node AS value, b.node AS origin, a.k - place AS distance FROM a JOIN t b ON b.k = place""")
def q_inherited(spark, sf_dir):
    """All turns of all conversations as one chain of templates: what each inherits of the roles and first letters before it."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "role", F.lower(F.left("text", F.lit(1))).alias("letter"), "conv_id", "turn")
    # The turn before, within a conversation or the last of the conversation before: one row a conversation takes part in the second.
    own = turns.withColumn("before", F.lag("node").over(Window.partitionBy("conv_id").orderBy("turn")))
    ends = turns.groupBy("conv_id").agg(F.max("node").alias("end")).withColumn("block", F.expr("conv_id div 1000"))
    last = ends.groupBy("block").agg(F.max("end").alias("end"))
    first = last.join(last.select(F.col("block").alias("b"), F.col("end").alias("e")), F.col("b") < F.col("block"), "left").groupBy("block").agg(F.max("e").alias("carried"))
    linked = ends.withColumn("back", F.lag("end").over(Window.partitionBy("block").orderBy("conv_id"))).join(first, "block").select("conv_id", F.coalesce("back", "carried").alias("back"))
    parents = own.join(linked, "conv_id").select("node", F.coalesce("before", "back").alias("parent"))
    names = F.array(F.concat(F.lit("role "), "role"), F.concat(F.lit("letter "), "letter"))
    defined = turns.select("node", F.explode(names).alias("name"), F.col("node").alias("value")).filter("name is not null")
    return C.resolved(parents, defined)
