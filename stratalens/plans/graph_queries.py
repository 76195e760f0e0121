"""Graph queries: a fixture with cycles, and trading edges between nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import graph as G
from stratalens.registry import query, sql_values
from stratalens.sources.tables import table

#: Calls: a chain of three levels, a cycle of three, one of two, a self-call, a diamond.
CALLS = [("main", "load"), ("main", "run"), ("load", "parse"), ("parse", "lex"), ("run", "step"), ("step", "check"), ("check", "run"), ("ping", "pong"), ("pong", "ping"), ("retry", "retry"), ("run", "log"), ("step", "log"), ("log", "format"), ("lex", "format")]
EDGES = sql_values(CALLS, ["src", "dst"])


def _calls(spark):
    return spark.createDataFrame(CALLS, "src string, dst string")


# A nation supplies another: the supplier's nation and the customer's, where trade is above the mean of all pairs.
TRADE = """(SELECT src, dst FROM (SELECT s_nationkey AS src, c_nationkey AS dst, sum(l_extendedprice) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
  QUALIFY v > 1.4 * avg(v) OVER () AND src <> dst)"""


def _trade(spark, sf_dir):
    line, supplier, orders, customer = (table(spark, sf_dir, n) for n in ("lineitem", "supplier", "orders", "customer"))
    by = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(orders, line.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey)
    by = by.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.sum("l_extendedprice").alias("v"))
    mean = by.agg(F.avg("v").alias("mean"))  # of nations by nations
    return by.join(F.broadcast(mean)).filter("v > 1.4 * mean and src <> dst").select("src", "dst")


_HOPS = """WITH RECURSIVE e AS (SELECT DISTINCT * FROM {edges}), w AS (SELECT {seed} AS seed, {seed} AS node, 0 AS distance UNION SELECT w.seed, e.dst, w.distance + 1 FROM w JOIN e ON w.node = e.src WHERE w.distance < {depth})
SELECT seed, node, min(distance) AS distance FROM w WHERE distance > 0 GROUP BY seed, node""".format


@query(_HOPS(edges=EDGES, seed="'main'", depth=3))
def q_k_hop(spark, sf_dir):
    return G.k_hop(_calls(spark), spark.createDataFrame([("main",)], "node string"), 3)


@query(_HOPS(edges="(SELECT dst AS src, src AS dst FROM " + EDGES + ")", seed="'format'", depth=3))
def q_k_hop_dependents(spark, sf_dir):
    return G.k_hop(G.reverse(_calls(spark)), spark.createDataFrame([("format",)], "node string"), 3)


@query(_HOPS(edges=TRADE, seed="3", depth=2))
def q_trade_hops(spark, sf_dir):
    return G.k_hop(_trade(spark, sf_dir), spark.createDataFrame([(3,)], "node int"), 2)


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT * FROM {EDGES}), w AS (SELECT ['main'] AS path, 'main' AS last, 0 AS depth, false AS closed UNION ALL SELECT list_append(path, dst), dst, depth + 1, list_contains(path, dst) FROM w JOIN e ON last = src WHERE depth < 5 AND NOT closed)
SELECT path, depth, closed FROM w WHERE depth > 0""")
def q_call_chain(spark, sf_dir):
    return G.call_paths(_calls(spark), spark.createDataFrame([("main",)], "node string"), 5)


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT dst AS src, src AS dst FROM {EDGES}), w AS (SELECT ['log'] AS path, 'log' AS last, 0 AS depth, false AS closed UNION ALL SELECT list_append(path, dst), dst, depth + 1, list_contains(path, dst) FROM w JOIN e ON last = src WHERE depth < 4 AND NOT closed)
SELECT path, depth, closed FROM w WHERE depth > 0""")
def q_call_chain_up(spark, sf_dir):
    return G.call_paths(G.reverse(_calls(spark)), spark.createDataFrame([("log",)], "node string"), 4)


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT * FROM {EDGES}), w AS (SELECT [src] AS path, src AS first, dst AS last FROM e WHERE src <= dst UNION ALL SELECT list_append(path, last), first, dst FROM w JOIN e ON last = src WHERE last > first AND NOT list_contains(path, last) AND dst >= first AND len(path) < 6)
SELECT path AS cycle FROM w WHERE first = last""")
def q_cycles(spark, sf_dir):
    return G.cycles(_calls(spark))


ACYCLIC = [e for e in CALLS if e not in {("check", "run"), ("pong", "ping"), ("retry", "retry")}]


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {sql_values(ACYCLIC, ["src", "dst"])}), w AS (SELECT dst AS node, 0 AS level FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT src, level + 1 FROM w JOIN e ON node = dst)
SELECT node, max(level) AS level FROM w GROUP BY node""")
def q_build_levels(spark, sf_dir):
    return G.build_levels(spark.createDataFrame(ACYCLIC, "src string, dst string"), 6)


@query(f"SELECT node, sum(o) AS out_degree, sum(i) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM {TRADE} UNION ALL SELECT dst, 0, 1 FROM {TRADE}) GROUP BY node")
def q_degrees(spark, sf_dir):
    return G.degrees(_trade(spark, sf_dir))


@query(f"WITH c AS (SELECT DISTINCT src AS node FROM {EDGES} WHERE dst IN ('log', 'format')) SELECT node IN ('main', 'lex') AS is_test, count(*) AS callers FROM c GROUP BY 1")
def q_impact(spark, sf_dir):
    calls = _calls(spark)
    nodes = calls.select(F.col("src").alias("node")).distinct().withColumn("is_test", F.col("node").isin("main", "lex"))
    return G.impact(calls, spark.createDataFrame([("log",), ("format",)], "node string"), nodes)


@query("""SELECT DISTINCT c.ref AS qa_id FROM (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS ref FROM events WHERE event_type = 'view') c JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') u USING (user_id)
UNION SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) FROM events WHERE event_type = 'purchase' AND value > 90""")
def q_affected(spark, sf_dir):
    """References touched through either of two edges (file of a change, symbol of a change), each once."""
    events = table(spark, sf_dir, "events").withColumn("qa_id", F.get_json_object("props", "$.k").cast("int"))
    users = events.filter("event_type = 'error'").select("user_id").distinct()
    one = events.filter("event_type = 'view'").join(users, "user_id", "left_semi").select("qa_id")
    return one.union(events.filter("event_type = 'purchase' and value > 90").select("qa_id")).distinct()
