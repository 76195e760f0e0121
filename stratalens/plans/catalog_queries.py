"""Maintenance queries: diffs, upserts, merges, votes and access over the business tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import patterns as P
from stratalens.operators import catalog as C
from stratalens.registry import query, sql_values
from stratalens.sources.tables import table

# Two snapshots of the documents: the old lacks multiples of 7, the new lacks multiples of 11; multiples of 5 changed.
OLD = "(SELECT doc_id, md5(text) AS v FROM documents WHERE doc_id % 7 <> 0)"
NEW = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN md5(text || '!') ELSE md5(text) END AS v FROM documents WHERE doc_id % 11 <> 0)"


def _snapshots(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    new = F.when(F.col("doc_id") % 5 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text"))
    return docs.filter("doc_id % 7 <> 0").select("doc_id", F.md5("text").alias("v")), docs.filter("doc_id % 11 <> 0").select("doc_id", new.alias("v"))


@query(f"SELECT doc_id, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM {OLD} o FULL JOIN {NEW} n USING (doc_id) WHERE o.v IS DISTINCT FROM n.v")
def q_snapshot_diff(spark, sf_dir):
    return C.snapshot_diff(*_snapshots(spark, sf_dir), "doc_id", "v")


@query(f"SELECT doc_id, coalesce(n.v, o.v) AS v FROM {OLD} o FULL JOIN {NEW} n USING (doc_id)")
def q_upsert(spark, sf_dir):
    return C.upsert(*_snapshots(spark, sf_dir), ["doc_id"])


@query(f"SELECT doc_id, coalesce(o.v, n.v) AS v FROM {OLD} o FULL JOIN {NEW} n USING (doc_id)")
def q_insert_absent(spark, sf_dir):
    return C.insert_absent(*_snapshots(spark, sf_dir), ["doc_id"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 OR abs(o_orderkey % 4) > 1")
def q_time_diff(spark, sf_dir):
    """Old times are known for orders not divisible by 3; new times moved by the key modulo 4 seconds."""
    orders = table(spark, sf_dir, "orders")
    old = orders.filter("o_orderkey % 3 <> 0").select("o_orderkey", F.lit(0).cast("double").alias("t"))
    new = orders.select("o_orderkey", (F.col("o_orderkey") % 4).cast("double").alias("t"))
    return C.time_diff(old, new, "o_orderkey", "t")


@query("""SELECT qa_id, path, CASE WHEN mtime IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM (SELECT l_orderkey AS qa_id, l_partkey AS path, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber * 10 END AS stored FROM lineitem) r
  LEFT JOIN (SELECT p_partkey AS path, p_size AS mtime FROM part WHERE p_partkey % 9 <> 0) f USING (path) WHERE mtime IS NULL OR mtime > coalesce(stored, 0)""")
def q_staleness(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qa_id"), F.col("l_partkey").alias("path"), F.when(F.col("l_linenumber") != 1, F.col("l_linenumber") * 10).alias("stored"))
    files = table(spark, sf_dir, "part").filter("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("mtime"))
    return C.staleness(refs, files)


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM nation WHERE contains(c_mktsegment, substr(n_name, 1, 1)) OR contains(substr(n_name, 1, 1), c_mktsegment))")
def q_invalidate(spark, sf_dir):
    changed = table(spark, sf_dir, "nation").select(F.substring("n_name", 1, 1).alias("file"))
    return C.invalidated(table(spark, sf_dir, "customer"), changed, "c_mktsegment", "file").select("c_custkey")


_T = "(SELECT o_orderkey AS id, o_totalprice AS price, o_orderdate AS at FROM orders WHERE o_orderkey % 3 <> 0)"
_S = "(SELECT o_orderkey AS id, o_totalprice + 1 AS price, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS at FROM orders WHERE o_orderkey % 5 <> 0)"


def _merge_sides(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    at = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate") + F.expr("interval 1 day")).otherwise(F.col("o_orderdate"))
    t = orders.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("at"))
    return t, orders.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") + 1).alias("price"), at.alias("at"))


@query(f"SELECT id, CASE WHEN t.id IS NULL OR s.at > t.at THEN s.price ELSE t.price END AS price, CASE WHEN t.id IS NULL OR s.at > t.at THEN s.at ELSE t.at END AS at FROM {_T} t FULL JOIN {_S} s USING (id)")
def q_merge_newer(spark, sf_dir):
    return C.merge_entries(*_merge_sides(spark, sf_dir), "id", "at")


@query(f"SELECT id, coalesce(s.price, t.price) AS price, coalesce(s.at, t.at) AS at FROM {_T} t FULL JOIN {_S} s USING (id)")
def q_merge_source(spark, sf_dir):
    return C.merge_entries(*_merge_sides(spark, sf_dir), "id", "at", "keep_source")


@query("""SELECT o_orderkey, list_sort(list_distinct(list_concat([o_orderpriority, o_orderstatus], coalesce(flags, [])))) AS tags, greatest(o_totalprice, coalesce(top, o_totalprice)) AS price FROM orders
  LEFT JOIN (SELECT l_orderkey AS o_orderkey, list(DISTINCT l_returnflag) AS flags, max(l_extendedprice) AS top FROM lineitem GROUP BY 1) USING (o_orderkey)""")
def q_merge_sets(spark, sf_dir):
    target = table(spark, sf_dir, "orders").select("o_orderkey", F.array("o_orderpriority", "o_orderstatus").alias("tags"), F.col("o_totalprice").alias("price"))
    source = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("tags"), F.max("l_extendedprice").alias("price"))
    return C.merge_sets(target, source, "o_orderkey", ["tags"], ["price"], [])


@query("SELECT n_name, count(*) AS members, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY n_name")
def q_team_members(spark, sf_dir):
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    both = customer.filter("c_mktsegment = 'BUILDING'").join(nation, customer.c_nationkey == nation.n_nationkey)
    return both.groupBy("n_name").agg(F.count(F.lit(1)).alias("members"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT l_partkey, sum(vote) AS votes FROM (SELECT l_partkey, l_suppkey, CASE l_returnflag WHEN 'R' THEN -1 WHEN 'A' THEN 1 ELSE 0 END AS vote, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem) WHERE r = 1 GROUP BY l_partkey""")
def q_net_votes(spark, sf_dir):
    votes = table(spark, sf_dir, "lineitem").withColumn("vote", F.when(F.col("l_returnflag") == "R", -1).when(F.col("l_returnflag") == "A", 1).otherwise(0))
    return C.net_votes(votes, "l_partkey", "l_suppkey", [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")])


_ROLES = sql_values([(r, a) for r, actions in P.ROLES.items() for a in actions], ["role", "action"])
_ROLE_OF = "CASE {0} % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'member' WHEN 2 THEN 'viewer' ELSE 'contributor' END".format


@query(f"""WITH rp AS (SELECT * FROM {_ROLES}), res AS (SELECT p_partkey AS resource_id, p_partkey % 1000 AS owner, p_size % 25 AS team, CASE WHEN p_partkey % 10 = 0 THEN 'public' ELSE 'team' END AS visibility FROM part),
  req AS (SELECT l_suppkey AS user_id, l_partkey AS resource_id, CASE l_linenumber % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'delete' END AS action FROM lineitem),
  mem AS (SELECT s_suppkey AS user_id, s_nationkey AS team, {_ROLE_OF('s_suppkey')} AS role FROM supplier), gr AS (SELECT DISTINCT l_suppkey AS user_id, l_partkey AS resource_id, {_ROLE_OF('l_orderkey')} AS role FROM lineitem)
SELECT user_id, resource_id, action, (owner = user_id) OR EXISTS (SELECT 1 FROM gr JOIN rp USING (role) WHERE gr.user_id = req.user_id AND gr.resource_id = req.resource_id AND rp.action = req.action)
  OR (EXISTS (SELECT 1 FROM mem WHERE mem.user_id = req.user_id AND mem.team = res.team) AND (action = 'read' OR EXISTS (SELECT 1 FROM mem JOIN rp USING (role) WHERE mem.user_id = req.user_id AND mem.team = res.team AND rp.action = req.action)))
  OR (visibility = 'public' AND action = 'read') AS allowed FROM req JOIN res USING (resource_id)""")
def q_rbac(spark, sf_dir):
    role = lambda c: F.element_at(F.array(*[F.lit(r) for r in ("admin", "member", "viewer", "contributor")]), (F.col(c) % 4 + 1).cast("int"))
    permissions = spark.createDataFrame([(r, a) for r, actions in P.ROLES.items() for a in actions], "role string, action string")
    part, line, supplier = (table(spark, sf_dir, n) for n in ("part", "lineitem", "supplier"))
    resources = part.select(F.col("p_partkey").alias("resource_id"), (F.col("p_partkey") % 1000).alias("owner"), (F.col("p_size") % 25).alias("team"), F.when(F.col("p_partkey") % 10 == 0, "public").otherwise("team").alias("visibility"))
    action = F.when(F.col("l_linenumber") % 3 == 0, "read").when(F.col("l_linenumber") % 3 == 1, "write").otherwise("delete")
    requests = line.select(F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("resource_id"), action.alias("action"))
    members = supplier.select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("team"), role("s_suppkey").alias("role"))
    grants = line.select(F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("resource_id"), role("l_orderkey").alias("role")).distinct()
    return C.decisions(requests, resources, members, grants, permissions)


@query("SELECT role, list_sort(list(action)) AS actions FROM " + _ROLES + " GROUP BY role")
def q_permission_matrix(spark, sf_dir):
    rows = spark.createDataFrame([(r, a) for r, actions in P.ROLES.items() for a in actions], "role string, action string")
    return rows.groupBy("role").agg(F.sort_array(F.collect_list("action")).alias("actions"))


@query("SELECT l_orderkey, max(l_linenumber) + 1 AS version FROM lineitem GROUP BY l_orderkey")
def q_next_version(spark, sf_dir):
    return C.next_version(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("version")), "l_orderkey")


_ACTION = "CASE event_type WHEN 'view' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'merge' ELSE 'comment' END"


@query(f"""WITH e AS (SELECT user_id, event_id, {_ACTION} AS action FROM events), d AS (SELECT user_id, min(event_id) AS at, arg_min(action, event_id) AS action FROM e WHERE action IN ('approve', 'reject') GROUP BY user_id)
SELECT u.user_id, CASE WHEN d.action IS NULL THEN 'pending' WHEN d.action = 'reject' THEN 'rejected' WHEN EXISTS (SELECT 1 FROM e WHERE e.user_id = u.user_id AND e.event_id > d.at AND e.action = 'merge') THEN 'merged' ELSE 'approved' END AS status
FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN d USING (user_id)""")
def q_workflow(spark, sf_dir):
    action = F.when(F.col("event_type") == "view", "approve").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "purchase", "merge").otherwise("comment")
    return C.workflow_status(table(spark, sf_dir, "events").select("user_id", "event_id", action.alias("action")), "user_id", "event_id")
