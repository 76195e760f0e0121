"""Reports over the business tables, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import text as T
from stratalens.operators import reports as R
from stratalens.plans.graph_queries import CALLS, EDGES
from stratalens.registry import query, sql_values
from stratalens.sources.corpus import FILES
from stratalens.sources.tables import table


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def q_top_sources(spark, sf_dir):
    return R.top(table(spark, sf_dir, "documents"), ["source"], 10)


@query("""SELECT source, count(*) AS total, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS active, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS archived, sum(n_chars) AS views FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def q_team_stats(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("active"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("archived"), F.sum("n_chars").alias("views"))


@query("SELECT lang, count(*) AS n, list_sort(list(doc_id) FILTER (r <= 20)) AS items FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) GROUP BY lang")
def q_source_groups(spark, sf_dir):
    return R.grouped(table(spark, sf_dir, "documents"), "lang", "doc_id", 20)


@query("SELECT user_id, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id FROM events WHERE event_type = 'click') GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def q_contributors(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    both = events.filter("event_type = 'purchase'").select("user_id").unionByName(events.filter("event_type = 'click'").select("user_id"))
    return R.top(both, ["user_id"], 10)


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, max(turn) AS last_turn, sum(length(text)) AS chars FROM conversations GROUP BY conv_id")
def q_collaboration(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("role").alias("roles"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


@query("SELECT a.conv_id, a.turn AS parent, b.turn AS reply FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'")
def q_replies(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("reply"))
    return rows.filter("role = 'user'").join(after, ["conv_id", "turn"]).select("conv_id", F.col("turn").alias("parent"), "reply")


@query(f"SELECT 'graph LR' || chr(10) || string_agg('    ' || src || ' --> ' || dst, chr(10) ORDER BY '    ' || src || ' --> ' || dst) AS text FROM (SELECT DISTINCT * FROM {EDGES})")
def q_diagram(spark, sf_dir):
    return R.diagram(spark.createDataFrame(CALLS, "src string, dst string"))


@query("SELECT r_name, '## Nations: ' || r_name || chr(10) || chr(10) || string_agg('- ' || n_name, chr(10) ORDER BY '- ' || n_name) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def q_markdown(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return R.markdown(nation.join(region, nation.n_regionkey == region.r_regionkey), "Nations", "r_name", F.col("n_name"))


@query("SELECT r_name, '# ' || r_name || CASE WHEN count(*) > 3 THEN ' (large)' ELSE '' END || chr(10) || string_agg('- ' || n_name || chr(10), '' ORDER BY n_name) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def q_templates(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    by = nation.join(region, nation.n_regionkey == region.r_regionkey).groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("nations"), (F.count(F.lit(1)) > 3).alias("large"))
    return R.rendered(by, "r_name", "# {{ r_name }}{% if large %} (large){% endif %}\n{% for n in nations %}- {{ n }}\n{% endfor %}")


PATHS = sql_values([(p,) for p, _ in FILES], ["path"])


@query(f"SELECT folder, count(*) AS n, list_sort(list(file) FILTER (r <= 10)) AS items FROM (SELECT folder, file, row_number() OVER (PARTITION BY folder ORDER BY file) AS r FROM (SELECT regexp_extract(path, '^(.*)/[^/]+$', 1) AS folder, regexp_extract(path, '([^/]+)$', 1) AS file FROM {PATHS})) GROUP BY folder")
def q_tree(spark, sf_dir):
    return R.tree(spark.createDataFrame([(p,) for p, _ in FILES], "path string"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.a.b') AS nested FROM events")
def q_config_get(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.a.b").alias("nested"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.1f B', CAST(n_chars AS DOUBLE)) WHEN n_chars < 1048576 THEN printf('%.1f KB', round(n_chars / 1024.0, 1)) ELSE printf('%.1f MB', round(n_chars / 1048576.0, 1)) END AS size FROM documents")
def q_human_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.human_size(F.col("n_chars").cast("double")).alias("size"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def q_pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    price = F.col("l_extendedprice")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN n >= 3 THEN 'complete' WHEN n = 2 THEN 'partial' WHEN n = 1 THEN 'started' ELSE 'missing' END AS status FROM (SELECT doc_id, CAST(contains(text, '.') AS INTEGER) + CAST(contains(text, chr(10)) AS INTEGER) + CAST(contains(text, ',') AS INTEGER) AS n FROM documents)")
def q_output_validation(spark, sf_dir):
    n = sum(F.contains("text", F.lit(x)).cast("int") for x in (".", "\n", ","))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(n >= 3, "complete").when(n == 2, "partial").when(n == 1, "started").otherwise("missing").alias("status"))
