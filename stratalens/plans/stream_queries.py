"""Streams and change listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.registry import query, sql_values
from stratalens.sources.tables import table
from stratalens.streaming import changes as C

GAP = "30 minutes"


@query("""SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS batch FROM (
  SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, batch""")
def q_change_batches(spark, sf_dir):
    return C.change_batches(table(spark, sf_dir, "events"), GAP)


@query("SELECT event_type, count(*) AS n, count(CASE WHEN value > 50 THEN 1 END) AS high FROM events GROUP BY event_type")
def q_stream_counts(spark, sf_dir):
    """Run as a stream over the table's file."""
    counts = C.read_stream(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") > 50, 1)).alias("high"))
    return C.run_available(counts)


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_stream_windows(spark, sf_dir):
    """Tumbling days with a watermark, run as a stream."""
    rows = C.read_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    by = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
    return C.run_available(by)


@query("SELECT handler, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'index' WHEN 'error' THEN 'alert' WHEN 'purchase' THEN 'ledger' ELSE 'default' END AS handler FROM events) GROUP BY handler")
def q_event_routes(spark, sf_dir):
    return C.routed(table(spark, sf_dir, "events"), {"view": "index", "error": "alert", "purchase": "ledger"}).groupBy("handler").agg(F.count(F.lit(1)).alias("n"))


PUSHES = [
    (1, '{"commits": [{"added": ["a.py", "b.py"], "modified": ["c.py"], "removed": []}, {"added": [], "modified": ["a.py"], "removed": ["d.py"]}]}'),
    (2, '{"commits": [{"modified": ["x.go"]}]}'),
    (3, '{"commits": []}'),
]


@query(f"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY c, k, i) - 1 AS INTEGER) AS position, file FROM (SELECT id, c, k, generate_subscripts(files, 1) AS i, unnest(files) AS file FROM (
  SELECT id, c, k, CAST(json_extract(commit, '$.' || ['added', 'modified', 'removed'][k]) AS VARCHAR[]) AS files FROM (SELECT id, generate_subscripts(cs, 1) AS c, unnest(cs) AS commit FROM (SELECT id, CAST(json_extract(payload, '$.commits') AS JSON[]) AS cs FROM {sql_values(PUSHES, ["id", "payload"])})), (SELECT unnest([1, 2, 3]) AS k)) WHERE files IS NOT NULL)""")
def q_push_flatten(spark, sf_dir):
    return C.pushed_files(spark.createDataFrame(PUSHES, "id int, payload string"))


DIFF = [(1, "A\tsrc/new.py"), (2, "M\tsrc/old.py"), (3, "D\tgone.c"), (4, "R087\tfrom.js\tto.js"), (5, "C100\tone.rs\ttwo.rs"), (6, "T\tlink")]


@query(f"""SELECT id, CASE substr(p[1], 1, 1) WHEN 'A' THEN 'added' WHEN 'M' THEN 'modified' WHEN 'D' THEN 'deleted' WHEN 'R' THEN 'renamed' WHEN 'C' THEN 'copied' ELSE 'unknown' END AS change, CASE WHEN substr(p[1], 1, 1) IN ('R', 'C') THEN p[3] ELSE p[2] END AS path, CASE WHEN substr(p[1], 1, 1) IN ('R', 'C') THEN p[2] END AS old_path
  FROM (SELECT id, string_split(line, chr(9)) AS p FROM {sql_values(DIFF, ["id", "line"])})""")
def q_name_status(spark, sf_dir):
    return C.name_status(spark.createDataFrame(DIFF, "id int, line string"))


STATUS = [(1, "M  staged.py"), (2, " M edited.py"), (3, "?? new.txt"), (4, "UU both.c"), (5, "A  added.go"), (6, "MM twice.js")]


@query(f"SELECT id, CASE WHEN substr(line, 1, 2) = '??' THEN 'untracked' WHEN substr(line, 1, 2) IN ('UU', 'AA', 'DD', 'AU', 'UA', 'DU', 'UD') THEN 'conflict' WHEN substr(line, 1, 1) <> ' ' THEN 'staged' WHEN substr(line, 2, 1) <> ' ' THEN 'unstaged' END AS kind, substr(line, 4) AS path FROM {sql_values(STATUS, ['id', 'line'])}")
def q_short_status(spark, sf_dir):
    return C.short_status(spark.createDataFrame(STATUS, "id int, line string"))


STATS = [(1, "10\t2\ta.py"), (2, "-\t-\timage.png"), (3, "0\t7\tb.c")]


@query(f"SELECT id, p[3] AS path, coalesce(TRY_CAST(p[1] AS INTEGER), 0) AS added, coalesce(TRY_CAST(p[2] AS INTEGER), 0) AS removed FROM (SELECT id, string_split(line, chr(9)) AS p FROM {sql_values(STATS, ['id', 'line'])})")
def q_diff_stats(spark, sf_dir):
    return C.diff_stats(spark.createDataFrame(STATS, "id int, line string"))
