"""Audit, retention and recommendation queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import audit as A
from stratalens.registry import query
from stratalens.sources.tables import AUDIT_SQL, audit, table

DAYS = 7
RECENT = f"(SELECT * FROM {AUDIT_SQL} WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {DAYS} DAY)"


def _log(spark, sf_dir):
    return audit(table(spark, sf_dir, "events"))


@query(f"SELECT count(*) AS total, round(coalesce(avg(CAST(success AS DOUBLE)), 1.0), 6) AS success_rate, count(DISTINCT user_id) AS users, count(DISTINCT ref) AS refs FROM {RECENT}")
def q_audit_stats(spark, sf_dir):
    return A.statistics(_log(spark, sf_dir), DAYS)


@query(f"SELECT 'operation' AS kind, operation AS name, count(*) AS n FROM {RECENT} GROUP BY operation UNION ALL SELECT 'level', level, count(*) FROM {RECENT} GROUP BY level")
def q_audit_counts(spark, sf_dir):
    return A.counts_by(_log(spark, sf_dir), DAYS)


@query(f"SELECT event_id, user_id, operation, level FROM {AUDIT_SQL} WHERE operation = 'error' AND NOT success AND level = 'ERROR' ORDER BY ts DESC, event_id DESC LIMIT 100")
def q_audit_trail(spark, sf_dir):
    return A.trail(_log(spark, sf_dir), [F.col("operation") == "error", ~F.col("success"), F.col("level") == "ERROR"], 100).select("event_id", "user_id", "operation", "level")


@query(f"SELECT operation, count(*) AS n FROM {RECENT} GROUP BY operation")
def q_retention(spark, sf_dir):
    return A.retained(_log(spark, sf_dir), DAYS).groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id % 30 DESC, doc_id ROWS UNBOUNDED PRECEDING) AS kept FROM documents) WHERE kept > 1000000""")
def q_cache_gc(spark, sf_dir):
    """A document's age is doc_id modulo 30."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 30).alias("age"))
    return A.collectable(docs, "doc_id", "n_chars", "age", 1_000_000)


ACCESS = f"(SELECT user_id, ref FROM {AUDIT_SQL} WHERE ref IS NOT NULL)"


@query(f"SELECT ref, round(0.5 + least(0.03 * n, 0.5), 6) AS score FROM (SELECT ref, count(*) AS n FROM {ACCESS} GROUP BY ref ORDER BY n DESC, ref LIMIT 20) WHERE n >= 3")
def q_popular(spark, sf_dir):
    return A.popular(_log(spark, sf_dir), 20).withColumn("score", F.round("score", 6))


HISTORY = f"(SELECT user_id, ref, 0.7 + least(0.05 * n, 0.3) AS score FROM (SELECT user_id, ref, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, ref) AS r FROM {ACCESS} GROUP BY user_id, ref) WHERE r <= {{k}} AND n >= 2)".format


@query(f"SELECT user_id, ref, round(score, 6) AS score FROM {HISTORY(k=5)}")
def q_history(spark, sf_dir):
    return A.by_history(_log(spark, sf_dir), 5).withColumn("score", F.round("score", 6))


@query(f"""WITH pop AS (SELECT ref, 0.5 + least(0.03 * n, 0.5) AS score FROM (SELECT ref, count(*) AS n FROM {ACCESS} GROUP BY ref ORDER BY n DESC, ref LIMIT 6) WHERE n >= 3),
  e AS (SELECT user_id, ref, score, 0 AS source FROM {HISTORY(k=6)} UNION ALL SELECT u.user_id, pop.ref, pop.score, 1 FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) u, pop),
  f AS (SELECT user_id, ref, arg_min(score, source) AS score, min(source) AS source FROM e GROUP BY user_id, ref)
SELECT user_id, ref, round(score, 6) AS score, source FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, source, ref) AS r FROM f) WHERE r <= 8""")
def q_recommend(spark, sf_dir):
    log = _log(spark, sf_dir)
    users = log.filter("user_id is not null").select("user_id").distinct()
    general = users.join(F.broadcast(A.popular(log, 6)))  # six rows at most
    return A.merged([A.by_history(log, 6), general], 8).withColumn("score", F.round("score", 6))


@query(f"SELECT count(DISTINCT user_id) AS users, count(*) AS accesses, count(DISTINCT ref) AS refs FROM {ACCESS}")
def q_recommender_stats(spark, sf_dir):
    return _log(spark, sf_dir).filter("ref is not null").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("accesses"), F.count_distinct("ref").alias("refs"))


@query(f"SELECT user_id, operation, count(*) AS n, round(sum(value), 4) AS total FROM {AUDIT_SQL} GROUP BY GROUPING SETS ((user_id), (operation), ())")
def q_audit_rollup(spark, sf_dir):
    log = _log(spark, sf_dir)
    log.createOrReplaceTempView("audit_log")
    return spark.sql("SELECT user_id, operation, count(*) AS n, round(sum(value), 4) AS total FROM audit_log GROUP BY GROUPING SETS ((user_id), (operation), ())")


@query(f"SELECT date_trunc('day', ts) AS day, count(*) AS n, sum(CASE WHEN success THEN 0 ELSE 1 END) AS failures FROM {AUDIT_SQL} GROUP BY 1")
def q_audit_daily(spark, sf_dir):
    return _log(spark, sf_dir).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("success"), 0).otherwise(1)).alias("failures"))
