"""Streams with state: the events landed in three batches, with deliveries that come twice or late."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import functions as F

from stratalens.registry import query
from stratalens.sources.staging import shared_folder
from stratalens.sources.tables import table
from stratalens.streaming import stateful as S

#: Ends of the first two batches; events of the first that come again in the third are late where they are older than LATE.
CUTS, LATE = ("2024-01-11", "2024-01-21"), "2024-01-05"
DELAY, LIFE, WITHIN = "2 days", timedelta(days=2), "1 DAY"


@contextmanager
def _store(spark) -> Iterator[None]:
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, S.STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _landed(spark, sf_dir, kinds: list[str] | None = None):
    """The events in three batches: the second twice, the third with old ones of the first again."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    if kinds:
        events = events.filter(F.col("event_type").isin(kinds))
    ts = F.col("ts")
    first, second, third = events.filter(ts < CUTS[0]), events.filter((ts >= CUTS[0]) & (ts < CUTS[1])), events.filter(ts >= CUTS[1])
    folder = S.land([first, second.unionByName(second), third.unionByName(first.filter(ts < LATE))], shared_folder(spark, "landed"))
    return S.landed(spark, folder, events.schema)


@query(f"""WITH RECURSIVE wm AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL {DELAY} AS w FROM events), e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events, wm WHERE ts <= w),
  m AS (SELECT user_id, k, event_id, ts, false AS hit, ts AS made FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.event_id, e.ts, e.ts < m.made + INTERVAL {LIFE.days} DAY, CASE WHEN e.ts < m.made + INTERVAL {LIFE.days} DAY THEN m.made ELSE e.ts END FROM m JOIN e ON e.user_id = m.user_id AND e.k = m.k + 1)
SELECT user_id AS project, event_id AS request, ts, hit, made FROM m""")
def q_detection_cache(spark, sf_dir):
    """Every event asks for its user's detection: answered from the last result for two days, up to the watermark."""
    with _store(spark):
        events = S.once(_landed(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "event_id", "ts", DELAY)
        return S.run_append(S.detections(events.select(F.col("user_id").alias("project"), F.col("event_id").alias("request"), "ts"), LIFE, None))[0]


_PAIRS = f"FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL {WITHIN}"


def _matched(spark, sf_dir):
    events = _landed(spark, sf_dir, ["view", "purchase"]).withColumn("ts", F.col("ts").cast("timestamp"))
    again = _landed(spark, sf_dir, ["view", "purchase"]).withColumn("ts", F.col("ts").cast("timestamp"))
    return S.run_append(S.matched(events.filter("event_type = 'view'"), again.filter("event_type = 'purchase'"), "user_id", WITHIN, DELAY))


@query(f"SELECT a.user_id, a.event_id AS request, b.event_id AS review, a.ts AS asked, b.ts AS reviewed {_PAIRS}")
def q_request_reviews(spark, sf_dir):
    """Requests (views) and their reviews (purchases) of a user within a day, from two streams."""
    time = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return _matched(spark, sf_dir)[0].select("user_id", "request", "review", time("asked"), time("reviewed"))


@query(f"SELECT (SELECT count(*) {_PAIRS}) AS pairs, (SELECT count(*) FROM events WHERE event_type IN ('view', 'purchase') AND ts < '{LATE}') AS late")
def q_late_deliveries(spark, sf_dir):
    """How many pairs there are, and how many deliveries came too late to be told from new ones."""
    pairs, late = _matched(spark, sf_dir)
    return pairs.agg(F.count(F.lit(1)).alias("pairs")).withColumn("late", F.lit(late).cast("long"))
