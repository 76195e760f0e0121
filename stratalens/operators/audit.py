"""Audit log, retention, access counters and recommendations over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators.blocking import sums_before


def as_of(log: DataFrame) -> DataFrame:
    """The log's last moment, in one row: 'now' for windows and retention."""
    return log.agg(F.max("ts").alias("now"))


def within_days(log: DataFrame, days: int) -> DataFrame:
    return log.join(F.broadcast(as_of(log))).filter(F.col("ts") >= F.col("now") - F.make_dt_interval(F.lit(days))).drop("now")


def statistics(log: DataFrame, days: int) -> DataFrame:
    """Of the last `days` days: total, success_rate (1.0 when empty), users, refs."""
    recent = within_days(log, days)
    rate = F.coalesce(F.avg(F.col("success").cast("double")), F.lit(1.0))
    return recent.agg(F.count(F.lit(1)).alias("total"), F.round(rate, 6).alias("success_rate"), F.count_distinct("user_id").alias("users"), F.count_distinct("ref").alias("refs"))


def counts_by(log: DataFrame, days: int) -> DataFrame:
    """Counts by operation and by level of the last days: kind, name, n."""
    recent = within_days(log, days)
    pairs = F.explode(F.array(F.struct(F.lit("operation").alias("kind"), F.col("operation").alias("name")), F.struct(F.lit("level").alias("kind"), F.col("level").alias("name"))))
    return recent.select(pairs.alias("p")).groupBy("p.kind", "p.name").agg(F.count(F.lit(1)).alias("n"))


def trail(log: DataFrame, where: list[Column], limit: int) -> DataFrame:
    """The newest entries that satisfy every condition; equal times by id."""
    for condition in where:
        log = log.filter(condition)
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def retained(log: DataFrame, days: int) -> DataFrame:
    """Entries that retention keeps; rows whose time can't be read are kept."""
    return log.join(F.broadcast(as_of(log))).filter(F.col("ts").isNull() | (F.col("ts") >= F.col("now") - F.make_dt_interval(F.lit(days)))).drop("now")


def collectable(items: DataFrame, key: str, size: str, age: str, limit: int) -> DataFrame:
    """What a cache collector deletes: oldest first until the rest fits into `limit`. Sums run within ranges of age, so that no
    task orders the whole cache."""
    by = items.groupBy(age).agg(F.sum(size).alias("bytes"))
    newer = sums_before(by, age, "bytes", name="newer")
    within = Window.partitionBy(age).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return items.join(newer.select(age, "newer"), age).withColumn("kept", F.col("newer") + F.sum(size).over(within)).filter(F.col("kept") > limit).select(key, size)


def access_counts(log: DataFrame) -> DataFrame:
    return log.filter("ref is not null").groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


def popular(log: DataFrame, k: int, least: int = 3) -> DataFrame:
    """The k most accessed, of which those with `least` accesses count: ref, score."""
    top = access_counts(log).orderBy(F.desc("n"), "ref").limit(k)
    return top.filter(F.col("n") >= least).select("ref", (0.5 + F.least(0.03 * F.col("n"), F.lit(0.5))).alias("score"))


def by_history(log: DataFrame, k: int, least: int = 2) -> DataFrame:
    """Of each user the k most accessed, of which those with `least` accesses count: user_id, ref, score."""
    counts = log.filter("ref is not null").groupBy("user_id", "ref").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "ref")
    top = counts.withColumn("r", F.row_number().over(w)).filter((F.col("r") <= k) & (F.col("n") >= least))
    return top.select("user_id", "ref", (0.7 + F.least(0.05 * F.col("n"), F.lit(0.3))).alias("score"))


def merged(sources: list[DataFrame], k: int) -> DataFrame:
    """Recommendations (user_id, ref, score) of several sources: the first source of a reference wins, the k best of each user."""
    every = None
    for i, s in enumerate(sources):
        part = s.select("user_id", "ref", "score", F.lit(i).alias("source"))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy("user_id", "ref").agg(F.min_by("score", "source").alias("score"), F.min("source").alias("source"))
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "source", "ref")
    return first.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")
