"""Streams with state of their own: results with a life time, pairs of streams within an interval, deliveries that come twice or late.

Results depend on event time alone: however rows are dealt to micro-batches, and in whatever order they come within the watermark's
delay, the same rows come out. Files are landed in batches where a test or a query needs several of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stratalens.sources.staging import shared_folder

#: The state store that keeps timers and keyed lists.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def land(batches: list[DataFrame], folder: str) -> str:
    """Write batches one after another into a folder, a file each, as a sender would."""
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(folder)
    return folder


def landed(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The files of a folder as a stream, one a micro-batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run_append(df: DataFrame) -> tuple[DataFrame, int]:
    """Run a stream over what is there: its rows, and how many rows came too late for the state they were meant for. Micro-batches go
    to files of their own, so one that is run again writes the same ones."""
    spark, out = df.sparkSession, shared_folder(df.sparkSession, "appended")
    query = df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
    return spark.read.schema(df.schema).parquet(out), late


class Detections(StatefulProcessor):
    """Requests of a project in the order of their times, and the one result that is alive.

    Requests wait until the watermark has passed them, so their order is certain. A timer at the earliest of them, or at the end of
    the result's life, brings the state up to date; a result that nobody asks for again leaves no state.
    """

    def __init__(self, life: timedelta):
        self._life = int(life.total_seconds() * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "ts long, request long")
        self._made = handle.getValueState("made", "made long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.ts, r.request) for r in rows]
        self._waiting.appendList(new)
        self._wake(min(ts for ts, _ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        sure = timerValues.getCurrentWatermarkInMs() * 1_000
        waiting = sorted((r[0], r[1]) for r in self._waiting.get()) if self._waiting.exists() else []
        made = self._made.get()[0] if self._made.exists() else None
        for ts, request in [w for w in waiting if w[0] <= sure]:
            hit = made is not None and ts < made + self._life
            made = made if hit else ts
            yield Row(project=key[0], request=request, at=ts, hit=hit, since=made)
        later = [w for w in waiting if w[0] > sure]
        if later:
            self._waiting.put(later)
            self._wake(later[0][0])
        else:
            self._waiting.clear()
        if made is not None and made + self._life > sure:
            self._made.update((made,))
            self._wake(made + self._life)
        else:
            self._made.clear()

    def close(self) -> None:
        pass

    def _wake(self, ts: int) -> None:
        """A timer at the first millisecond that isn't before `ts`, so that the watermark has passed it."""
        self._handle.registerTimer(-(-ts // 1_000))


def detections(requests: DataFrame, life: timedelta, delay: str | None) -> DataFrame:
    """Requests (project, request, ts) answered from the project's last result while that is younger than `life`, else by a new one:
    project, request, ts, hit, made (when the result was made). Append-only stream; a request comes out when the watermark has passed
    it. Requests of one time are taken in the order of their numbers. Without a delay, `ts` (a timestamp) has a watermark already. Needs
    the state store STORE."""
    timed = requests.withColumn("__at", F.col("ts").cast("timestamp")).withWatermark("__at", delay) if delay else requests.withColumn("__at", F.col("ts"))
    rows = timed.select("project", F.col("request").cast("long").alias("request"), F.unix_micros("__at").alias("ts"), "__at")
    kind = dict(requests.dtypes)["project"]
    out = rows.groupBy("project").transformWithState(Detections(life), f"project {kind}, request long, at long, hit boolean, since long", "Append", "EventTime")
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return out.select("project", "request", time("at").alias("ts"), "hit", time("since").alias("made"))


def once(rows: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """A stream without repeated deliveries of a key; state is kept as long as the watermark allows one. Rows later than that are
    dropped, and counted by `run_append`."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def matched(requests: DataFrame, reviews: DataFrame, key: str, within: str, delay: str, how: str = "inner") -> DataFrame:
    """Reviews (event_id, ts, key) that follow a request of the same key within an interval: key, request, review, asked, reviewed.
    Both are streams with repeated deliveries; `leftOuter` gives requests without a review once none can come."""
    left = once(requests.select(F.col(key).alias("__k"), F.col("event_id").alias("request"), F.col("ts").alias("asked")), "request", "asked", delay)
    right = once(reviews.select(key, F.col("event_id").alias("review"), F.col("ts").alias("reviewed")), "review", "reviewed", delay)
    on = (F.col("__k") == F.col(key)) & F.expr(f"reviewed >= asked AND reviewed <= asked + INTERVAL {within}")
    return left.join(right, on, how).select(F.col("__k").alias(key), "request", "review", "asked", "reviewed")
