"""Change events as streams: debounced batches, routing, flattening, incremental indexes.

Every transformation works on batch and streaming tables alike. Debouncing is a session window over event time: late events can
extend or join batches until the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.operators.catalog import latest
from stratalens.sources import buckets as B
from stratalens.sources.staging import drop, shared_folder, written


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file as a stream; the schema comes from the file at plan time."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_available(df: DataFrame) -> DataFrame:
    """Run a streaming aggregate over what is there, and return its result table. Each micro-batch's whole result goes to files of its
    own, so nothing is kept on the driver, and a batch that is run again writes the same ones."""
    spark, out = df.sparkSession, shared_folder(df.sparkSession, "stream")
    last = []

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        last[:] = [batch_id]

    df.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/batch={last[0]}") if last else spark.createDataFrame([], df.schema)


def change_batches(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """Debounced batches of each key: key, started, ended (last event), n."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    by = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n"))
    return by.select(key, "started", "ended", "n")


def routed(events: DataFrame, routes: dict[str, str], default: str = "default") -> DataFrame:
    """Events with the handler of their type."""
    table = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])
    return events.withColumn("handler", F.coalesce(F.try_element_at(table, F.col("event_type")), F.lit(default)))


def pushed_files(payloads: DataFrame) -> DataFrame:
    """Files of push payloads (id, payload as JSON): id, position, file; added, modified and removed of each commit in turn."""
    schema = "commits array<struct<added: array<string>, modified: array<string>, removed: array<string>>>"
    parsed = payloads.select("id", F.from_json("payload", schema).alias("p"))
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    files = F.flatten(F.transform(F.col("p.commits"), lambda c: F.concat(empty(c["added"]), empty(c["modified"]), empty(c["removed"]))))
    return parsed.select("id", F.posexplode(files).alias("position", "file"))


def maintain(df: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Feed each micro-batch to `apply` (an upsert, an invalidation), exactly once for each batch id, over what is there."""
    df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_into(path: str, keys: list[str], order: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a Parquet table of the latest row of each key by `order` (rows equal in it: the largest), also
    where a batch has a key several times or brings an older row than the table has. Rows are dealt into buckets of their keys; a batch
    writes new versions of the buckets that it touches alone, and one that is run again changes nothing. `current` reads the table,
    `buckets.purge` deletes what was replaced."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        if B.has(spark, path, batch_id):
            return
        order_by = [F.desc(c) for c in (*order, *[c for c in columns if c not in keys and c not in order])]
        bucketed = lambda rows: rows.select(*columns, B.bucket_of(*keys, buckets=buckets).alias("bucket"))
        now = written(latest(bucketed(batch), ["bucket", *keys], order_by), "batch")
        touched = [r[0] for r in now.select("bucket").distinct().collect()]
        before = bucketed(B.read(spark, path, batch.schema, batch_id - 1, touched))
        B.replace(latest(before.unionByName(now), ["bucket", *keys], order_by), path, batch_id, touched)
        drop(now)

    return apply


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table kept by upsert_into, of the newest batch or one before; None where there is none yet. Only the folders that the version
    names are opened."""
    known = [f"{path}/{folder}/bucket={k}" for k, folder in B.folders(spark, path, version).items()]
    return spark.read.parquet(*known) if known else None


def name_status(diff: DataFrame) -> DataFrame:
    """Lines of a name-status listing (id, line): id, change, path, old_path."""
    p = F.split("line", "\t")
    code = F.substring(p[0], 1, 1)
    change = F.when(code == "A", "added").when(code == "M", "modified").when(code == "D", "deleted").when(code == "R", "renamed").when(code == "C", "copied").otherwise("unknown")
    moved = code.isin("R", "C")
    return diff.select("id", change.alias("change"), F.when(moved, F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(1))).alias("path"), F.when(moved, F.get(p, F.lit(1))).alias("old_path"))


def short_status(status: DataFrame) -> DataFrame:
    """Porcelain status lines (id, line): id, kind (staged, unstaged, untracked, conflict), path."""
    x, y = F.substring("line", 1, 1), F.substring("line", 2, 1)
    both = F.substring("line", 1, 2)
    kind = F.when(both == "??", "untracked").when(both.isin("UU", "AA", "DD", "AU", "UA", "DU", "UD"), "conflict").when(x != " ", "staged").when(y != " ", "unstaged")
    return status.select("id", kind.alias("kind"), F.expr("substring(line, 4)").alias("path"))


def diff_stats(stats: DataFrame) -> DataFrame:
    """numstat lines (id, line): id, path, added, removed; '-' counts as 0."""
    p = F.split("line", "\t")
    number = lambda c: F.coalesce(F.try_to_number(c, F.lit("999999999")).cast("int"), F.lit(0))
    return stats.select("id", p[2].alias("path"), number(p[0]).alias("added"), number(p[1]).alias("removed"))
