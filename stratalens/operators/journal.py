"""An audit journal in files: batches that are written once, whatever is run again; rotation by size; reading that keeps bad lines apart.

A batch's lines lie in a folder of its own, and count once its commit, a small file put in place last, names the folder. So a batch
that is run again writes a new folder and the commit says which one is true; files of attempts that died are never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.sources.staging import children, delete, exists, put

#: Bytes of a journal after which the oldest batches go; as many times as that are kept behind it (fixed values: 10 MB, five old logs).
ROTATE_BYTES, KEPT_LOGS = 10_000_000, 5
#: Times keep their microseconds.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The committed batches in order: batch, folder, bytes."""
    names = [name for name, _ in children(spark, f"{path}/commits") if name.endswith(".json")]
    if not names:
        return []
    return sorted((json.loads(r[0]) for r in spark.read.text(f"{path}/commits/*.json").collect()), key=lambda c: c["batch"])


def append(rows: DataFrame, path: str, batch: int) -> bool:
    """Append rows as JSON lines under a batch's number; False if that batch is there already, and then nothing is written."""
    spark, commit = rows.sparkSession, f"{path}/commits/{batch:020d}.json"
    if exists(spark, commit):
        return False
    folder = f"lines/{batch:020d}-{uuid.uuid4().hex}"
    rows.select(F.to_json(F.struct(*rows.columns), _TIMES | {"ignoreNullFields": "false"}).alias("value")).write.text(f"{path}/{folder}")
    size = sum(n for name, n in children(spark, f"{path}/{folder}") if name.startswith("part-"))
    put(spark, commit, json.dumps({"batch": batch, "folder": folder, "bytes": size}))
    return True


def sink(path: str):
    """A foreachBatch function that appends every micro-batch exactly once, and rotates."""

    def apply(rows: DataFrame, batch_id: int) -> None:
        if append(rows, path, batch_id):
            rotate(rows.sparkSession, path)

    return apply


def rotate(spark: SparkSession, path: str, size: int = ROTATE_BYTES, logs: int = KEPT_LOGS) -> list[int]:
    """Drop the oldest batches while the others hold `size` bytes times (1 + `logs`) without them: commits first, so readers never
    miss lines that a commit names. Files that no commit names go as well. Which batches went."""
    known = commits(spark, path)
    total, gone = sum(c["bytes"] for c in known), []
    for c in known:
        if total - c["bytes"] < size * (1 + logs):
            break
        total -= c["bytes"]
        gone.append(c)
    for c in gone:
        delete(spark, f"{path}/commits/{c['batch']:020d}.json")
        delete(spark, f"{path}/{c['folder']}")
    return [c["batch"] for c in gone]


def sweep(spark: SparkSession, path: str) -> int:
    """Delete folders that no commit names: leavings of attempts that died. Not while a batch is being appended."""
    used = {c["folder"] for c in commits(spark, path)}
    old = [name for name, _ in children(spark, f"{path}/lines") if f"lines/{name}" not in used]
    for name in old:
        delete(spark, f"{path}/lines/{name}")
    return len(old)


def read(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The committed entries, and the lines that aren't entries (batch, line). Entries have their batch as well."""
    known = commits(spark, path)
    lines = spark.read.schema("value string").text([f"{path}/{c['folder']}" for c in known]) if known else spark.createDataFrame([], "value string")
    batch = F.regexp_extract(F.input_file_name(), r"/lines/(\d+)-[0-9a-f]+/", 1).cast("long") if known else F.lit(None).cast("long")
    parsed = lines.filter(F.length(F.trim("value")) > 0).select(batch.alias("batch"), "value", F.from_json("value", f"{schema}, __bad string", _TIMES | {"columnNameOfCorruptRecord": "__bad"}).alias("e"))
    bad = F.col("e").isNull() | F.col("e.__bad").isNotNull()
    good = parsed.filter(~bad).select("batch", "e.*").drop("__bad")
    return good, parsed.filter(bad).select("batch", F.col("value").alias("line"))
