"""Written steps of iterative operators: lineage ends at files in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder of spark.checkpoint.dir. Where that is unset, a local one is set for the session if the executors run
    in the driver's process; on a cluster (also one on this machine) they may not see it, and that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stratalens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` written as Parquet and read back; `drop` deletes it."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def parted(df: DataFrame, tag: str, condition: str) -> tuple[DataFrame, DataFrame]:
    """`df` written once in two parts: rows that meet the condition, and all others (also where it is null)."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, tag)
    df.withColumn("__part", F.coalesce(F.expr(condition), F.lit(False))).write.partitionBy("__part").parquet(path)
    out = []
    for value in ("true", "false"):
        part = f"{path}/__part={value}"
        rows = spark.read.schema(df.schema).parquet(part) if exists(spark, part) else spark.createDataFrame([], df.schema)
        rows.written_at = part
        out.append(rows)
    return out[0], out[1]


def drop(*tables: DataFrame | None) -> None:
    """Delete written steps that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "written_at", None):
            delete(df.sparkSession, path)
            df.written_at = None


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    store, where = _at(spark, path)
    store.delete(where, True)


def children(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names below a folder with their bytes (a folder's files together), in order; none where there is no such folder."""
    store, where = _at(spark, path)
    if not store.exists(where):
        return []
    return sorted((s.getPath().getName(), store.getContentSummary(s.getPath()).getLength()) for s in store.listStatus(where))


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete at once: written beside its place and renamed; one that is there is replaced."""
    store, where = _at(spark, path)
    beside = where.suffix(f".{uuid.uuid4().hex}.part")
    out = store.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if store.exists(where):
        store.delete(where, False)
    if not store.rename(beside, where):
        raise OSError(f"can't write {path}")
