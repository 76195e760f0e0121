"""Tables kept in buckets of their keys, in versions: a batch replaces the buckets that it touches and no others.

A version is a manifest that says in which folder each bucket lies. Readers open the folders it names and no older ones; a batch that is
run again finds its version in place and does nothing; folders of attempts that died are named by none. `purge` deletes what no
kept version names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.sources.staging import children, delete, exists, put

BUCKETS = 64


def bucket_of(*keys: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name[:-5]) for name, _ in children(spark, f"{path}/versions") if name.endswith(".json"))


def folders(spark: SparkSession, path: str, version: int | None = None) -> dict[int, str]:
    """Where each bucket lies in the newest version, at most `version` if that is given."""
    known = [v for v in versions(spark, path) if version is None or v <= version]
    if not known:
        return {}
    return {int(k): v for k, v in json.loads(spark.read.text(f"{path}/versions/{known[-1]}.json").first()[0])["buckets"].items()}


def read(spark: SparkSession, path: str, schema, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets; none where there is no version."""
    known = folders(spark, path, version)
    paths = [f"{path}/{folder}/bucket={k}" for k, folder in known.items() if only is None or k in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def has(spark: SparkSession, path: str, version: int) -> bool:
    return exists(spark, f"{path}/versions/{version}.json")


def replace(rows: DataFrame, path: str, version: int, touched: list[int]) -> None:
    """Write `rows` (with their `bucket`) as the new content of the touched buckets; one without rows is empty from then on."""
    spark = rows.sparkSession
    folder = f"data/{version}-{uuid.uuid4().hex}"
    rows.write.partitionBy("bucket").parquet(f"{path}/{folder}")
    full = {name.removeprefix("bucket=") for name, _ in children(spark, f"{path}/{folder}") if name.startswith("bucket=")}
    now = {k: v for k, v in folders(spark, path, version).items() if k not in touched} | {int(k): folder for k in full}
    put(spark, f"{path}/versions/{version}.json", json.dumps({"buckets": now}))


def purge(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete all but the newest `keep` versions, and the buckets that none of those names; how many bucket folders went."""
    known = versions(spark, path)
    used = {f"{folder}/bucket={k}" for v in known[-keep:] for k, folder in folders(spark, path, v).items()}
    for v in known[:-keep]:
        delete(spark, f"{path}/versions/{v}.json")
    gone = 0
    for name, _ in children(spark, f"{path}/data"):
        own = [f"data/{name}/{b}" for b, _ in children(spark, f"{path}/data/{name}") if b.startswith("bucket=")]
        for old in [b for b in own if b not in used]:
            delete(spark, f"{path}/{old}")
            gone += 1
        if not any(b in used for b in own):
            delete(spark, f"{path}/data/{name}")
    return gone
