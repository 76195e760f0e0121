"""A watched file tree as a stream: a data source whose offsets are listings.

Each offset is a snapshot of the tree, kept as a small file beside the stream's progress, so a batch that is run again finds the same two
listings and gives the same changes. Listings hold names, sizes and times; contents are read where partitions are read, for digests of
new and modified files. `keep_up` follows a stream with a table of all files, and finds what was moved: a new file with the digest of
one that went in the same batch.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from stratalens.sources.files import EXCLUDED_FOLDERS

SCHEMA = "snapshot long, change string, path string, size long, modified long, digest string"
#: Changes in one partition.
PART = 1_000


@dataclass
class _Changes(InputPartition):
    root: str
    snapshot: int
    rows: list


def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def listing(root: str) -> dict[str, tuple[int, int]]:
    """Size and time (microseconds) of every file below a folder, by its relative path; excluded folders and hidden files are left out."""
    from pyarrow.fs import FileSelector, FileType

    store, base = _store(root)
    found = {}
    for info in store.get_file_info(FileSelector(base, allow_not_found=True, recursive=True)):
        path = info.path[len(base) :].lstrip("/")
        parts = path.split("/")
        if info.type == FileType.File and not parts[-1].startswith((".", "_")) and not set(parts) & set(EXCLUDED_FOLDERS):
            found[path] = (info.size, (info.mtime_ns or 0) // 1_000)
    return found


def changes(before: dict, after: dict) -> list[tuple]:
    """(change, path, size, modified) between two listings, by path; of what went the size and time it had."""
    out = [("deleted", p, *before[p]) for p in before.keys() - after.keys()]
    out += [("created" if p not in before else "modified", p, *after[p]) for p in after if before.get(p) != after[p]]
    return sorted(out, key=lambda r: (r[1], r[0]))


class _TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self._root, self._kept = options["path"], options["snapshots"]

    def _load(self, number: int) -> dict:
        if number <= 0:
            return {}
        store, base = _store(self._kept)
        with store.open_input_stream(f"{base}/{number}.json") as file:
            return {p: tuple(v) for p, v in json.loads(file.read()).items()}

    def _newest(self) -> int:
        from pyarrow.fs import FileSelector

        store, base = _store(self._kept)
        names = [i.base_name for i in store.get_file_info(FileSelector(base, allow_not_found=True))]
        return max([int(n[:-5]) for n in names if n.endswith(".json")], default=0)

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        number, now = self._newest(), listing(self._root)
        if now != self._load(number):
            number += 1
            store, base = _store(self._kept)
            store.create_dir(base)
            beside = f"{base}/{uuid.uuid4().hex}.part"
            with store.open_output_stream(beside) as file:
                file.write(json.dumps(now).encode())
            store.move(beside, f"{base}/{number}.json")
        return {"snapshot": number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = changes(self._load(start["snapshot"]), self._load(end["snapshot"]))
        return [_Changes(self._root, end["snapshot"], rows[k : k + PART]) for k in range(0, len(rows), PART)] or [_Changes(self._root, end["snapshot"], [])]

    def read(self, partition: _Changes) -> Iterator[tuple]:
        store, base = _store(partition.root)
        for change, path, size, modified in partition.rows:
            digest = None
            if change != "deleted":
                found = hashlib.md5()
                try:
                    with store.open_input_stream(f"{base}/{path}") as file:
                        while block := file.read(1 << 20):
                            found.update(block)
                    digest = found.hexdigest()
                except FileNotFoundError:  # it went after the listing; the next one says so
                    pass
            yield partition.snapshot, change, path, size, modified, digest

    def commit(self, end: dict) -> None:
        pass


class Tree(DataSource):
    """format("tree") with the options path (the folder) and snapshots (where listings are kept)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TreeReader(self.options)


def watch(spark: SparkSession, root: str, snapshots: str) -> DataFrame:
    """Changes of a tree as a stream; the first batch has all that is there as created."""
    spark.dataSource.register(Tree)
    return spark.readStream.format("tree").option("path", root).option("snapshots", snapshots).load()


def moved(batch: DataFrame, known: DataFrame) -> DataFrame:
    """The changes of a batch, where `known` (path, digest) is what was there before: change, path, old_path. Created files with the digest of
    deleted ones are moves, paired in the order of their paths; what is left over stays created or deleted."""
    numbered = lambda rows: rows.withColumn("__k", F.row_number().over(Window.partitionBy("digest").orderBy("path")))
    new = numbered(batch.filter("change = 'created'").select("path", "digest"))
    old = numbered(batch.filter("change = 'deleted'").select("path").join(known.select("path", "digest"), "path", "left").select("path", "digest"))
    pairs = new.filter("digest is not null").join(old.withColumnRenamed("path", "old_path"), ["digest", "__k"]).select("path", "old_path")
    none = F.lit(None).cast("string").alias("old_path")
    rest = batch.filter("change = 'created'").join(pairs, "path", "left_anti").unionByName(batch.filter("change = 'deleted'").join(pairs.select(F.col("old_path").alias("path")), "path", "left_anti"))
    plain = rest.unionByName(batch.filter("change = 'modified'")).select("change", "path", none)
    return pairs.select(F.lit("moved").alias("change"), "path", "old_path").unionByName(plain)


def keep_up(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps all files of a tree (`files`: path, digest, gone) and the changes of every batch (`changes`) below
    `path`; a batch that is run again writes the same."""
    from stratalens.streaming.changes import current, upsert_into

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = current(spark, f"{path}/files", batch_id - 1)
        known = spark.createDataFrame([], "path string, digest string, gone boolean") if known is None else known
        moved(batch, known.filter("not gone")).write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
        now = batch.select("path", "snapshot", "digest", (F.col("change") == "deleted").alias("gone"))
        upsert_into(f"{path}/files", ["path"], ["snapshot"])(now, batch_id)

    return apply
