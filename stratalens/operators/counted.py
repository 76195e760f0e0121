"""Knowledge-graph edges under change: derivation counts, kept by the changes alone.

Questions refer to symbols, symbols are defined in files; a question depends on a file once for every way from it to the file. All three
tables keep how often a row holds. A batch of changes (+1 or more for what is added, -1 or less for what is taken back) changes the
first two, and the edges by what follows from it: changes of references with the definitions as they were, and the references as they
are then with changes of definitions. An edge goes when its last derivation does; nothing else is derived again.

Counts may pass below zero where what is taken back comes before what was added; such rows wait and are no edges. Pairs are counted
on both sides before they meet, so a symbol costs its different questions and files, not its occurrences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.sources import buckets as B
from stratalens.sources.staging import drop, written

TABLES = {"refs": ("qa", "symbol"), "definitions": ("symbol", "file"), "edges": ("qa", "file")}
#: Both base tables lie in buckets of the symbol, on which they are joined.
_BUCKET = {"refs": ("symbol",), "definitions": ("symbol",), "edges": ("qa", "file")}


def _schema(rows: DataFrame, table: str) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join([*[f"{c} {kinds[c]}" for c in TABLES[table]], "n bigint"])


def summed(rows: DataFrame, table: str, change: str = "change") -> DataFrame:
    """The changes of a table's rows that don't cancel out; rows with a null in them are no facts."""
    keys = TABLES[table]
    facts = rows.filter(" and ".join(f"{c} is not null" for c in keys))
    return facts.groupBy(*keys).agg(F.sum(change).cast("bigint").alias("n")).filter("n <> 0")


def counts(spark: SparkSession, path: str, table: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a table that hold, with their counts."""
    return B.read(spark, f"{path}/{table}", schema, version).filter("n > 0")


def _touched(delta: DataFrame) -> list[int]:
    """At most B.BUCKETS numbers."""
    return [r[0] for r in delta.select("bucket").distinct().collect()]


def _add(path: str, table: str, delta: DataFrame, schema: str, version: int) -> None:
    own, spark, keys = f"{path}/{table}", delta.sparkSession, TABLES[table]
    if B.has(spark, own, version):
        return
    touched = _touched(delta)
    before = B.read(spark, own, schema, version - 1, touched).withColumn("bucket", B.bucket_of(*_BUCKET[table]))
    after = before.unionByName(delta).groupBy("bucket", *keys).agg(F.sum("n").alias("n")).filter("n <> 0")
    B.replace(after.select(*keys, "n", "bucket"), own, version, touched)


def apply(path: str, refs: DataFrame, definitions: DataFrame, version: int) -> None:
    """Put changes of references (qa, symbol, change) and definitions (symbol, file, change) on the tables below `path`, as `version`.
    Run again after a loss, it goes on where it was: tables that have the version stay as they are."""
    spark = refs.sparkSession
    kinds = {"refs": _schema(refs, "refs"), "definitions": _schema(definitions, "definitions")}
    edge_kinds = f"qa {dict(refs.dtypes)['qa']}, file {dict(definitions.dtypes)['file']}, n bigint"
    deltas = {}
    for name, rows in (("refs", refs), ("definitions", definitions)):
        deltas[name] = written(summed(rows, name).withColumn("bucket", B.bucket_of("symbol")), f"{name}-changes")
        _add(path, name, deltas[name], kinds[name], version)
    old = B.read(spark, f"{path}/definitions", kinds["definitions"], version - 1, _touched(deltas["refs"]))
    new = B.read(spark, f"{path}/refs", kinds["refs"], version, _touched(deltas["definitions"]))
    ways = lambda a, b: a.select("qa", "symbol", F.col("n").alias("a")).join(b.select("symbol", "file", F.col("n").alias("b")), "symbol").select("qa", "file", (F.col("a") * F.col("b")).alias("n"))
    both = ways(deltas["refs"], old).unionByName(ways(new, deltas["definitions"]))
    change = both.groupBy("qa", "file").agg(F.sum("n").cast("bigint").alias("n")).filter("n <> 0").withColumn("bucket", B.bucket_of("qa", "file"))
    change = written(change, "edge-changes")
    _add(path, "edges", change, edge_kinds, version)
    drop(change, *deltas.values())


def came_and_went(spark: SparkSession, path: str, schema: str, version: int) -> DataFrame:
    """Edges that a version brought or took away: qa, file, change (appeared or vanished). Only buckets that it replaced are read."""
    now, before = (B.folders(spark, f"{path}/edges", v) for v in (version, version - 1))
    moved = [k for k in now.keys() | before.keys() if now.get(k) != before.get(k)]
    a, b = (B.read(spark, f"{path}/edges", schema, v, moved).filter("n > 0").select("qa", "file", F.lit(True).alias(c)) for v, c in ((version, "now"), (version - 1, "before")))
    both = a.join(b, ["qa", "file"], "full_outer").filter("now is null or before is null")
    return both.select("qa", "file", F.when(F.col("now"), "appeared").otherwise("vanished").alias("change"))
