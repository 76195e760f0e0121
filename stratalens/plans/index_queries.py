"""The exact vector index, and knowledge-graph edges kept by changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import counted as K
from stratalens.operators import vectors as V
from stratalens.plans.search_queries import _queries, _top
from stratalens.registry import query
from stratalens.sources.staging import shared_folder
from stratalens.sources.tables import table


@query(_top(""))
def q_vector_index_topk(spark, sf_dir):
    """The ten nearest vectors of every hundredth one, through the index."""
    vectors = table(spark, sf_dir, "embeddings")
    return V.search(V.build(vectors), _queries(vectors))[0].withColumnRenamed("id", "vec_id")


@query("SELECT vec_id AS query_id, true AS exact, true AS spared FROM embeddings WHERE vec_id % 100 = 0")
def q_vector_index_reads(spark, sf_dir):
    """Of each query, whether its ten were among what was compared, and whether the bounds spared some vectors the comparison."""
    vectors = table(spark, sf_dir, "embeddings")
    total = vectors.count()
    read = V.search(V.build(vectors), _queries(vectors))[1]
    return read.select("query_id", (F.col("compared") >= min(10, total)).alias("exact"), (F.col("compared") < total).alias("spared"))


#: Users refer to the k of what they view or click; sign-ups define a k in the file that their value names.
_REFS = "(SELECT user_id AS qa, CAST(json_extract_string(props, '$.k') AS INTEGER) AS symbol, ts, value FROM events WHERE event_type IN ('view', 'click'))"
_DEFS = "(SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS symbol, CAST(floor(value / 10) AS INTEGER) AS file, ts, value FROM events WHERE event_type = 'signup')"
_HALF, _TAKEN = "2024-01-16", 30
_KINDS = "qa bigint, file int, n bigint"


def _edges(spark, sf_dir) -> str:
    """Three batches: the first half of the month, the second, and all of small value taken back."""
    events = table(spark, sf_dir, "events").withColumn("symbol", F.get_json_object("props", "$.k").cast("int"))
    refs = events.filter("event_type in ('view', 'click')").select(F.col("user_id").alias("qa"), "symbol", "ts", "value")
    defs = events.filter("event_type = 'signup'").select("symbol", F.floor(F.col("value") / 10).cast("int").alias("file"), "ts", "value")
    path = shared_folder(spark, "edges")
    for version, (where, change) in enumerate(((f"ts < '{_HALF}'", 1), (f"ts >= '{_HALF}'", 1), (f"value < {_TAKEN}", -1))):
        pick = lambda rows: rows.filter(where).drop("ts", "value").withColumn("change", F.lit(change))  # noqa: B023, E731
        K.apply(path, pick(refs), pick(defs), version)
    return path


@query(f"SELECT qa, file, count(*) AS n FROM {_REFS} a JOIN {_DEFS} b USING (symbol) WHERE a.value >= {_TAKEN} AND b.value >= {_TAKEN} GROUP BY ALL")
def q_counted_edges(spark, sf_dir):
    """Edges with their derivations after three batches with retractions."""
    return K.counts(spark, _edges(spark, sf_dir), "edges", _KINDS)


@query(
    f"""WITH a AS (SELECT DISTINCT qa, file FROM {_REFS} a JOIN {_DEFS} b USING (symbol)), b AS (SELECT DISTINCT qa, file FROM {_REFS} a JOIN {_DEFS} b USING (symbol) WHERE a.value >= {_TAKEN} AND b.value >= {_TAKEN})
SELECT qa, file, 'vanished' AS change FROM a ANTI JOIN b USING (qa, file)"""
)
def q_vanished_edges(spark, sf_dir):
    """Edges that lost their last derivation in the third batch."""
    return K.came_and_went(spark, _edges(spark, sf_dir), _KINDS, 2)
