"""Graph stores of all conversations: written, read back with defaults, and looked up from files and symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.registry import query
from stratalens.sources import stores
from stratalens.sources.staging import written
from stratalens.sources.tables import QA_PAIRS_SQL, qa_pairs, table


def _stores(spark, sf_dir):
    """A store for each conversation with questions; later turns leave fields out, every question refers to one or two files."""
    pairs = qa_pairs(table(spark, sf_dir, "conversations")).select(F.concat(F.lit("conv"), "conv_id").alias("store"), F.col("qa_id").cast("string").alias("qa_id"), "turn", "question")
    some = lambda column: F.when(F.col("turn") < 2, column)
    nodes = pairs.select("store", "qa_id", "question", some(F.lower("question")).alias("normalized_question"), some(F.lit("WHERE")).alias("intent"), F.lit(None).cast("string").alias("created_at"), F.lit(None).cast("string").alias("last_accessed"), F.col("turn").alias("access_count"), some(F.lit(0.5)).alias("confidence"))
    refs = pairs.select("store", "qa_id", F.posexplode(F.when(F.col("turn") < 2, F.array("turn", F.col("turn") + 10)).otherwise(F.array("turn"))).alias("position", "n"))
    code = refs.select("store", "qa_id", "position", F.concat(F.lit("src/f"), "n", F.lit(".py")).alias("file_path"), F.col("n").alias("line_start"), F.lit(None).cast("long").alias("line_end"), F.when(F.col("position") == 0, F.concat(F.lit("s"), "n")).alias("symbol"), F.lit(None).cast("double").alias("relevance"))
    times = refs.select("store", F.concat(F.lit("src/f"), "n", F.lit(".py")).alias("file_path"), F.col("n").cast("double").alias("mtime")).distinct()
    broken = spark.createDataFrame([("broken", "{not json"), ("none", None), ("empty", "{}")], "store string, content string")
    return written(stores.write_graph({"qa_nodes": nodes, "code_refs": code, "file_mtimes": times}).unionByName(broken), "stores")


_P = f"(SELECT 'conv' || conv_id AS store, CAST(qa_id AS VARCHAR) AS qa_id, turn, question FROM {QA_PAIRS_SQL})"
_REFS = f"(SELECT store, qa_id, turn + 10 * k AS n, CAST(k AS INTEGER) AS position FROM {_P}, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR turn < 2)"


@query(f"SELECT store, qa_id, question, CASE WHEN turn < 2 THEN lower(question) ELSE '' END AS normalized_question, CASE WHEN turn < 2 THEN 'WHERE' ELSE '' END AS intent, '' AS created_at, '' AS last_accessed, turn AS access_count, CASE WHEN turn < 2 THEN 0.5 ELSE 1.0 END AS confidence FROM {_P}")
def q_graph_store_nodes(spark, sf_dir):
    return stores.read_graph(_stores(spark, sf_dir))["qa_nodes"]


@query(f"SELECT store, qa_id, position, 'src/f' || n || '.py' AS file_path, n AS line_start, 0 AS line_end, CASE WHEN position = 0 THEN 's' || n ELSE '' END AS symbol, 1.0 AS relevance FROM {_REFS}")
def q_graph_store_references(spark, sf_dir):
    return stores.read_graph(_stores(spark, sf_dir))["code_refs"]


@query(f"SELECT DISTINCT store, 'file' AS kind, 'src/f' || n || '.py' AS name, qa_id FROM {_REFS} UNION ALL SELECT DISTINCT store, 'symbol', 's' || n, qa_id FROM {_REFS} WHERE position = 0")
def q_graph_store_lookup(spark, sf_dir):
    """Questions of every file and symbol."""
    return stores.reverse_references(stores.read_graph(_stores(spark, sf_dir))["code_refs"])


@query(f"SELECT DISTINCT store, 'src/f' || n || '.py' AS file_path, CAST(n AS DOUBLE) AS mtime FROM {_REFS}")
def q_graph_store_times(spark, sf_dir):
    return stores.read_graph(_stores(spark, sf_dir))["file_mtimes"]
