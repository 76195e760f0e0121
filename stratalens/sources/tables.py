"""Scans: Parquet tables and the record views that operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each line: key, line (from 1), content."""
    return docs.select(key, *keep, F.posexplode(F.split(text, "\n", -1)).alias("p", "content")).select(key, *keep, (F.col("p") + 1).alias("line"), "content")


def qa_pairs(conversations: DataFrame) -> DataFrame:
    """User turns with the assistant turn that follows: qa_id, conv_id, turn, question, answer."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    paired = conversations.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return paired.filter("role = 'user' and next_role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qa_id"), "conv_id", "turn", F.col("text").alias("question"), "answer")


QA_PAIRS_SQL = """(SELECT conv_id * 1000 + turn AS qa_id, conv_id, turn, text AS question, answer FROM (
  SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations)
  WHERE role = 'user' AND next_role = 'assistant')"""


def audit(events: DataFrame) -> DataFrame:
    """Events as an audit log: ts, user_id, operation, level, success, ref (the k of props), value."""
    ref = F.get_json_object("props", "$.k").cast("int")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARNING").otherwise("INFO")
    return events.select("event_id", "ts", "user_id", F.col("event_type").alias("operation"), level.alias("level"), (F.col("event_type") != "error").alias("success"), ref.alias("ref"), "value")


AUDIT_SQL = """(SELECT event_id, ts, user_id, event_type AS operation,
  CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' THEN 'WARNING' ELSE 'INFO' END AS level,
  event_type <> 'error' AS success, CAST(json_extract_string(props, '$.k') AS INTEGER) AS ref, value FROM events)"""
