"""The corpus pipeline: five stages from raw documents to a mix of sources.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns the columns of `documents`; the last
returns the mix. Nulls, empty texts, repeated rows, empty tables and further columns go through every stage as the operators'
docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.decontaminate import contamination
from stratalens.llm.langid import fit, training_rows, with_language
from stratalens.llm.lines import dedup_lines
from stratalens.llm.mixing import mix
from stratalens.llm.neardup import near_duplicates
from stratalens.llm.storage import table, written

#: A document stays if one language has at least this share of its text.
LEAST_SHARE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language (null, empty, no letters) and texts of which no language has half."""
    found = with_language(docs, fit(training_rows(docs)), "__language")
    kept = found.filter((F.col("__language.lang_pred") != "und") & (F.col("__language.score") >= LEAST_SHARE))
    return kept.select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; a document of which no word is left goes. n_chars follows the text."""
    found = dedup_lines(docs, into="__lines")
    gone = (F.col("__lines.n_removed") > 0) & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    length = F.length("text").cast("long")
    return found.filter(~gone).select(*[F.when(F.col("__lines.n_removed") > 0, length).otherwise(F.col(c)).alias(c) if c == "n_chars" else c for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least id (five-word shingles, similarity 0.8). Rows that
    share an id are told apart by their texts; of rows equal in both one stays."""
    known = docs.filter("doc_id is not null").withColumn("__hash", F.xxhash64("doc_id", "text"))
    ids = known.groupBy(F.col("doc_id").alias("__twice")).agg(F.min("__hash").alias("low"), F.max("__hash").alias("high"))
    twice = written(ids.filter("low < high").select("__twice"), "twice")
    own = F.when(F.col("__twice").isNull(), F.col("doc_id").cast("long")).otherwise(F.col("__hash"))
    keyed = known.join(twice, F.col("doc_id") == F.col("__twice"), "left").withColumn("__key", own)
    near = near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), width=5)
    groups = keyed.select("__key", "doc_id").distinct().join(near.select(F.col("doc_id").alias("__key"), "component_id").distinct(), "__key")
    stays = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "__key")).alias("first")).select(F.col("first.__key").alias("__stays"))
    known = keyed.join(stays, F.col("__key") == F.col("__stays"), "left_semi").dropDuplicates(["__key", "doc_id", "text"])
    return known.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a tenth of it in edits, go."""
    return contamination(docs, table(spark, sf_dir, "benchmark"), into="__items").filter(F.size("__items") == 0).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document that is left."""
    return mix(docs)[0]


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]

#: Learned models, sketches and edit distances have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
