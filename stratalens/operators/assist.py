"""Assistance: team search, completions, reviews, recommendations for a file, eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators.blocking import containing, sums_before


def team_search(entries: DataFrame, query: str, k: int = 20) -> DataFrame:
    """10 for the query in the question, 5 in the answer, 8 for an equal tag (tags as they are): id, score."""
    low = F.lit(query.lower())
    score = F.when(F.contains(F.lower("question"), low), 10).otherwise(0) + F.when(F.contains(F.lower("answer"), low), 5).otherwise(0) + F.when(F.array_contains("tags", query.lower()), 8).otherwise(0)
    return entries.select("id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(k)


def completions(candidates: DataFrame, k: int = 30) -> DataFrame:
    """Candidates (text, kind, score, source) once for each text and kind, the first source wins; best first."""
    w = Window.partitionBy("text", "kind").orderBy("source", F.desc("score"))
    return candidates.withColumn("r", F.row_number().over(w)).filter("r = 1").orderBy(F.desc("score"), "text", "kind").limit(k).select("text", "kind", "score")


def prefix_completions(names: DataFrame, prefix: str, k: int = 50) -> DataFrame:
    """Names (name, kind) with a prefix: 0.7 for functions, 0.65 for others."""
    return names.filter(F.col("name").startswith(prefix)).select("name", "kind", F.when(F.col("kind") == "function", 0.7).otherwise(0.65).alias("score")).orderBy(F.desc("score"), "name", "kind").limit(k)


def find_name(names: DataFrame, asked: DataFrame) -> DataFrame:
    """Names (name) for each asked one (ask): equal ones, and only without those the ones that hold it: ask, name."""
    exact = asked.join(names.select("name").distinct(), F.col("ask") == F.col("name")).select("ask", "name")
    rest = asked.join(exact.select("ask"), "ask", "left_anti")
    loose = containing(names.select("name", F.lower("name").alias("low")).distinct(), rest.select("ask", F.lower("ask").alias("part")), "low", "part").select("ask", "name")
    return exact.unionByName(loose)


def for_file(refs: DataFrame, counts: DataFrame, files: DataFrame, k: int = 5) -> DataFrame:
    """Recommendations for files (file): entries linked to the file itself (0.8 and 0.02 for each use, 0.2 at most), then those of
    files of the same stem (0.6); each entry once: file, qa_id, score."""
    stem = lambda c: F.regexp_extract(c, r"([^/.]+)[^/]*$", 1)
    direct = files.join(refs, files.file == refs.path).join(counts, "qa_id", "left").select("file", "qa_id", (0.8 + F.least(F.coalesce("n", F.lit(0)) * 0.02, F.lit(0.2))).alias("score"))
    alike = files.withColumn("s", stem("file")).join(refs.withColumn("s", stem("path")), "s").filter("file <> path").select("file", "qa_id", F.lit(0.6).alias("score"))
    by = direct.unionByName(alike).groupBy("file", "qa_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("file").orderBy(F.desc("score"), "qa_id")
    return by.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def request_warnings(requests: DataFrame) -> DataFrame:
    """Warnings of change requests (id, additions, deletions, files): id, warnings in order."""
    found = F.array(F.when(F.col("additions") + F.col("deletions") > 1000, F.lit("large change")), F.when(F.col("files") > 20, F.lit("many files")))
    return requests.select("id", F.filter(found, lambda x: x.isNotNull()).alias("warnings"))


def evict(entries: DataFrame, size: str, limit: int) -> DataFrame:
    """Entries (id, priority, last_access, size) that leave a cache of `limit` bytes: lowest priority, then oldest, first."""
    by = entries.groupBy("priority", "last_access").agg(F.sum(size).alias("bytes"))
    newer = sums_before(by, "last_access", "bytes", ["priority"], "newer")
    within = Window.partitionBy("priority", "last_access").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return entries.join(newer.select("priority", "last_access", "newer"), ["priority", "last_access"]).withColumn("kept", F.col("newer") + F.sum(size).over(within)).filter(F.col("kept") > limit).select("id", size)


def similar_queries(history: DataFrame, asked: str, k: int = 5) -> DataFrame:
    """Earlier queries (id, query, ts) whose words overlap by more than half, newest first."""
    from stratalens.functions import text as T

    j = T.jaccard(T.words(F.col("query")), T.words(F.lit(asked)))
    return history.select("id", "ts", F.round(j, 6).alias("score")).filter("score > 0.5").orderBy(F.desc("ts"), "id").limit(k)
