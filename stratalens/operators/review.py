"""Reviews of changes and functions, native interfaces, documents' sections, signatures."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import text as T
from stratalens.operators import code as K
from stratalens.sources.files import any_of, base_name
from stratalens.sources.tables import lines

#: Words of paths that a summary of a request treats as sensitive: our own choice. validation.file_checks has the fixed rules.
SENSITIVE_WORDS = ["password", "secret", "key", "token", "credential", "auth"]


def function_report(files: DataFrame) -> DataFrame:
    """Functions with their body's lines, parameters, cyclomatic count and advice: path, name, n_lines, n_params, cyclomatic, advice."""
    known = K.functions(files)
    each = lines(K.with_language(files), "path", "content")
    body = known.join(each.withColumnRenamed("line", "at"), "path").filter((F.col("at") >= F.col("line")) & (F.col("at") <= F.col("end_line")))
    by = body.groupBy("path", "name", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]), "\n").alias("body"), F.count(F.lit(1)).alias("n_lines"))
    params = F.regexp_extract("body", r"\(([^)]*)\)", 1)
    n_params = F.when(F.trim(params) == "", 0).otherwise(F.size(F.split(params, ",")))
    cyclomatic = 1 + F.regexp_count("body", F.lit(r"\b(?:if|elif|for|while|case|catch|and|or)\b|&&|\|\|"))
    out = by.select("path", "name", "n_lines", n_params.alias("n_params"), cyclomatic.alias("cyclomatic"))
    advice = F.array(F.when(F.col("cyclomatic") > 25, F.lit("split")), F.when((F.col("cyclomatic") > 15) & (F.col("cyclomatic") <= 25), F.lit("simplify")), F.when(F.col("n_lines") > 100, F.lit("shorten")), F.when(F.col("n_params") > 6, F.lit("group parameters")))
    return out.withColumn("advice", F.filter(advice, lambda x: x.isNotNull()))


def comments_above(files: DataFrame) -> DataFrame:
    """The line above each function if it is a comment, marks off: path, name, comment."""
    w = Window.partitionBy("path").orderBy("line")
    each = lines(K.with_language(files), "path", "content").withColumn("above", F.lag("content").over(w))
    found = K.functions(files).join(each, ["path", "line"]).filter(F.col("above").rlike(r"^\s*(#|//|\*|/\*)"))
    return found.select("path", "name", F.trim(F.regexp_replace("above", r"^\s*(#|//|/?\*+)|\*/\s*$", "")).alias("comment"))


def review(changed: DataFrame) -> DataFrame:
    """Findings of changed files (pr, path, content): sensitive path, size above 100 KB, blank in the name, tasks, printing."""
    rules = F.array(
        F.when(any_of(F.col("path"), SENSITIVE_WORDS), F.struct(F.lit("sensitive path").alias("finding"), F.lit("high").alias("severity"))),
        F.when(F.length("content") > 100 * 1024, F.struct(F.lit("large file").alias("finding"), F.lit("medium").alias("severity"))),
        F.when(F.contains(base_name(), F.lit(" ")), F.struct(F.lit("blank in name").alias("finding"), F.lit("low").alias("severity"))),
        F.when(F.col("content").rlike("TODO|FIXME"), F.struct(F.lit("open task").alias("finding"), F.lit("low").alias("severity"))),
        F.when(F.col("content").rlike(r"\b(?:print|console\.log|System\.out\.println)\s*\("), F.struct(F.lit("printing").alias("finding"), F.lit("low").alias("severity"))),
    )
    return changed.select("pr", "path", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("f")).select("pr", "path", "f.*")


def summaries(findings: DataFrame, requests: DataFrame) -> DataFrame:
    """Verdict of each request (pr): critical, needs work, minor or clean, by its worst finding."""
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    worst = findings.groupBy("pr").agg(F.max(rank).alias("worst"), F.count(F.lit(1)).alias("n"))
    verdict = F.when(F.col("worst") == 3, "critical").when(F.col("worst") == 2, "needs work").when(F.col("worst") == 1, "minor").otherwise("clean")
    return requests.select("pr").distinct().join(worst, "pr", "left").select("pr", verdict.alias("verdict"), F.coalesce("n", F.lit(0)).alias("n"))


def native_functions(files: DataFrame) -> DataFrame:
    """JNI exports: path, class, method."""
    pattern = r"JNICALL\s+Java_(\w+)_(\w+)\s*\("
    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("class"), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)).alias("method"))
    return files.select("path", F.explode(both).alias("z")).select("path", "z.*")


def section(text: Column, title: str) -> Column:
    """The body of a markdown section of level two."""
    return F.trim(F.regexp_extract(text, rf"(?s)(?:^|\n)## {title}\n(.*?)(?:\n## |$)", 1))


def table_rows(files: DataFrame) -> DataFrame:
    """Cells of markdown tables: path, line, cells."""
    each = lines(files, "path", "content").filter(F.col("content").rlike(r"^\|.*\|\s*$") & ~F.col("content").rlike(r"^\|[\s:|-]+\|\s*$"))
    return each.select("path", "line", F.transform(F.split(F.regexp_replace(F.trim("content"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)).alias("cells"))


def parameters(signature: Column) -> Column:
    """Names of a parameter list: last word of each part, defaults and types off."""
    parts = F.filter(F.split(signature, ","), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.regexp_extract(F.trim(F.regexp_replace(x, r"\s*[=:].*$", "")), r"(\w+)$", 1))


def verified(payloads: DataFrame, secret: str) -> DataFrame:
    """Webhook payloads (id, payload, signature 'sha256=...') whose HMAC is right: id, valid. Without a secret all are."""

    @F.pandas_udf("boolean")
    def check(payload: pd.Series, signature: pd.Series) -> pd.Series:
        if not secret:
            return pd.Series([True] * len(payload))
        right = [hmac.new(secret.encode(), (p or "").encode(), hashlib.sha256).hexdigest() for p in payload]
        return pd.Series([hmac.compare_digest(f"sha256={r}", s or "") for r, s in zip(right, signature, strict=True)])

    return payloads.select("id", check("payload", "signature").alias("valid"))


def hits(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """Cache hits of questions (ask_id, ask): exact by key, else none; with the entry's new count of accesses."""
    by = asked.withColumn("cache_key", T.cache_key(F.col("ask"))).join(cache.select("cache_key", "access_count"), "cache_key")
    return by.groupBy("cache_key").agg((F.first("access_count") + F.count(F.lit(1))).alias("access_count"))
