"""Checks of generated documents and of changed files, summaries of risks, sizes of indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sections and fields that a project document must have, and names under which it must not be stored.
SECTIONS = ["基本信息", "目录结构", "模块划分", "入口点", "构建指南", "配置文件"]
FIELDS = ["项目名称", "项目类型", "主要语言"]
WRONG_NAMES = ["PROJECT.md", "project.md", "README_PROJECT.md"]
# Parts of sensitive paths in the order in which they are tried, patterns of passwords and keys in contents, and limits.
SENSITIVE_PARTS = [".env", "secret", "credential", "password", "key", "token"]
PASSWORD = r"""(?i)(?:password|passwd|pwd)[ \t\n\x0B\f\r]*[=:][ \t\n\x0B\f\r]*["']?[^"']{4,}"""
API_KEY = r"""(?i)(?:api[_-]?key|apikey)[ \t\n\x0B\f\r]*[=:][ \t\n\x0B\f\r]*["']?[a-zA-Z0-9]{20,}"""
LARGE_BYTES, DEEP = 100 * 1024, 5
# Lines of a file by default, bytes of a line, and the share that an index takes of them.
AVERAGE_LINES, LINE_BYTES, INDEX_SHARE = 200, 100, 0.3


def validated(documents: DataFrame) -> DataFrame:
    """Project documents (key, content; null where the file is missing; misplaced: names of documents in wrong places) with what a check
    finds: valid, errors, warnings, passed (how many checks). A missing document has no other check than its place."""
    text = F.col("content")
    there = text.isNotNull()
    section = lambda s: F.contains(text, F.lit(f"## {s}")) | F.contains(text, F.lit(f"# {s}"))
    tabled = F.contains(text, F.lit("|")) & F.contains(text, F.lit("---"))
    lists = lambda each: F.filter(F.array(*each), lambda x: x.isNotNull())
    wrong = F.transform(F.filter(F.array(*[F.lit(n) for n in WRONG_NAMES]), lambda n: F.array_contains(F.coalesce("misplaced", F.array().cast("array<string>")), n)), lambda n: F.concat(F.lit("misplaced: "), n))
    errors = F.concat(wrong, lists([F.when(~there, "missing"), *[F.when(there & ~section(s), f"section: {s}") for s in SECTIONS], F.when(there & ~tabled, "table")]))
    warnings = lists([F.when(there & ~F.contains(text, F.lit(f)), f"field: {f}") for f in FIELDS])
    passed = F.lit(1) + there.cast("int") + F.coalesce(sum([(there & section(s)).cast("int") for s in SECTIONS], (there & tabled).cast("int")), F.lit(0))
    return documents.select("key", (F.size(errors) == 0).alias("valid"), errors.alias("errors"), warnings.alias("warnings"), passed.alias("passed"))


def _matches(pattern: str, message: str) -> Column:
    """An error for each match of a pattern, with the line on which it starts: line breaks of what lies between and within the matches
    before it are added up."""
    between, within = F.split("content", pattern, -1), F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    line = lambda i: F.lit(1) + F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda s, x: s + breaks(x)) + F.aggregate(F.slice(within, 1, i), F.lit(0), lambda s, x: s + breaks(x))
    return F.transform(within, lambda _, i: _finding(line(i), "error", "security", message))


def _finding(line, severity: str, category: str, message: str) -> Column:
    line = line if isinstance(line, Column) else F.lit(line)
    return F.struct(line.cast("int").alias("line"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(message).alias("message"))


def file_checks(changed: DataFrame) -> DataFrame:
    """Suggestions for changed files (path, content): path, line (0: the file), severity, category, message. Of the sensitive parts of a path
    the first counts; a null content has its path checked alone."""
    low = F.lower("path")
    part = F.coalesce(*[F.when(F.contains(low, F.lit(p)), p) for p in SENSITIVE_PARTS])
    braces = F.split(F.regexp_replace("content", r"[^{}]", ""), "")
    step = lambda s, c: F.struct(F.greatest(F.lit(0), s["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("now"), F.greatest(s["top"], s["now"] + F.when(c == "{", 1).otherwise(0)).alias("top"))
    deepest = F.aggregate(braces, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda s: s["top"])
    none = F.array().cast("array<struct<line:int,severity:string,category:string,message:string>>")
    with_message = lambda m: F.array(F.struct(F.lit(0).alias("line"), F.lit("warning").alias("severity"), F.lit("security").alias("category"), m.alias("message")))
    found = F.concat(
        F.when(part.isNotNull(), with_message(F.concat(F.lit("sensitive path: "), part))).otherwise(none),
        F.coalesce(_matches(PASSWORD, "password in the content"), none),
        F.coalesce(_matches(API_KEY, "API key in the content"), none),
        F.when(F.octet_length("content") > LARGE_BYTES, F.array(_finding(0, "info", "performance", "large file"))).otherwise(none),
        F.when(deepest > DEEP, F.array(_finding(0, "warning", "performance", "deep nesting"))).otherwise(none),
        F.when(F.contains("path", F.lit(" ")), F.array(_finding(0, "info", "style", "blank in the name"))).otherwise(none),
    )
    return changed.select("path", F.explode(found).alias("f")).select("path", "f.*")


def risk_summary(risks: DataFrame) -> DataFrame:
    """One row of a project's risks (level, score, coverage): files, how many of each level that occurs (as text), high (high or
    critical), the mean score, and advice: refactoring where more than a fifth are high, tests where more than half lack over 0.8 of
    their coverage."""
    bare = F.when(1 - F.col("coverage") > 0.8, 1).otherwise(0)
    by = risks.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"), F.sum(bare).alias("bare"))  # a row a level
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    high = F.when(F.col("level").isin("high", "critical"), F.col("n")).otherwise(0)
    rows = by.agg(total("n").alias("files"), F.sort_array(F.collect_list(F.concat_ws(": ", "level", F.col("n").cast("string")))).alias("levels"), total(high).alias("high"), total("bare").alias("bare"), F.coalesce(F.sum("score") / F.sum("n"), F.lit(0.0)).alias("mean_score"))
    advice = F.array(F.when(F.col("high") > F.col("files") * 0.2, "refactor: over 20 % of files are of high risk"), F.when(F.col("bare") > F.col("files") * 0.5, "test: over 50 % of files lack coverage"))
    return rows.select("files", "levels", "high", "mean_score", F.filter(advice, lambda x: x.isNotNull()).alias("advice"))


def index_size(files: Column, lines: Column | None = None) -> Column:
    """Estimated bytes of an index over so many files, of so many lines each."""
    return (files * (F.lit(AVERAGE_LINES) if lines is None else lines) * LINE_BYTES * INDEX_SHARE).cast("long")
