"""Line and text scans: secrets, tasks, smells, security rules, duplicates, quality and risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import patterns as P
from stratalens.functions import text as T
from stratalens.sources.tables import lines


def _finding(kind: str, severity: str):
    return lambda m: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), m.alias("original"))


def _matches(pattern: str):
    return lambda x: x.rlike(pattern)


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every match of every secret pattern: key, line, type, severity, original, masked.

    One pass: a document that no pattern matches isn't split into lines; null texts have no findings.
    """
    some = docs.filter(reduce(lambda a, b: a | b, [F.col(text).rlike(p) for _, _, p, _ in P.SECRETS]))
    found = F.concat(*[F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(0)), _finding(t, s)) for t, s, p, _ in P.SECRETS])
    each = lines(some, key, text).select(key, "line", F.explode(found).alias("f")).select(key, "line", "f.*")
    return each.withColumn("masked", T.mask(F.col("original")))


def secret_values(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each line and kind of secret value in it, with a redacted snippet of 50 characters."""
    kinds = F.filter(F.array(*[F.when(F.col("content").rlike(p), F.lit(t)) for t, p in P.SECRET_VALUES]), lambda x: x.isNotNull())
    snippet = F.regexp_replace(F.substring("content", 1, 50), r"[a-zA-Z0-9]{10,}", "REDACTED")
    return lines(docs, key, text).select(key, "line", F.explode(kinds).alias("type"), snippet.alias("snippet"))


def line_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines, blank lines, characters and the longest line of each text; a null text has none."""
    parts = F.split(text, "\n", -1)
    n = F.coalesce(F.size(parts), F.lit(0))
    n = F.when(F.col(text).isNull(), 0).otherwise(n)
    blank = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.filter(parts, lambda x: F.trim(x) == "")))
    longest = F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0))
    return docs.select(key, n.alias("n_lines"), blank.alias("n_blank"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"), longest.alias("longest"))


def security_issues(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Lines that break a security rule of their language: key, line, rule, severity."""
    rules = F.filter(
        F.array(*[F.when(F.col("content").rlike(p) & (F.lit(True) if langs is None else F.col(lang).isin(langs)), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, p, langs in P.SECURITY_RULES]),
        lambda x: x.isNotNull(),
    )
    return lines(docs, key, text, (lang,)).select(key, "line", F.explode(rules).alias("r")).select(key, "line", "r.*")


def smells(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Long lines, magic numbers above 10 and open tasks: key, line, smell."""
    number = F.exists(F.regexp_extract_all("content", F.lit(P.MAGIC_NUMBER), F.lit(0)), lambda m: F.try_to_number(m, F.lit("9999999999999999")) > 10)
    kinds = F.array(F.when(F.length("content") > P.LONG_LINE, F.lit("long_line")), F.when(number, F.lit("magic_number")), F.when(F.col("content").rlike(P.TASK), F.lit("todo_fixme")))
    return lines(docs, key, text).select(key, "line", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("smell"))


def todos(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Task comments: key, line, type, text, author, priority."""
    part = lambda i: F.regexp_extract("content", P.TODO_COMMENT, i)
    found = lines(docs, key, text).filter(F.col("content").rlike(P.TODO_COMMENT))
    return found.select(key, "line", part(1).alias("type"), F.trim(part(2)).alias("text"), F.nullif(F.trim(part(3)), F.lit("")).alias("author"), T.todo_priority(part(2)).alias("priority"))


def normalize_code(block: Column) -> Column:
    """White space to one blank, then comments away (so that // eats the rest of the block)."""
    return F.trim(F.regexp_replace(F.regexp_replace(block, r"[ \t\n\r\f\x0B]+", " "), r"//.*|/\*.*?\*/|#.*", ""))


def duplicate_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """Blocks of `size` lines that occur twice or more in a text, after normalisation; overlapping ones count.

    Columns: key, start_line, end_line, n. Blocks are told apart by their whole normalised text.
    """
    blocks = F.transform(F.sequence(F.lit(1), F.size("l") - (size - 1)), lambda i: F.array_join(F.slice("l", i, F.lit(size)), "\n"))
    parts = docs.select(key, F.split(text, "\n", -1).alias("l")).filter(F.size("l") >= size).select(key, F.posexplode(blocks).alias("p", "b"))
    each = parts.select(key, (F.col("p") + 1).alias("line"), normalize_code(F.col("b")).alias("b")).filter("b <> ''")
    return each.groupBy(key, "b").agg(F.min("line").alias("start_line"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, "start_line", (F.col("start_line") + size).alias("end_line"), "n")


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Complexity, readability, maintainability, security and overall score of each text, in one pass over its lines."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(key, lang, content.alias("t")).withColumn("l", F.split("t", "\n", -1))
    n = F.size("l").cast("double")
    long_lines = F.size(F.filter("l", lambda x: F.length(x) > P.LONG_LINE))
    average = F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + F.length(x)) / n
    blank = F.size(F.filter("l", lambda x: F.trim(x) == "")) / n
    readability = F.lit(100.0) - F.least(long_lines * 0.5, F.lit(20.0)) - F.greatest(average - 80, F.lit(0.0)) * 0.2 - F.when(blank < 0.1, 10.0).otherwise(0.0)
    number = lambda x: F.exists(F.regexp_extract_all(x, F.lit(P.MAGIC_NUMBER), F.lit(0)), lambda m: F.try_to_number(m, F.lit("9999999999999999")) > 10)
    tasks = F.size(F.filter("l", lambda x: x.rlike(P.TASK)))
    n_smells = long_lines + F.size(F.filter("l", number)) + tasks
    complexity = T.complexity_score(F.col("t")).cast("double")
    maintain = F.greatest(F.lit(0.0), (F.lit(100.0) - F.least(n_smells * 2, F.lit(30))) * F.col("complexity") / 100 - tasks)
    weight = {"critical": 30, "error": 15, "warning": 5}
    penalty = sum((F.size(F.filter("l", _matches(p))) * weight[s] * (F.lit(1) if langs is None else F.col(lang).isin(langs).cast("int")) for _, s, p, langs in P.SECURITY_RULES), F.lit(0))
    out = rows.withColumn("complexity", complexity)
    out = out.select(key, "complexity", F.greatest(F.lit(0.0), readability).alias("readability"), maintain.alias("maintainability"), F.greatest(F.lit(0.0), 100.0 - F.coalesce(penalty, F.lit(0))).alias("security"))
    return out.withColumn("overall", F.round(F.col("maintainability") * 0.3 + F.col("readability") * 0.25 + F.col("complexity") * 0.25 + F.col("security") * 0.2, 2))


def risk(facts: DataFrame) -> DataFrame:
    """Risk of each row of `facts` (key, complexity, coverage, changes, commits, n_lines): score (0 to 100) and level."""
    w = P.RISK_WEIGHTS
    part = lambda c, most: F.least(F.lit(1.0), F.col(c) / most)
    score = w[0] * part("complexity", 30.0) + w[1] * (1 - F.col("coverage")) + w[2] * part("changes", 10.0) + w[3] * (1 - part("commits", 20.0)) + w[4] * part("n_lines", 500.0)
    return facts.withColumn("raw", F.round(score, 6)).withColumn("level", T.risk_level(F.col("raw"))).withColumn("score", F.round(F.col("raw") * 100, 2)).drop("raw")


def nesting(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 3) -> DataFrame:
    """Deepest level of braces over the lines of a text (the running level never falls below 0), and whether it is too deep."""
    step = lambda s, x: F.struct(F.greatest(F.lit(0), s["now"] + F.regexp_count(x, F.lit(r"\{")) - F.regexp_count(x, F.lit(r"\}"))).alias("now"), F.greatest(s["top"], s["now"] + F.regexp_count(x, F.lit(r"\{")) - F.regexp_count(x, F.lit(r"\}"))).alias("top"))
    deepest = F.aggregate(F.split(text, "\n", -1), F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda s: s["top"])
    return docs.select(key, F.coalesce(deepest, F.lit(0)).alias("deepest")).withColumn("too_deep", F.col("deepest") > limit)


def indent_depth(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Most leading blanks of a line, by four."""
    depth = F.array_max(F.transform(F.split(text, "\n", -1), lambda x: F.floor((F.length(x) - F.length(F.ltrim(x))) / 4)))
    return docs.select(key, F.coalesce(depth, F.lit(0)).cast("int").alias("depth"))


def env_variables(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """KEY=VALUE lines: name, value (masked for secret names), is_secret; the last definition of a name in a file wins."""
    pattern = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$"
    each = lines(files, key, text).filter(~F.ltrim("content").startswith("#") & F.col("content").rlike(pattern))
    name, value = F.regexp_extract("content", pattern, 1), F.regexp_replace(F.trim(F.regexp_extract("content", pattern, 2)), r"^[\"']|[\"']$", "")
    secret = reduce(lambda a, b: a | b, [F.contains(F.lower(name), F.lit(k)) for k in P.SECRET_NAMES])
    last = each.select(key, "line", name.alias("name"), F.when(secret, "***").otherwise(value).alias("value"), secret.alias("is_secret"))
    w = Window.partitionBy(key, "name").orderBy(F.desc("line"))
    return last.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def review_score(findings: DataFrame, key: str) -> DataFrame:
    """100 less 20, 10, 5 or 1 for each finding (critical, high, medium, low); 0 at least."""
    cost = F.when(F.col("severity") == "critical", 20).when(F.col("severity") == "high", 10).when(F.col("severity") == "medium", 5).otherwise(1)
    return findings.groupBy(key).agg(F.greatest(F.lit(0).cast("long"), 100 - F.sum(cost)).alias("score"), F.count(F.lit(1)).alias("n_findings"))


def added_tasks(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """Added lines ('+' but no '+++' header) that hold a task mark."""
    each = lines(diffs, key, diff)
    return each.filter(F.col("content").startswith("+") & ~F.col("content").startswith("+++") & F.col("content").rlike("TODO|FIXME")).select(key, "line", F.trim(F.substring("content", 2, 2**30)).alias("task"))
