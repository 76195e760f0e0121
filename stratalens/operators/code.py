"""Structure of source files (path, content): functions, imports, calls, tests, environment, chunks."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import patterns as P
from stratalens.sources.tables import lines


def with_language(files: DataFrame) -> DataFrame:
    """Files of a known extension, with lang."""
    table = F.create_map(*[F.lit(x) for pair in P.SOURCE_LANGUAGES.items() for x in pair])
    return files.withColumn("lang", F.try_element_at(table, F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))).filter("lang is not null")


def _first(column: Column, rules: list[tuple[str, str, int]], lang: Column) -> Column:
    """What the first matching rule of the language captures, else null."""
    return F.coalesce(*[F.when((lang == g) & column.rlike(p), F.regexp_extract(column, p, i)) for g, p, i in rules])


def functions(files: DataFrame) -> DataFrame:
    """path, lang, name, line, end_line (the line before the next function, or the last of the file)."""
    each = lines(with_language(files), "path", "content", ("lang",))
    found = each.withColumn("name", _first(F.col("content"), P.FUNCTIONS, F.col("lang"))).filter(F.col("name").isNotNull() & ~F.col("name").isin(P.NOT_FUNCTIONS))
    total = files.select("path", F.size(F.split("content", "\n", -1)).alias("total"))
    w = Window.partitionBy("path").orderBy("line")
    return found.join(total, "path").select("path", "lang", "name", "line", F.coalesce(F.lead("line").over(w) - 1, F.col("total")).alias("end_line"))


def imports(files: DataFrame) -> DataFrame:
    """path, module: one row for each import line."""
    each = lines(with_language(files), "path", "content", ("lang",))
    return each.select("path", F.trim(_first(F.col("content"), P.IMPORTS, F.col("lang"))).alias("module")).filter("module is not null")


def calls(files: DataFrame) -> DataFrame:
    """Calls of functions of the same file, by lines of their bodies: path, src, dst, line."""
    known = functions(files)
    each = lines(with_language(files), "path", "content")
    tokens = each.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b(\w+)\s*\("), F.lit(1)))).alias("dst"))
    bodies = known.select("path", F.col("name").alias("src"), F.col("line").alias("low"), F.col("end_line").alias("high"))
    inside = tokens.join(bodies, "path").filter((F.col("line") >= F.col("low")) & (F.col("line") <= F.col("high")) & (F.col("src") != F.col("dst")))
    names = known.select("path", F.col("name").alias("dst")).distinct()
    return inside.join(names, ["path", "dst"]).select("path", "src", "dst", "line")


def test_files(files: DataFrame) -> DataFrame:
    """Test files by the first framework whose pattern starts their name: path, framework, cases."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    framework = F.coalesce(*[F.when(name.rlike(f"^(?:{p})"), F.lit(f)) for f, p, _ in P.TEST_FRAMEWORKS])
    cases = reduce(lambda c, r: c.when(F.col("framework") == r[0], F.regexp_count("content", F.lit(r[2]))), P.TEST_FRAMEWORKS[1:], F.when(F.col("framework") == P.TEST_FRAMEWORKS[0][0], F.regexp_count("content", F.lit(P.TEST_FRAMEWORKS[0][2]))))
    return files.withColumn("framework", framework).filter("framework is not null").select("path", "framework", cases.alias("cases"))


def coverage(files: DataFrame) -> DataFrame:
    """Source files and whether a test is named after them: path, covered."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[A-Za-z0-9]+$", 1)
    tests = test_files(files).select("path", F.regexp_replace(F.regexp_replace(stem("path"), r"^test_|_test$|\.(test|spec)$", ""), r"Tests?$", "").alias("stem"))
    sources = with_language(files).select("path", stem("path").alias("stem")).join(tests.select("path"), "path", "left_anti")
    return sources.join(tests.select("stem").distinct().withColumn("covered", F.lit(True)), "stem", "left").select("path", F.coalesce("covered", F.lit(False)).alias("covered"))


def environment(files: DataFrame) -> DataFrame:
    """Variables read by code, each with its first place: name, path, line, is_secret."""
    found = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in P.ENVIRONMENT])
    each = lines(files, "path", "content").select("path", "line", F.explode(found).alias("name"))
    w = Window.partitionBy("name").orderBy("path", "line")
    first = each.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    return first.withColumn("is_secret", reduce(lambda a, b: a | b, [F.contains(F.lower("name"), F.lit(k)) for k in P.SECRET_NAMES]))


def syntax(files: DataFrame) -> DataFrame:
    """Python structure by the parser: path, kind, name, line, n_params, docstring; broken files give a row of kind error."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError):
                    rows.append((path, "error", None, None, None, None))
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        rows.append((path, "function", node.name, node.lineno, len(node.args.args), ast.get_docstring(node)))
                    elif isinstance(node, ast.ClassDef):
                        rows.append((path, "class", node.name, node.lineno, None, ast.get_docstring(node)))
                    elif isinstance(node, ast.Import):
                        rows += [(path, "import", a.name, node.lineno, None, None) for a in node.names]
                    elif isinstance(node, ast.ImportFrom):
                        rows.append((path, "import", node.module, node.lineno, None, None))
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "line", "n_params", "docstring"]).astype({"line": "Int64", "n_params": "Int64"})

    python = files.filter(F.col("path").endswith(".py")).select("path", "content")
    return python.mapInPandas(parse, "path string, kind string, name string, line long, n_params long, docstring string")


def chunks(files: DataFrame, least: int = 10) -> DataFrame:
    """Chunks of files for indexing: a chunk closes before an unindented line once it has `least` lines: path, chunk, low, high."""
    each = lines(files, "path", "content").withColumn("open", (F.trim("content") != "") & ~F.col("content").rlike(r"^\s"))
    step = lambda s, x: F.when(x["open"] & (x["line"] - s["low"] >= least), F.struct(x["line"].alias("low"), F.array_append(s["cuts"], x["line"]).alias("cuts"))).otherwise(s)
    by = each.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "open"))).alias("l"))
    start = F.struct(F.lit(1).alias("low"), F.array(F.lit(1)).alias("cuts"))
    cut = by.select("path", F.size("l").alias("n"), F.aggregate("l", start, step, lambda s: s["cuts"]).alias("cuts"))
    return cut.select("path", "n", "cuts", F.posexplode("cuts").alias("chunk", "low")).select("path", "chunk", "low", (F.coalesce(F.try_element_at("cuts", F.col("chunk") + 2), F.col("n") + 1) - 1).alias("high"))


def language_vote(files: DataFrame) -> DataFrame:
    """Main language of each project (project, path): weights fall by a tenth for each folder, headers don't count, the first
    seen wins ties."""
    ext = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    table = F.create_map(*[x for e, (n, w) in P.LANGUAGE_WEIGHTS.items() for x in (F.lit(e), F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("w")))])
    depth = F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))
    each = files.select("project", "path", F.try_element_at(table, ext).alias("l"), depth.alias("depth")).filter("l is not null and not endswith(l.name, '-header')")
    by = each.groupBy("project", "l.name").agg(F.sum(F.col("l.w") * (1.0 - F.col("depth") * 0.1)).alias("score"), F.min("path").alias("first"))
    w = Window.partitionBy("project").orderBy(F.desc(F.round("score", 9)), "first")
    return by.withColumn("r", F.row_number().over(w)).filter("r = 1").select("project", F.col("name").alias("language"), F.round("score", 6).alias("score"))


def build_system(files: DataFrame) -> DataFrame:
    """Build system of each project by the first build file in the order of precedence; unknown without one."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rank = F.coalesce(*[F.when(name.rlike("^" + p.replace(".", r"\.").replace("*", ".*") + "$"), F.lit(i)) for i, (p, _) in enumerate(P.BUILD_FILES)])
    systems = F.array(*[F.lit(s) for _, s in P.BUILD_FILES])
    by = files.groupBy("project").agg(F.min(rank).alias("rank"))
    return by.select("project", F.coalesce(F.get(systems, F.col("rank")), F.lit("unknown")).alias("build_system"))
