"""File scans: trees as tables, name predicates, listings of version control."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Folders that scans leave out, and names of files that hold secrets.
EXCLUDED_FOLDERS = [".git", ".svn", "node_modules", "__pycache__", "build", "dist", "target", ".idea", ".vscode", "venv", ".venv"]
SECRET_FILES = [".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "*.jks", "*.keystore", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "*.crt", "*.cer", "*.der", "credentials.json", "secrets.json", "secrets.yaml", "secrets.yml", "*.secret", "secret.*", "htpasswd", ".htpasswd", ".pgpass", ".netrc"]


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder: path (relative), ext, size, mtime, content (text). Spark's file scans leave empty files out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")
    return raw.select(path.alias("path"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"))


def glob_pattern(glob: str) -> str:
    """A regular expression for a file-name glob."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def matches_any(name: Column, globs: list[str]) -> Column:
    return name.rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs))


def base_name(path: str = "path") -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def depth(path: str = "path") -> Column:
    return F.size(F.split(path, "/")) - 1


def kept(files: DataFrame, folders: list[str] | None = None, globs: list[str] | None = None, most_depth: int | None = None) -> DataFrame:
    """Files outside excluded folders, whose names match no glob, at most so deep."""
    out = files.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in folders or EXCLUDED_FOLDERS])))
    out = out.filter(~matches_any(base_name(), globs)) if globs else out
    return out if most_depth is None else out.filter(depth() <= most_depth)


def folders(files: DataFrame) -> DataFrame:
    """Distinct folders on the paths of files: folder, n_files (below it)."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.filter(depth() > 0).select(F.explode(prefixes).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"))


def secret_files(files: DataFrame) -> DataFrame:
    return files.filter(matches_any(base_name(), SECRET_FILES)).select("path")


def count_extensions(files: DataFrame, extensions: list[str]) -> DataFrame:
    """extension, n, with zeros for those without files; a name counts for every extension that it ends in."""
    hits = F.explode(F.filter(F.array(*[F.when(F.col("path").endswith(e), F.lit(e)) for e in extensions]), lambda x: x.isNotNull()))
    counts = files.select(hits.alias("extension")).groupBy("extension").agg(F.count(F.lit(1)).alias("n"))
    wanted = files.sparkSession.createDataFrame([(e,) for e in extensions], "extension string")
    return wanted.join(counts, "extension", "left").select("extension", F.coalesce("n", F.lit(0)).alias("n"))


def commits(log: DataFrame) -> DataFrame:
    """Log lines 'hash|short|author|date|subject' (id, line): the subject may hold bars."""
    p = F.split("line", r"\|", 5)
    return log.filter(F.size(p) == 5).select("id", p[0].alias("hash"), p[1].alias("short"), p[2].alias("author"), p[3].alias("date"), p[4].alias("subject"))


def contributors(log: DataFrame, k: int = 10) -> DataFrame:
    return commits(log).groupBy("author").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "author").limit(k)


def short_stat(lines_: DataFrame) -> DataFrame:
    """'3 files changed, 10 insertions(+), 2 deletions(-)' (id, line): files, insertions, deletions; 0 where absent."""
    number = lambda word: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("line", rf"(\d+) {word}", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    return lines_.select("id", number("file").alias("files"), number("insertion").alias("insertions"), number("deletion").alias("deletions"))


def blame(porcelain: DataFrame) -> DataFrame:
    """Line-porcelain rows (file, n, line) to (file, line, author, code): code rows start with a tab, and take what came before."""
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = porcelain.withColumn("author", F.last(F.when(F.col("line").startswith("author "), F.expr("substring(line, 8)")), ignorenulls=True).over(w))
    code = marked.filter(F.col("line").startswith("\t"))
    return code.select("file", F.row_number().over(Window.partitionBy("file").orderBy("n")).alias("line"), "author", F.expr("substring(line, 2)").alias("code"))


def branches(names: DataFrame) -> DataFrame:
    """Branch names by kind (local or remote), in order."""
    kind = F.when(F.col("name").startswith("remotes/"), "remote").otherwise("local")
    return names.groupBy(kind.alias("kind")).agg(F.sort_array(F.collect_list(F.regexp_replace("name", "^remotes/", ""))).alias("names"))


def any_of(column: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(column), F.lit(w)) for w in words])
