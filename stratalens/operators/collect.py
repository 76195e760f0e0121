"""Whole-project facts, index levels, stores, audit rows, and the registry of analyzers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.functions import text as T
from stratalens.operators import code as K
from stratalens.operators import detect, scan
from stratalens.operators.catalog import insert_absent
from stratalens.sources.tables import lines

# Extensions whose content is scanned, kinds of sub-projects by a part of their path, and documents of project types.
SCANNED = [
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".kt", ".swift", ".c", ".cpp", ".h", ".hpp", ".cc", ".go", ".rs", ".rb", ".php",
    ".json", ".yaml", ".yml", ".xml", ".toml", ".ini", ".conf", ".cfg", ".sh", ".bash", ".zsh", ".bat", ".ps1", ".md", ".txt", ".rst", ".env",
    ".html", ".css", ".scss", ".less", ".vue", ".svelte",
]
PART_KINDS = [("freertos", "freertos"), ("rtos", "rtos"), ("sdk", "sdk"), ("driver", "driver"), ("bsp", "bsp"), ("project", "app"), ("component", "component"), ("tool", "tool")]
TYPE_DOCUMENTS = {
    "android-app": "mobile/android.md", "android-ndk": "embedded/android-native.md", "aosp": "embedded/android-native.md", "ios": "mobile/ios.md",
    "stm32": "embedded/mcu.md", "esp32": "embedded/mcu.md", "pico": "embedded/mcu.md", "keil": "embedded/mcu.md", "iar": "embedded/mcu.md",
    "freertos": "embedded/rtos.md", "zephyr": "embedded/rtos.md", "rt-thread": "embedded/rtos.md",
    "embedded-linux": "embedded/linux.md", "buildroot": "embedded/linux.md", "yocto": "embedded/linux.md", "qnx": "embedded/qnx.md",
    "react": "web/frontend.md", "vue": "web/frontend.md", "angular": "web/frontend.md", "svelte": "web/frontend.md", "nextjs": "web/frontend.md", "nuxt": "web/frontend.md",
    "django": "web/backend.md", "fastapi": "web/backend.md", "flask": "web/backend.md", "electron": "desktop/desktop.md", "qt": "desktop/desktop.md",
    "cmake": "system/native.md", "makefile": "system/native.md", "go": "system/native.md", "rust": "system/native.md", "flutter": "desktop/desktop.md",
}


def scannable(files: DataFrame) -> DataFrame:
    """Files whose content is worth a scan, by their extension."""
    return files.filter(F.lower(F.regexp_extract("path", r"[^/](\.[^./]+)$", 1)).isin(SCANNED))


def normalized(question: Column) -> Column:
    """A question of the knowledge graph: trimmed, lower-cased, white space to one blank."""
    return F.regexp_replace(F.lower(F.regexp_replace(question, r"^\s+|\s+$", "")), r"\s+", " ")


def sub_projects(manifests: DataFrame) -> DataFrame:
    """Projects of repository manifests (path, content as XML): manifest, name, path (the name without one), revision, kind."""
    # Attributes may be absent, so every project is taken apart by itself.
    each = manifests.filter(F.col("content").isNotNull()).select(F.col("path").alias("manifest"), F.explode(F.regexp_extract_all("content", F.lit(r"<project\b[^>]*>"), F.lit(0))).alias("p"))
    value = lambda a: F.regexp_extract("p", rf"\s{a}\s*=\s*[\"']([^\"']*)[\"']", 1)
    out = each.select("manifest", value("name").alias("name"), F.coalesce(F.nullif(value("path"), F.lit("")), value("name")).alias("path"), value("revision").alias("revision"))
    kind = F.coalesce(*[F.when(F.contains(F.lower("path"), F.lit(p)), F.lit(k)) for p, k in PART_KINDS], F.lit("unknown"))
    return out.withColumn("kind", kind)


def file_history(commit_files: DataFrame, paths: DataFrame, k: int = 10) -> DataFrame:
    """The newest k commits (commit, path, ts) of each asked path: path, commit, ts."""
    w = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("commit"))
    asked = commit_files.join(paths.select("path").distinct(), "path", "left_semi")
    return asked.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("path", "commit", "ts")


def repository_info(commits: DataFrame, tags: DataFrame, remotes: DataFrame) -> DataFrame:
    """Of each repository its last commit (repo, commit, author, ts), tags (repo, tag) in order and remote (repo, url)."""
    last = commits.groupBy("repo").agg(F.max(F.struct("ts", "commit", "author")).alias("l"), F.count(F.lit(1)).alias("commits"))
    named = tags.groupBy("repo").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    out = last.join(named, "repo", "left").join(remotes.groupBy("repo").agg(F.min("url").alias("remote")), "repo", "left")
    return out.select("repo", F.col("l.commit").alias("last_commit"), F.col("l.author").alias("author"), F.col("l.ts").alias("at"), "commits", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "remote")


def project_facts(files: DataFrame) -> DataFrame:
    """Everything about each project (project, path, content) in one row: types in order, platform, language, scale, files, entry points,
    configuration, subsystems and processes."""
    ordered = lambda rows, key, value, name: rows.groupBy("project").agg(F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value]).alias(name))
    listed = lambda rows, value, name: rows.groupBy("project").agg(F.sort_array(F.collect_set(value)).alias(name))
    types = detect.detect_types(files)
    out = detect.scale(files).select("project", "files", "scale").join(ordered(types, "rank", "type", "types"), "project", "left").join(detect.platforms(types), "project", "left")
    out = out.join(K.language_vote(files).select("project", "language"), "project", "left")
    for rows, value, name in ((detect.entry_points(files), "path", "entries"), (detect.config_files(files), "path", "configs"), (detect.subsystems(files), "subsystem", "subsystems"), (detect.process_names(files), "process", "processes")):
        out = out.join(listed(rows, value, name), "project", "left")
    none = F.array().cast("array<string>")
    return out.select("project", "files", "scale", "language", F.coalesce("platform", F.lit("unknown")).alias("platform"), *[F.coalesce(c, none).alias(c) for c in ("types", "entries", "configs", "subsystems", "processes")])


def type_documents(types: DataFrame) -> DataFrame:
    """The document that goes with each project's first type (project, type, rank): project, document (null without one)."""
    table = F.create_map(*[F.lit(x) for pair in TYPE_DOCUMENTS.items() for x in pair])
    return types.filter("rank = 1").select("project", F.try_element_at(table, F.col("type")).alias("document"))


def deep_index(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Overall quality and the number of security issues and smells of every text: key, overall, issues, smells."""
    count = lambda rows, name: rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    out = scan.quality(docs, key, text, lang).select(key, "overall")
    for rows, name in ((scan.security_issues(docs, key, text, lang), "issues"), (scan.smells(docs, key, text), "smells")):
        out = out.join(count(rows, name), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def project_quality(docs: DataFrame, project: str = "source", key: str = "doc_id") -> DataFrame:
    """Averages of the quality scores over each project's texts: project, files, complexity, readability, security, overall."""
    scores = scan.quality(docs).join(docs.select(key, project), key)
    return scores.groupBy(project).agg(F.count(F.lit(1)).alias("files"), *[F.round(F.avg(c), 4).alias(c) for c in ("complexity", "readability", "security", "overall")])


def vector_index(files: DataFrame, known: DataFrame | None = None, dimensions: int = 64) -> DataFrame:
    """Embeddings of the chunks of files (path, content), and of those in `known` that come first: id (path:chunk), content, embedding.
    Chunks that are known by their id stay as they are."""
    cut = K.chunks(files)
    each = cut.join(lines(files, "path", "content").withColumnRenamed("content", "text"), "path").filter((F.col("line") >= F.col("low")) & (F.col("line") <= F.col("high")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    made = each.groupBy("path", "chunk").agg(body.alias("content")).select(F.concat("path", F.lit(":"), F.col("chunk").cast("string")).alias("id"), "content")
    made = made.withColumn("embedding", T.pseudo_embedding(F.col("content"), dimensions))
    return made if known is None else insert_absent(known, made, ["id"])


def signature_help(cursors: DataFrame, files: DataFrame) -> DataFrame:
    """The call that is open where a text before a cursor ends (cursor_id, path, before), and the line of the function of that name in the
    same file: cursor_id, name, line."""
    name = F.regexp_extract("before", r"(\w+)\s*\([^)]*$", 1)
    asked = cursors.select("cursor_id", "path", name.alias("name")).filter("name <> ''")
    return asked.join(K.functions(files).groupBy("path", "name").agg(F.min("line").alias("line")), ["path", "name"]).select("cursor_id", "name", "line")


def audit_rows(operations: DataFrame) -> DataFrame:
    """Audit entries of typed operations (ts, user, kind, file_path, details as JSON, duration_ms, success, error): access to sensitive
    files is a warning, failures are errors, all others are information; questions are kept as eight characters of their digest."""
    level = F.when(~F.coalesce("success", F.lit(True)), "error").when(F.col("kind") == "sensitive_access", "warn").otherwise("info")
    question = F.get_json_object("details", "$.question")
    hidden = F.to_json(F.struct(F.substring(F.md5(question), 1, 8).alias("question_hash"), F.get_json_object("details", "$.cached").alias("cached")))
    details = F.when((F.col("kind") == "qa_query") & question.isNotNull(), hidden).otherwise(F.coalesce("details", F.lit("{}")))
    return operations.select("ts", level.alias("level"), F.col("kind").alias("operation"), F.coalesce("user", F.lit("system")).alias("user"), F.coalesce("file_path", F.lit("")).alias("file_path"), details.alias("details"), F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), F.coalesce("success", F.lit(True)).alias("success"), F.coalesce("error", F.lit("")).alias("error"))


def append_log(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Append audit rows as JSON lines, a folder for each day; retention drops whole folders (`drop_days`)."""
    rows.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").json(path)


def drop_days(spark: SparkSession, path: str, before: str) -> int:
    """Delete the folders of days before one (yyyy-mm-dd); how many there were."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in store.listStatus(root) if s.getPath().getName().startswith("day=") and s.getPath().getName()[4:] < before]
    for p in old:
        store.delete(p, True)
    return len(old)


def save_index(tables: dict[str, DataFrame], path: str) -> None:
    """Index levels (or the tables of a graph, or vectors) as Parquet, compressed, a folder for each."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The saved levels of these names; those that were never saved are left out."""
    out = {}
    for name in names:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            out[name] = spark.read.parquet(f"{path}/{name}")
    return out


ANALYZERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def analyzer(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Registers a function from files (path, content) to facts under a name; one of the name replaces the last."""

    def add(function: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        ANALYZERS[name] = function
        return function

    return add


def analyze(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The facts of registered analyzers, all or some, as JSON rows: analyzer, fact."""
    out = None
    for name in sorted(ANALYZERS) if names is None else names:
        facts = ANALYZERS[name](files)
        rows = facts.select(F.lit(name).alias("analyzer"), F.to_json(F.struct(*sorted(facts.columns))).alias("fact"))
        out = rows if out is None else out.unionByName(rows)
    return files.sparkSession.createDataFrame([], "analyzer string, fact string") if out is None else out


analyzer("functions")(lambda files: K.functions(files).select("path", "name", "line"))
analyzer("imports")(K.imports)
analyzer("tests")(K.test_files)
