"""Project facts: processes and their interfaces, repositories, documents to update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators.blocking import containing
from stratalens.sources.files import any_of, base_name

def interfaces(files: DataFrame) -> DataFrame:
    """Interface blocks in AIDL and proto files and their methods: path, protocol, interface, method."""
    aidl = files.filter("path like '%.aidl'").select("path", F.lit("aidl").alias("protocol"), F.explode(F.regexp_extract_all("content", F.lit(r"interface\s+\w+\s*\{[^}]*\}"), F.lit(0))).alias("b"))
    proto = files.filter("path like '%.proto'").select("path", F.lit("grpc").alias("protocol"), F.explode(F.regexp_extract_all("content", F.lit(r"service\s+\w+\s*\{[^}]*\}"), F.lit(0))).alias("b"))
    method = F.when(F.col("protocol") == "aidl", F.regexp_extract_all("b", F.lit(r"(\w+)\s*\([^)]*\)\s*;"), F.lit(1))).otherwise(F.regexp_extract_all("b", F.lit(r"rpc\s+(\w+)"), F.lit(1)))
    return aidl.unionByName(proto).select("path", "protocol", F.regexp_extract("b", r"(?:interface|service)\s+(\w+)", 1).alias("interface"), F.explode(method).alias("method"))


def communication(files: DataFrame, names: DataFrame) -> DataFrame:
    """Which process folders (parents of main.*) use which interfaces (interface): process, interface. Words of sources are
    joined with the names, so no source meets every interface."""
    process = files.filter(base_name().rlike(r"^main\.")).select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("process")).distinct()
    words = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("process"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\w+"), F.lit(0)))).alias("interface")).distinct()
    return words.join(names.select("interface").distinct(), "interface").join(process, "process").select("process", "interface")


# Words of interface paths, configuration files, words of documents, and extensions of modules.
INTERFACE_WORDS = ["api", "controller", "route"]
CONFIG_PATHS = ["package.json", "requirements.txt", "pom.xml", "build.gradle", "CMakeLists.txt"]
DOCUMENT_WORDS = ["readme", "changelog"]
MODULE_SUFFIXES = [".py", ".js", ".ts", ".java", ".go", ".rs", ".c", ".cpp"]


def document_changes(changes: DataFrame) -> DataFrame:
    """Documents that changed paths (path) call for, by the first rule that fits: path, type, priority, section. Interfaces come first,
    then configuration at the root, documents and modules, whose section is their folder's name, root without one."""
    low, suffix = F.lower("path"), F.regexp_extract(F.lower(base_name()), r"[^.](\.[^.]*)$", 1)
    module = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    call = lambda kind, priority, section: F.struct(F.lit(kind).alias("type"), F.lit(priority).alias("priority"), section.alias("section"))
    rule = (
        F.when(any_of(low, INTERFACE_WORDS), call("api_modified", "high", F.lit("interfaces")))
        .when(F.col("path").isin(CONFIG_PATHS), call("config_changed", "medium", F.lit("configuration")))
        .when(any_of(low, DOCUMENT_WORDS), call("structure_changed", "low", F.lit("overview")))
        .when(suffix.isin(MODULE_SUFFIXES), call("module_modified", "medium", F.concat(F.lit("module "), F.when(module == "", "root").otherwise(module))))
    )
    return changes.select("path", rule.alias("r")).filter("r is not null").select("path", "r.*")


def document_status(changes: DataFrame) -> DataFrame:
    """Whether documents keep up with changed paths (repo, path): repo, changed, high, medium, low, and the status of the highest."""
    calls = document_changes(changes).select("path", "priority").distinct()
    each = changes.select("repo", "path").distinct().join(calls, "path", "left")
    of = lambda p: F.count(F.when(F.col("priority") == p, F.lit(1))).alias(p)
    by = each.groupBy("repo").agg(F.count(F.lit(1)).alias("changed"), of("high"), of("medium"), of("low"))
    status = F.when(F.col("high") > 0, "need_update").when(F.col("medium") > 0, "suggest_update").when(F.col("low") > 0, "minor_update").otherwise("synced")
    return by.withColumn("status", status)


def cross_dependencies(repos: DataFrame, deps: DataFrame) -> DataFrame:
    """Edges between repositories (repo): a dependency (repo, name) whose name holds another repository's name, or is local by its
    version (file:, link:, workspace:)."""
    others = repos.select(F.col("repo").alias("dst"))
    linked = containing(deps, others, "name", "dst").filter(F.col("repo") != F.col("dst")).select(F.col("repo").alias("src"), "dst", F.lit("name").alias("how"))
    local = deps.filter(F.col("version").rlike("^(file|link|workspace):")).join(others, F.col("name") == F.col("dst")).select(F.col("repo").alias("src"), "dst", F.lit("local").alias("how"))
    return linked.unionByName(local).distinct()
