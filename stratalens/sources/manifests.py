"""Connectors for project manifests: each turns (path, content) into rows, with built-in functions where a grammar allows it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.sources.tables import lines


def named(files: DataFrame, *names: str) -> DataFrame:
    """Files whose last path part is one of the names."""
    return files.filter(F.regexp_extract("path", r"([^/]+)$", 1).isin(*names))


def _pairs(column: Column, kind: str) -> Column:
    return F.transform(F.map_entries(F.coalesce(column, F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(kind).alias("kind")))


def package_json(files: DataFrame) -> DataFrame:
    """path, name, version, scripts (names in order) and dependencies as rows: path, project, name, version, kind."""
    schema = "name string, version string, scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>"
    parsed = named(files, "package.json").select("path", F.from_json("content", schema).alias("j"))
    each = F.concat(_pairs(F.col("j.dependencies"), "prod"), _pairs(F.col("j.devDependencies"), "dev"), _pairs(F.col("j.peerDependencies"), "peer"))
    return parsed.select("path", F.col("j.name").alias("project"), F.explode(each).alias("d")).select("path", "project", "d.*")


def npm_lock(files: DataFrame) -> DataFrame:
    """path, name, version, kind (dev, optional, peer or prod, in this order), is_direct (no scope)."""
    schema = "packages map<string, struct<version: string, dev: boolean, optional: boolean, peer: boolean>>"
    parsed = named(files, "package-lock.json").select("path", F.explode(F.from_json("content", schema)["packages"]).alias("key", "p")).filter("key <> ''")
    name = F.regexp_replace("key", r"^.*node_modules/", "")
    kind = F.when(F.coalesce("p.dev", F.lit(False)), "dev").when(F.coalesce("p.optional", F.lit(False)), "optional").when(F.coalesce("p.peer", F.lit(False)), "peer").otherwise("prod")
    return parsed.select("path", name.alias("name"), F.col("p.version").alias("version"), kind.alias("kind"), (~name.startswith("@")).alias("is_direct"))


REQUIREMENT = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(==|>=|<=|~=|!=|>|<)?\s*([^\s;#]*)"


def requirements(files: DataFrame) -> DataFrame:
    """path, name, operator, version; a bare name has operator 'any'."""
    each = lines(named(files, "requirements.txt"), "path", "content").filter(F.col("content").rlike(REQUIREMENT))
    part = lambda i: F.regexp_extract("content", REQUIREMENT, i)
    return each.select("path", part(1).alias("name"), F.when(part(2) == "", "any").otherwise(part(2)).alias("operator"), part(3).alias("version"))


def sections(files: DataFrame) -> DataFrame:
    """Key-value lines of section files such as TOML: path, section, key, value (quotes off), line."""
    each = lines(files, "path", "content")
    head = F.when(F.col("content").rlike(r"^\[+[^\]]+\]+\s*$"), F.regexp_extract("content", r"^\[+([^\]]+)\]+", 1))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("section", F.last(head, ignorenulls=True).over(w))
    pattern = r"^([A-Za-z0-9_.-]+)\s*=\s*(.+?)\s*$"
    return placed.filter(F.col("content").rlike(pattern)).select("path", "section", F.regexp_extract("content", pattern, 1).alias("key"), F.regexp_replace(F.regexp_extract("content", pattern, 2), r'^"|"$', "").alias("value"), "line")


def cargo(files: DataFrame) -> DataFrame:
    """Dependencies of Cargo.toml: path, name, version (of a simple string or a detailed table), kind."""
    rows = sections(named(files, "Cargo.toml")).filter(F.col("section").isin("dependencies", "dev-dependencies"))
    version = F.when(F.col("value").startswith("{"), F.regexp_extract("value", r'version\s*=\s*"([^"]*)"', 1)).otherwise(F.col("value"))
    return rows.select("path", F.col("key").alias("name"), version.alias("version"), F.when(F.col("section") == "dependencies", "prod").otherwise("dev").alias("kind"))


def lock_blocks(files: DataFrame, name: str) -> DataFrame:
    """[[package]] blocks of Cargo.lock or poetry.lock: path, name, version."""
    block = F.explode(F.split("content", r"\[\[package\]\]")).alias("b")
    found = named(files, name).select("path", block).filter(F.col("b").rlike(r'name = "'))
    return found.select("path", F.regexp_extract("b", r'name = "([^"]+)"', 1).alias("name"), F.regexp_extract("b", r'version = "([^"]+)"', 1).alias("version"))


def yarn_lock(files: DataFrame) -> DataFrame:
    """Blocks parted by blank lines: path, name, version."""
    block = F.explode(F.split("content", r"\n\n")).alias("b")
    found = named(files, "yarn.lock").select("path", block)
    name, version = F.regexp_extract("b", r'^"?(@?[^@"\n]+)@', 1), F.regexp_extract("b", r'version "([^"]+)"', 1)
    return found.select("path", name.alias("name"), version.alias("version")).filter("name <> '' and version <> ''")


def go_mod(files: DataFrame) -> DataFrame:
    """Required modules: path, module (the file's own), go, name, version, indirect."""
    pattern = r"^\s*([a-zA-Z0-9_./-]+\.[a-zA-Z0-9_./-]+)\s+v(\S+)"
    base = named(files, "go.mod")
    own = base.select("path", F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1).alias("module"), F.regexp_extract("content", r"(?m)^go\s+(\S+)", 1).alias("go"))
    each = lines(base, "path", "content").filter(F.col("content").rlike(pattern))
    rows = each.select("path", F.regexp_extract("content", pattern, 1).alias("name"), F.regexp_extract("content", pattern, 2).alias("version"), F.contains("content", F.lit("// indirect")).alias("indirect"))
    return rows.join(own, "path")


def go_sum(files: DataFrame) -> DataFrame:
    """path, name, version without the leading v and /go.mod; the last line of a name wins."""
    each = lines(named(files, "go.sum"), "path", "content").withColumn("p", F.split("content", " ")).filter(F.size("p") >= 3)
    rows = each.select("path", "line", F.col("p")[0].alias("name"), F.regexp_replace(F.regexp_replace(F.col("p")[1], "/go.mod$", ""), "^v", "").alias("version"))
    return rows.groupBy("path", "name").agg(F.max_by("version", "line").alias("version"))


def maven(files: DataFrame) -> DataFrame:
    """Dependencies of pom.xml: path, project, group, name, version, spring_boot."""
    parsed = named(files, "pom.xml").select("path", "content", F.xpath_string("content", F.lit("/project/artifactId")).alias("project"))
    zipped = F.arrays_zip(F.xpath("content", F.lit("//dependency/groupId/text()")).alias("g"), F.xpath("content", F.lit("//dependency/artifactId/text()")).alias("a"), F.xpath("content", F.lit("//dependency/version/text()")).alias("v"))
    rows = parsed.select("path", "project", F.contains("content", F.lit("spring-boot")).alias("spring_boot"), F.explode(zipped).alias("z"))
    return rows.select("path", "project", F.col("z.g").alias("group"), F.col("z.a").alias("name"), F.col("z.v").alias("version"), "spring_boot")


def gradle(files: DataFrame) -> DataFrame:
    """Dependencies of build.gradle(.kts): path, kind, module."""
    pattern = r"""(?m)^\s*(\w*[iI]mplementation|api|kapt|compileOnly)\s*\(?["']([^"']+)["']"""
    found = named(files, "build.gradle", "build.gradle.kts")
    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("kind"), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)).alias("module"))
    return found.select("path", F.explode(both).alias("z")).select("path", "z.kind", "z.module")


def gradle_android(files: DataFrame) -> DataFrame:
    value = lambda k: F.try_to_number(F.nullif(F.regexp_extract("content", rf"{k}\s*=?\s*(\d+)", 1), F.lit("")), F.lit("999999")).cast("int").alias(k)
    return named(files, "build.gradle", "build.gradle.kts").select("path", value("compileSdk"), value("minSdk"), value("targetSdk"))


def cmake(files: DataFrame) -> DataFrame:
    """path, project, version, packages, targets: comments are taken out first."""
    text = F.regexp_replace("content", r"(?m)#.*$", "")
    base = named(files, "CMakeLists.txt").select("path", text.alias("t"))
    return base.select("path", F.regexp_extract("t", r"project\s*\(\s*(\w+)", 1).alias("project"), F.regexp_extract("t", r"VERSION\s+([0-9.]+)\s+LANGUAGES", 1).alias("version"), F.regexp_extract_all("t", F.lit(r"find_package\s*\(\s*(\w+)"), F.lit(1)).alias("packages"), F.regexp_extract_all("t", F.lit(r"add_(?:executable|library)\s*\(\s*(\w+)"), F.lit(1)).alias("targets"))


def android_manifest(files: DataFrame) -> DataFrame:
    """path, package, permissions, components."""
    values = lambda p: F.regexp_extract_all("content", F.lit(p), F.lit(1))
    return named(files, "AndroidManifest.xml").select("path", F.regexp_extract("content", r'package="([^"]+)"', 1).alias("package"), values(r'<uses-permission[^>]*android:name="([^"]+)"').alias("permissions"), values(r'<(?:activity|service|receiver|provider)[^>]*android:name="([^"]+)"').alias("components"))


def device_tree(files: DataFrame) -> DataFrame:
    found = files.filter(F.col("path").rlike(r"\.dtsi?$"))
    return found.select("path", F.array_distinct(F.flatten(F.transform(F.regexp_extract_all("content", F.lit(r"compatible\s*=\s*([^;]+);"), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit(r'"([^"]+)"'), F.lit(1))))).alias("compatible"), F.regexp_extract("content", r'model\s*=\s*"([^"]+)"', 1).alias("model"))


def kernel_config(files: DataFrame) -> DataFrame:
    """CONFIG_ lines: path, name, state (enabled, module or value), value."""
    pattern = r"^CONFIG_([A-Za-z0-9_]+)=(.*)$"
    each = lines(files.filter(F.col("path").rlike(r"(^|/)(\.config|prj\.conf)$|defconfig$")), "path", "content").filter(F.col("content").rlike(pattern))
    value = F.regexp_extract("content", pattern, 2)
    return each.select("path", F.regexp_extract("content", pattern, 1).alias("name"), F.when(value == "y", "enabled").when(value == "m", "module").otherwise("value").alias("state"), value.alias("value"))


def linker_script(files: DataFrame) -> DataFrame:
    """Memory regions: path, entry, region, access, origin, size."""
    pattern = r"(\w+)\s*\((\w+)\)\s*:\s*ORIGIN\s*=\s*(\w+),\s*LENGTH\s*=\s*(\w+)"
    group = lambda i: F.regexp_extract_all("content", F.lit(pattern), F.lit(i))
    zipped = F.arrays_zip(group(1).alias("region"), group(2).alias("access"), group(3).alias("origin"), group(4).alias("size"))
    found = files.filter(F.col("path").endswith(".ld"))
    return found.select("path", F.regexp_extract("content", r"ENTRY\((\w+)\)", 1).alias("entry"), F.explode(zipped).alias("z")).select("path", "entry", "z.*")


def defines(files: DataFrame, name: str = "FreeRTOSConfig.h") -> DataFrame:
    pattern = r"^#define\s+(config\w+)\s+(\d+)"
    each = lines(named(files, name), "path", "content").filter(F.col("content").rlike(pattern))
    return each.select("path", F.regexp_extract("content", pattern, 1).alias("name"), F.regexp_extract("content", pattern, 2).cast("int").alias("value"))


def make_variables(files: DataFrame) -> DataFrame:
    """LOCAL_ and APP_ variables of Android.mk and Application.mk: path, name, values."""
    pattern = r"^((?:LOCAL|APP)_\w+)\s*[:+]?=\s*(.*)$"
    each = lines(named(files, "Android.mk", "Application.mk"), "path", "content").filter(F.col("content").rlike(pattern))
    return each.select("path", F.regexp_extract("content", pattern, 1).alias("name"), F.split(F.trim(F.regexp_extract("content", pattern, 2)), r"\s+").alias("values"))


_TOKEN = "[A-Za-z_][A-Za-z0-9_-]{0,99}"
#: YAML of plain names alone: mappings of up to three levels, indented by two spaces, and lists of names on the first level.
_PLAIN = re.compile(rf"(?:{_TOKEN}: (?:{_TOKEN}|\[{_TOKEN}(?:, {_TOKEN})*+\])\n|{_TOKEN}:\n(?:  {_TOKEN}: {_TOKEN}\n|  {_TOKEN}:\n(?:    {_TOKEN}: {_TOKEN}\n)*+)*+)*+")
_BLOCK, _INNER = re.compile(rf"({_TOKEN}):(?: (.*))?\n((?:  .*\n)*+)"), re.compile(rf"^  ({_TOKEN}):", re.M)
#: Names that YAML takes for booleans or null.
_NO_NAMES = {f(x) for x in ("yes", "no", "true", "false", "on", "off", "null") for f in (str.lower, str.title, str.upper)}


def _plain_pipeline(content: str, github: bool) -> tuple[list[str], list[str]] | None:
    """Jobs and stages of a pipeline of plain names; None if the file needs a YAML parser."""
    text = content if content.endswith("\n") else content + "\n"
    if not _PLAIN.fullmatch(text):
        return None
    found = _BLOCK.findall(text)
    blocks = {name: (value, body) for name, value, body in found}
    value, body = blocks.get("jobs" if github else "stages", ("", ""))
    if len(blocks) < len(found) or (value if github else body or (value and value[0] != "[")):
        return None
    if github:
        jobs, stages = sorted(set(_INNER.findall(body))), []
    else:
        jobs, stages = sorted(k for k, (_, inner) in blocks.items() if "script" in _INNER.findall(inner)), value[1:-1].split(", ") if value else []
    return (jobs, stages) if _NO_NAMES.isdisjoint(jobs + stages) else None


def _pipeline(content: str | None, github: bool) -> tuple[list[str], list[str]]:
    """Jobs and stages of a workflow or pipeline; a file that is no YAML has none."""
    import yaml

    content = content or ""
    if (found := _plain_pipeline(content, github)) is not None:
        return found
    try:
        doc = yaml.load(content, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:
        doc = {}
    doc = doc if isinstance(doc, dict) else {}
    if github:
        return sorted(map(str, doc.get("jobs") or {})), []
    return sorted(str(k) for k, v in doc.items() if isinstance(v, dict) and "script" in v), [str(s) for s in doc.get("stages") or []]


def pipelines(files: DataFrame) -> DataFrame:
    """CI pipelines (YAML and Jenkinsfile): path, platform, jobs, stages. YAML has no built-in reader: one Arrow batch at a time, and a
    parser only where a file has more than plain names."""
    import yaml  # noqa: F401  (fail early on the driver if it is missing)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            github = [".github/workflows/" in path for path in batch.column("path").to_pylist()]
            read = [_pipeline(*x) for x in zip(batch.column("content").to_pylist(), github, strict=True)]
            lists = [pa.array([r[k] for r in read], pa.list_(pa.string())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(["github" if g else "gitlab" for g in github], pa.string()), *lists], ["path", "platform", "jobs", "stages"])

    text = files.filter(F.col("path").rlike(r"\.github/workflows/[^/]+\.ya?ml$|\.gitlab-ci\.yml$")).select("path", "content")
    read = text.mapInArrow(parse, "path string, platform string, jobs array<string>, stages array<string>")
    stages = F.regexp_extract_all("content", F.lit(r"stage\s*\(\s*['\"]([^'\"]+)['\"]"), F.lit(1))
    jenkins = named(files, "Jenkinsfile").select("path", F.lit("jenkins").alias("platform"), F.array().cast("array<string>").alias("jobs"), stages.alias("stages"))
    return read.unionByName(jenkins)


def secret_references(files: DataFrame) -> DataFrame:
    """${{ secrets.X }} in any file: path, secrets (distinct, in order)."""
    found = F.sort_array(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\$\{\{\s*secrets\.(\w+)\s*\}\}"), F.lit(1))))
    return files.select("path", found.alias("secrets")).filter(F.size("secrets") > 0)


def dependencies(files: DataFrame) -> DataFrame:
    """Direct dependencies of all ecosystems under one schema: path, name, version, kind, source."""
    npm = package_json(files).select("path", "name", "version", "kind", F.lit("npm").alias("source"))
    pip = requirements(files).select("path", "name", "version", F.lit("prod").alias("kind"), F.lit("pip").alias("source"))
    rust = cargo(files).select("path", "name", "version", "kind", F.lit("cargo").alias("source"))
    go = go_mod(files).select("path", "name", "version", F.lit("prod").alias("kind"), F.lit("go").alias("source"))
    mvn = maven(files).select("path", "name", "version", F.lit("prod").alias("kind"), F.lit("maven").alias("source"))
    return npm.unionByName(pip).unionByName(rust).unionByName(go).unionByName(mvn)


def conflicts(deps: DataFrame) -> DataFrame:
    """Names with more than one version: name, versions, n."""
    return deps.groupBy("name").agg(F.sort_array(F.collect_set("version")).alias("versions")).withColumn("n", F.size("versions")).filter("n > 1")
