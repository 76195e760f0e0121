"""Records and their upkeep: cache validity, users and teams, links, access, settings, templates, diagrams, request reports.

Tables are never changed in place: every operation takes tables and gives the new ones, which a sink or a micro-batch writes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import text as T
from stratalens.operators.catalog import decisions, latest, upsert

# The version of caches that is read, and the files whose change a lazy look asks for.
CACHE_VERSION = "1.0"
TOP_LEVEL = ["package.json", "Cargo.toml", "go.mod", "pom.xml", "CMakeLists.txt", "requirements.txt", "AndroidManifest.xml"]


def cache_validity(caches: DataFrame, cached: DataFrame, current: DataFrame, git: DataFrame, now: Column, ttl: int = 86_400, quick: bool = False, lazy: bool = True) -> DataFrame:
    """Whether a project's cache (project, version, stamp, last_commit; no row or no stamp: none) still holds, by the first reason that
    applies: missing, version, expired; then, with `quick`, valid; with `lazy`, valid where no top-level file changed; files changed;
    uncommitted changes; new commits. `cached` and `current`: (project, path, hash); `git`: (project, has_changes, last_commit).
    Gives project, is_valid, needs_update, reason, lazy_skip and the changed files in order."""
    both = current.alias("n").join(cached.alias("o"), ["project", "path"], "left")
    moved = both.filter(~F.col("n.hash").eqNullSafe(F.col("o.hash"))).groupBy("project").agg(F.sort_array(F.collect_list("path")).alias("files"))
    every = git.select("project", "has_changes", F.col("last_commit").alias("head")).join(caches, "project", "left").join(moved, "project", "left")
    none = F.array().cast("array<string>")
    every = every.withColumn("files", F.coalesce("files", none))
    old = F.col("stamp") + F.make_dt_interval(secs=F.lit(float(ttl))) < now
    top = F.arrays_overlap("files", F.array(*[F.lit(x) for x in TOP_LEVEL]))
    reason = F.when(F.col("stamp").isNull(), "missing").when(F.col("version") != CACHE_VERSION, "version").when(old, "expired")
    if quick:
        reason = reason.otherwise("valid")
    else:
        if lazy:
            reason = reason.when(~top, "lazy")
        reason = reason.when(F.size("files") > 0, "files").when(F.col("has_changes"), "uncommitted").when(~F.col("head").eqNullSafe(F.col("last_commit")), "commits").otherwise("valid")
    out = every.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isin("valid", "lazy"))
    return out.select("project", "is_valid", (~F.col("is_valid")).alias("needs_update"), F.when(F.col("reason") == "lazy", "valid").otherwise(F.col("reason")).alias("reason"), (F.col("reason") == "lazy").alias("lazy_skip"), F.when(F.col("reason") == "files", F.col("files")).otherwise(none).alias("changed"))


def update_hashes(cached: DataFrame, changed: DataFrame, current: DataFrame) -> DataFrame:
    """Hashes (path, hash) after changes (path): those of changed files anew, deleted ones gone, others as they were."""
    return cached.join(changed.select("path").distinct(), "path", "left_anti").unionByName(current.join(changed.select("path"), "path", "left_semi").select("path", "hash"))


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those of `gone`: deletion, and its cascade on every table that refers to the key."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    return {name: without(table, gone, key) for name, table in tables.items()}


def set_fields(table: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Partial updates: every column of `changes` (key, some others) that isn't null replaces the table's. Of several changes of one key
    each column takes its last value by `order` (the largest one without an order), so every row of the table stays one row."""
    fields = [c for c in changes.columns if c not in (key, order)]
    last = (lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c)))) if order else F.max
    changes = changes.groupBy(key).agg(*[last(c).alias(c) for c in fields])
    both = table.join(changes.select(key, *[F.col(c).alias(f"new_{c}") for c in fields]), key, "left")
    return both.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in fields else c for c in table.columns])


def grant(acl: DataFrame, grants: DataFrame, roles: DataFrame) -> DataFrame:
    """Access entries (user_id, resource_type, resource_id, role, ts) after grants: the last grant of a user on a resource replaces what
    they had; grants of unknown roles (role) count for nothing."""
    keys = ["user_id", "resource_type", "resource_id"]
    known = latest(grants.join(roles.select("role").distinct(), "role", "left_semi"), keys, [F.desc("ts"), F.desc("role")])
    return upsert(acl, known.select(*acl.columns), keys)


def revoke(acl: DataFrame, revoked: DataFrame) -> DataFrame:
    keys = ["user_id", "resource_type", "resource_id"]
    return acl.join(revoked.select(*keys).distinct(), keys, "left_anti")


def accessible(users: DataFrame, resources: DataFrame, members: DataFrame, grants: DataFrame, role_permissions: DataFrame, action: str = "read") -> DataFrame:
    """Resources on which users may act: user_id, resource_id. Candidates come from ownership, grants and team membership, so users aren't
    paired with resources that nothing joins them to. What is public anyone may read: one row a resource, whose null user_id stands
    for every user, also those who have a row of their own."""
    pick = lambda df: df.select("user_id", "resource_id")
    owned = pick(resources.join(users.select(F.col("user_id").alias("owner")), "owner").withColumn("user_id", F.col("owner")))
    granted = pick(grants.join(users, "user_id", "left_semi"))
    shared = pick(members.join(users, "user_id", "left_semi").join(resources, "team"))
    asked = owned.unionByName(granted).unionByName(shared).distinct().withColumn("action", F.lit(action))
    own = decisions(asked, resources, members, grants, role_permissions).filter("allowed").select("user_id", "resource_id")
    if action != "read":
        return own
    return own.unionByName(resources.filter("visibility = 'public'").select(F.lit(None).cast(dict(users.dtypes)["user_id"]).alias("user_id"), "resource_id").distinct())


def export_access(acl: DataFrame) -> DataFrame:
    """Access entries as JSON lines: entry."""
    return acl.select(F.to_json(F.struct(*sorted(acl.columns))).alias("entry"))


def import_access(lines: DataFrame, schema: str) -> DataFrame:
    """Access entries from JSON lines (entry); what can't be read is left out."""
    return lines.select(F.from_json("entry", schema).alias("e")).filter("e is not null").select("e.*")


def pending(edits: DataFrame) -> DataFrame:
    return edits.filter("status = 'pending'")


def linked(links: DataFrame, more: DataFrame, less: DataFrame) -> DataFrame:
    """Links (qa_id, issue) after additions and removals, each once."""
    return links.unionByName(more).distinct().join(less, ["qa_id", "issue"], "left_anti")


def issues_of_files(references: DataFrame, qa_files: DataFrame, links: DataFrame) -> DataFrame:
    """Issues of files: those that their text speaks of (path, issue), and those linked to entries (qa_id, issue) about them (qa_id,
    path): path, issue."""
    return references.select("path", "issue").unionByName(qa_files.join(links, "qa_id").select("path", "issue")).distinct()


def for_review(links: DataFrame, statuses: DataFrame) -> DataFrame:
    """Entries with a link to a closed issue (issue, status): qa_id."""
    return links.join(statuses.filter("status = 'closed'"), "issue", "left_semi").select("qa_id").distinct()


def outdated(merges: DataFrame, refs: DataFrame) -> DataFrame:
    """Entries that merges (commit, path) put out of date through the files they are about (qa_id, path): commit, files, qa_ids."""
    files = merges.groupBy("commit").agg(F.count_distinct("path").alias("files"))
    stale = merges.join(refs, "path").groupBy("commit").agg(F.sort_array(F.collect_set("qa_id")).alias("qa_ids"))
    return files.join(stale, "commit", "left").select("commit", "files", F.coalesce("qa_ids", F.array().cast("array<string>")).alias("qa_ids"))


def by_structure(names: DataFrame, refs: DataFrame, k: int = 5, most: int = 5) -> DataFrame:
    """Entries for files by their imports and functions (file, position, name; the first `most` count): the first entry (qa_id, path,
    place) of every path that holds a name, in the order of positions and paths, k for each file at 0.5: file, qa_id, score.

    Paths are cut into the words of names, so a name meets the paths that have it as a word."""
    first = refs.groupBy("path").agg(F.min_by("qa_id", "place").alias("qa_id"))
    words = first.select("path", "qa_id", F.explode(F.array_distinct(F.regexp_extract_all("path", F.lit(r"[A-Za-z0-9_]+"), F.lit(0)))).alias("name"))
    hits = names.filter(F.col("position") <= most).join(words, "name").groupBy("file", "qa_id").agg(F.min(F.struct("position", "path")).alias("at"))
    w = Window.partitionBy("file").orderBy("at", "qa_id")
    return hits.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("file", "qa_id", F.lit(0.5).alias("score"))


def features(modules: DataFrame, asked: str) -> DataFrame:
    """Modules (name, description) whose name or description holds a feature."""
    low = F.lit(asked.lower())
    return modules.filter(F.contains(F.lower("name"), low) | F.contains(F.lower(F.coalesce("description", F.lit(""))), low))


def settings_without(settings: DataFrame, key: str) -> DataFrame:
    """Settings (key, value; dotted keys) without a key and all below it."""
    return settings.filter((F.col("key") != key) & ~F.col("key").startswith(key + "."))


def validated(values: DataFrame, variables: DataFrame) -> DataFrame:
    """Checks of template values (template_id, kind, name, value) against the variables declared for their kind of template (kind, name,
    type, required, allowed, pattern): template_id, errors (missing), warnings (not a number, boolean, allowed value or match), each in order, and valid."""
    ids = values.select("template_id", "kind").distinct()
    both = ids.join(variables.select("kind", "name", "type", "required", "allowed", "pattern"), "kind").join(values.drop("kind"), ["template_id", "name"], "left")
    v = F.col("value")
    error = F.when(F.col("required") & v.isNull(), F.concat(F.lit("missing "), "name"))
    wrong = F.when(v.isNull(), None).when((F.col("type") == "number") & v.try_cast("double").isNull(), "number").when((F.col("type") == "boolean") & ~F.lower(v).isin("true", "false", "1", "0"), "boolean").when((F.col("type") == "enum") & ~F.array_contains("allowed", v), "enum")
    match = F.when(v.isNotNull() & F.col("pattern").isNotNull() & ~F.regexp_like(v, F.concat(F.lit("^(?:"), "pattern", F.lit(")"))), "pattern")
    warnings = F.filter(F.array(wrong, match), lambda x: x.isNotNull())
    each = both.select("template_id", error.alias("e"), F.transform(warnings, lambda x: F.concat("name", F.lit(" "), x)).alias("w"))
    out = each.groupBy("template_id").agg(F.sort_array(F.collect_list("e")).alias("errors"), F.sort_array(F.flatten(F.collect_list("w"))).alias("warnings"))
    return out.withColumn("valid", F.size("errors") == 0)


def inherited(templates: DataFrame) -> DataFrame:
    """Templates (name, parent, text) with the blocks of their parent replaced by their own: name, text. A block is
    {% block x %}...{% endblock %}; a template without parent keeps its text. One step: parents come resolved."""
    block = r"(?s)\{%\s*block\s+(\w+)\s*%\}(.*?)\{%\s*endblock\s*%\}"
    names, bodies = F.regexp_extract_all("text", F.lit(block), F.lit(1)), F.regexp_extract_all("text", F.lit(block), F.lit(2))
    own = templates.withColumn("own", F.map_from_arrays(F.array_distinct(names), F.transform(F.array_distinct(names), lambda n: F.get(bodies, (F.array_position(names, n) - 1).cast("int")))))
    both = own.join(templates.select(F.col("name").alias("parent"), F.col("text").alias("base")), "parent", "left")
    # Pieces between blocks alternate with the blocks themselves.
    outer = F.split("base", block, -1)
    base_names, base_bodies = F.regexp_extract_all("base", F.lit(block), F.lit(1)), F.regexp_extract_all("base", F.lit(block), F.lit(2))
    filled = F.zip_with(base_names, base_bodies, lambda n, b: F.coalesce(F.try_element_at("own", n), b))
    text = F.array_join(F.flatten(F.zip_with(outer, filled, lambda o, f: F.array(F.coalesce(o, F.lit("")), F.coalesce(f, F.lit(""))))), "")
    return both.select("name", F.when(F.col("base").isNull(), F.col("text")).otherwise(text).alias("text"))


def template_types(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Template types of projects (project, path) by rules (type, priority, pattern): 1 for a glob, 1.5 for a file, 1.2 for a folder; the
    sum times (1 + priority / 100): project, type, score. Rules are a small table, and globs become name suffixes '*.x'."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    pick = lambda df, s: df.select("project", "type", "priority", "pattern", F.lit(s).alias("s"))
    table = F.broadcast(rules)
    exact = pick(files.join(table, F.col("path") == F.col("pattern")), 1.5)
    suffix = pick(files.withColumn("end", F.concat(F.lit("*"), F.regexp_extract("path", r"(\.[^./]+)$", 1))).join(table, F.col("end") == F.col("pattern")), 1.0)
    inside = files.filter(F.size(parts) > 1).select("project", F.explode(folders).alias("folder")).distinct()
    folder = pick(inside.join(table, F.col("folder") == F.rtrim(F.col("pattern"), F.lit("/"))), 1.2)
    best = exact.unionByName(suffix).unionByName(folder).groupBy("project", "type", "priority", "pattern").agg(F.max("s").alias("s"))
    return best.groupBy("project", "type", "priority").agg(F.sum("s").alias("s")).select("project", "type", F.round(F.col("s") * (1 + F.col("priority") / 100.0), 6).alias("score"))


def sequence_diagram(calls: DataFrame, key: str) -> DataFrame:
    """A sequence diagram of the calls (key, position, caller, callee, method, line) of each chain: key, text."""
    who = F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array("caller", "callee")))))
    arrow = F.concat(F.lit("    "), T.diagram_id(F.col("caller")), F.lit("-->>"), T.diagram_id(F.col("callee")), F.lit(" : "), "method", F.when(F.col("line").isNotNull(), F.concat(F.lit(" (L"), F.col("line").cast("string"), F.lit(")"))).otherwise(""))
    by = calls.groupBy(key).agg(who.alias("who"), F.sort_array(F.collect_list(F.struct("position", arrow.alias("t")))).alias("calls"))
    people = F.transform("who", lambda p: F.concat(F.lit("    participant "), T.diagram_id(p), F.lit(" as "), p))
    return by.select(key, F.array_join(F.concat(F.array(F.lit("sequenceDiagram")), people, F.transform("calls", lambda c: c["t"])), "\n").alias("text"))


def state_diagram(moves: DataFrame, key: str) -> DataFrame:
    """A state diagram of the moves (key, position, src, dst, event) of each machine: key, text."""
    line = F.concat(F.lit("    "), "src", F.lit(" --> "), "dst", F.when(F.coalesce("event", F.lit("")) != "", F.concat(F.lit(" : "), "event")).otherwise(""))
    by = moves.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", line.alias("t")))).alias("l"))
    return by.select(key, F.array_join(F.concat(F.array(F.lit("stateDiagram-v2")), F.transform("l", lambda x: x["t"])), "\n").alias("text"))


def class_diagram(classes: DataFrame, key: str) -> DataFrame:
    """A class diagram of the classes (key, name, base or null) of each file: key, text."""
    lines = F.concat(F.lit("    class "), "name", F.lit(" {\n    }"), F.when(F.col("base").isNotNull(), F.concat(F.lit("\n    "), "base", F.lit(" <|-- "), "name")).otherwise(""))
    by = classes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("name", lines.alias("t")))).alias("l"))
    return by.select(key, F.array_join(F.concat(F.array(F.lit("classDiagram")), F.transform("l", lambda x: x["t"])), "\n").alias("text"))


def entity_diagram(fields: DataFrame, key: str) -> DataFrame:
    """An entity diagram of the fields (key, entity, position, field, type) of each model: key, text."""
    by = fields.groupBy(key, "entity").agg(F.sort_array(F.collect_list(F.struct("position", F.concat(F.lit("        "), "type", F.lit(" "), "field").alias("t")))).alias("f"))
    block = F.concat(F.lit("    "), "entity", F.lit(" {\n"), F.array_join(F.transform("f", lambda x: x["t"]), "\n"), F.lit("\n    }"))
    whole = by.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("entity", block.alias("t")))).alias("e"))
    return whole.select(key, F.array_join(F.concat(F.array(F.lit("erDiagram")), F.transform("e", lambda x: x["t"])), "\n").alias("text"))


def request_report(requests: DataFrame, findings: DataFrame, form: str = "markdown") -> DataFrame:
    """Reports of change requests (pr, title) with their findings (pr, path, finding, severity): pr, text, as markdown, html or json."""
    by = findings.groupBy("pr").agg(F.sort_array(F.collect_list(F.struct("path", "finding", "severity"))).alias("f"))
    both = requests.join(by, "pr", "left").withColumn("f", F.coalesce("f", F.array().cast("array<struct<path:string,finding:string,severity:string>>")))
    if form == "json":
        return both.select("pr", F.to_json(F.struct("title", F.col("f").alias("findings"))).alias("text"))
    row = {"markdown": lambda x: F.concat(F.lit("- **"), x["severity"], F.lit("** `"), x["path"], F.lit("`: "), x["finding"]), "html": lambda x: F.concat(F.lit("<li><b>"), x["severity"], F.lit("</b> <code>"), x["path"], F.lit("</code>: "), x["finding"], F.lit("</li>"))}[form]
    body = F.array_join(F.transform("f", row), "\n")
    text = F.concat(F.lit("# "), "title", F.lit("\n\n"), body) if form == "markdown" else F.concat(F.lit("<h1>"), "title", F.lit("</h1>\n<ul>\n"), body, F.lit("\n</ul>"))
    return both.select("pr", text.alias("text"))


def task_report(tasks: DataFrame) -> DataFrame:
    """Markdown of the tasks (type, path, line, text) of each type: type, text."""
    row = F.concat(F.lit("- `"), "path", F.lit(":"), F.col("line").cast("string"), F.lit("` "), "text")
    by = tasks.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("path", "line", row.alias("t")))).alias("l"))
    return by.select("type", F.concat(F.lit("## "), "type", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("text"))


def overview(types: DataFrame, sizes: DataFrame, entries: DataFrame) -> DataFrame:
    """A document for each project from its types (project, type, rank), sizes (project, files, scale) and entry points (project,
    path): project, text."""
    kinds = types.groupBy("project").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "type"))), lambda x: x["type"]), ", ").alias("kinds"))
    starts = entries.groupBy("project").agg(F.array_join(F.transform(F.sort_array(F.collect_set("path")), lambda x: F.concat(F.lit("- "), x)), "\n").alias("starts"))
    both = sizes.join(kinds, "project", "left").join(starts, "project", "left")
    parts = [F.lit("# "), F.col("project"), F.lit("\n\n- types: "), F.coalesce("kinds", F.lit("unknown")), F.lit("\n- scale: "), F.col("scale"), F.lit(" ("), F.col("files").cast("string"), F.lit(" files)\n\n## Entry points\n\n"), F.coalesce("starts", F.lit("none"))]
    return both.select("project", F.concat(*parts).alias("text"))


def credentials_right(users: DataFrame, tries: DataFrame) -> DataFrame:
    """Whether passwords (try_id, user_id, password) have the stored SHA-256 digest (user_id, password_hash): try_id, right. Users that
    aren't known, and null passwords, are wrong."""
    both = tries.join(users.select("user_id", "password_hash"), "user_id", "left")
    return both.select("try_id", F.coalesce(F.sha2("password", 256) == F.col("password_hash"), F.lit(False)).alias("right"))


def union_all(tables: list[DataFrame]) -> DataFrame:
    """All rows of several change lists, repeated ones too."""
    return reduce(lambda a, b: a.unionByName(b), tables)
