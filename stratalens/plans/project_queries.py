"""Projects, files and assistance."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import assist as A
from stratalens.operators import project as J
from stratalens.operators import code as K
from stratalens.operators import facts, scan, search
from stratalens.plans.code_queries import FUNCTIONS, LINES
from stratalens.registry import query, sql_values
from stratalens.sources import files as S
from stratalens.sources.corpus import FILES, MANIFESTS
from stratalens.sources.tables import QA_PAIRS_SQL, audit, qa_pairs, table

ALL = FILES + MANIFESTS
SRC = sql_values([(p.split("/")[0], p, c) for p, c in ALL], ["project", "path", "content"])
NAME = "regexp_extract(path, '([^/]+)$', 1)"


def _all(spark):
    return spark.createDataFrame([(p.split("/")[0], p, c) for p, c in ALL], "project string, path string, content string")


@query(f"SELECT folder, count(*) AS n_files FROM (SELECT unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS folder FROM {SRC}) GROUP BY folder")
def q_folders(spark, sf_dir):
    return S.folders(_all(spark))


@query(f"SELECT path FROM {SRC} WHERE NOT list_has_any(string_split(path, '/'), ['web']) AND NOT regexp_matches({NAME}, '\\.lock$') AND len(string_split(path, '/')) - 1 <= 1")
def q_kept_files(spark, sf_dir):
    return S.kept(_all(spark), ["web"], ["*.lock"], 1).select("path")


@query(f"SELECT path FROM {SRC} WHERE {NAME} IN ('.env') OR regexp_matches({NAME}, '^\\.env\\.')")
def q_secret_files(spark, sf_dir):
    return S.secret_files(_all(spark))


@query(f"SELECT e AS extension, (SELECT count(*) FROM {SRC} WHERE ends_with(path, e)) AS n FROM (SELECT unnest(['.py', '.ts', '.test.ts', '.rb']) AS e)")
def q_count_extensions(spark, sf_dir):
    return S.count_extensions(_all(spark), [".py", ".ts", ".test.ts", ".rb"])


LOG = [(1, "a1|a|ana|2024-01-01|first"), (2, "b2|b|bo|2024-01-02|fix a|b test"), (3, "c3|c|ana|2024-01-03|third"), (4, "broken")]


@query(f"SELECT id, p[1] AS hash, p[2] AS short, p[3] AS author, p[4] AS date, substr(line, length(p[1]) + length(p[2]) + length(p[3]) + length(p[4]) + 5) AS subject FROM (SELECT id, line, string_split(line, '|') AS p FROM {sql_values(LOG, ['id', 'line'])}) WHERE len(p) >= 5")
def q_commits(spark, sf_dir):
    return S.commits(spark.createDataFrame(LOG, "id int, line string"))


@query(f"SELECT split_part(line, '|', 3) AS author, count(*) AS n FROM {sql_values(LOG, ['id', 'line'])} WHERE contains(line, '|') GROUP BY 1")
def q_git_contributors(spark, sf_dir):
    return S.contributors(spark.createDataFrame(LOG, "id int, line string"))


STAT = [(1, " 3 files changed, 10 insertions(+), 2 deletions(-)"), (2, " 1 file changed, 1 deletion(-)"), (3, "")]


@query(f"SELECT id, coalesce(TRY_CAST(regexp_extract(line, '(\\d+) file', 1) AS INTEGER), 0) AS files, coalesce(TRY_CAST(regexp_extract(line, '(\\d+) insertion', 1) AS INTEGER), 0) AS insertions, coalesce(TRY_CAST(regexp_extract(line, '(\\d+) deletion', 1) AS INTEGER), 0) AS deletions FROM {sql_values(STAT, ['id', 'line'])}")
def q_short_stat(spark, sf_dir):
    return S.short_stat(spark.createDataFrame(STAT, "id int, line string"))


BLAME = [("f", 1, "abc 1 1 2"), ("f", 2, "author ana"), ("f", 3, "\tx = 1"), ("f", 4, "def 2 2"), ("f", 5, "author bo"), ("f", 6, "\ty = 2"), ("f", 7, "abc 3 3"), ("f", 8, "author ana"), ("f", 9, "\tz = 3")]


@query(f"""SELECT file, row_number() OVER (PARTITION BY file ORDER BY n) AS line, author, substr(line, 2) AS code FROM (SELECT file, n, line, last_value(CASE WHEN starts_with(line, 'author ') THEN substr(line, 8) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY n) AS author FROM {sql_values(BLAME, ['file', 'n', 'line'])}) WHERE starts_with(line, chr(9))""")
def q_blame(spark, sf_dir):
    return S.blame(spark.createDataFrame(BLAME, "file string, n int, line string"))


BRANCHES = [("main",), ("dev",), ("remotes/origin/main",)]


@query(f"SELECT CASE WHEN starts_with(name, 'remotes/') THEN 'remote' ELSE 'local' END AS kind, list_sort(list(regexp_replace(name, '^remotes/', ''))) AS names FROM {sql_values(BRANCHES, ['name'])} GROUP BY 1")
def q_branches(spark, sf_dir):
    return S.branches(spark.createDataFrame(BRANCHES, "name string"))


CHANGES = [("r1", "src/routes/user.ts"), ("r1", "package.json"), ("r1", "web/package.json"), ("r2", "docs/README.md"), ("r2", "src/core/run.py"), ("r2", "main.go"), ("r3", "CHANGELOG"), ("r4", "img/logo.png"), ("r5", ".py")]
_CALLS = f"""(SELECT repo, path, CASE WHEN regexp_matches(lower(path), 'api|controller|route') THEN 'api_modified/high/interfaces' WHEN path IN ('package.json', 'requirements.txt', 'pom.xml', 'build.gradle', 'CMakeLists.txt') THEN 'config_changed/medium/configuration' WHEN regexp_matches(lower(path), 'readme|changelog') THEN 'structure_changed/low/overview'
  WHEN regexp_matches(lower(path), '[^/.]\\.(py|js|ts|java|go|rs|c|cpp)$') THEN 'module_modified/medium/module ' || CASE WHEN contains(path, '/') THEN string_split(path, '/')[-2] ELSE 'root' END END AS r FROM {sql_values(CHANGES, ['repo', 'path'])})"""


@query(f"SELECT path, split_part(r, '/', 1) AS type, split_part(r, '/', 2) AS priority, split_part(r, '/', 3) AS section FROM {_CALLS} WHERE r IS NOT NULL")
def q_document_changes(spark, sf_dir):
    return J.document_changes(spark.createDataFrame(CHANGES, "repo string, path string"))


@query(f"""SELECT *, CASE WHEN high > 0 THEN 'need_update' WHEN medium > 0 THEN 'suggest_update' WHEN low > 0 THEN 'minor_update' ELSE 'synced' END AS status FROM (SELECT repo, count(*) AS changed, count(*) FILTER (split_part(r, '/', 2) = 'high') AS high, count(*) FILTER (split_part(r, '/', 2) = 'medium') AS medium, count(*) FILTER (split_part(r, '/', 2) = 'low') AS low FROM {_CALLS} GROUP BY repo)""")
def q_document_status(spark, sf_dir):
    return J.document_status(spark.createDataFrame(CHANGES, "repo string, path string"))


IDL = [("ipc/ICamera.aidl", "interface ICamera {\n  void open(int id);\n  int frames();\n}"), ("ipc/log.proto", "service Logger {\n  rpc Write(Line) returns (Ok);\n  rpc Flush(Ok) returns (Ok);\n}"), ("cam/main.c", "ICamera c; open(c);"), ("log/main.cc", "Logger l; ICamera c;"), ("lib/util.c", "Logger l;")]
_IDL = sql_values(IDL, ["path", "content"])
_METHODS = f"""(SELECT path, protocol, regexp_extract(b, '(?:interface|service)\\s+(\\w+)', 1) AS interface, unnest(CASE protocol WHEN 'aidl' THEN regexp_extract_all(b, '(\\w+)\\s*\\([^)]*\\)\\s*;', 1) ELSE regexp_extract_all(b, 'rpc\\s+(\\w+)', 1) END) AS method FROM (
  SELECT path, 'aidl' AS protocol, unnest(regexp_extract_all(content, 'interface\\s+\\w+\\s*\\{{[^}}]*\\}}')) AS b FROM {_IDL} WHERE ends_with(path, '.aidl') UNION ALL SELECT path, 'grpc', unnest(regexp_extract_all(content, 'service\\s+\\w+\\s*\\{{[^}}]*\\}}')) FROM {_IDL} WHERE ends_with(path, '.proto')))"""


@query(f"SELECT * FROM {_METHODS}")
def q_interfaces(spark, sf_dir):
    return J.interfaces(spark.createDataFrame(IDL, "path string, content string"))


@query(f"SELECT DISTINCT split_part(f.path, '/', 1) AS process, m.interface FROM {_IDL.replace('AS t(', 'AS f(')}, {_METHODS} m WHERE regexp_matches(f.path, '/main\\.') AND list_contains(regexp_extract_all(f.content, '\\w+'), m.interface)")
def q_communication(spark, sf_dir):
    files = spark.createDataFrame(IDL, "path string, content string")
    return J.communication(files, J.interfaces(files))


REPOS = [("core",), ("web",), ("api-core",)]
DEPS = [("web", "core", "1.0"), ("web", "@acme/api-core", "2.0"), ("core", "left-pad", "1.3"), ("api-core", "core", "workspace:*")]


@query(f"""SELECT DISTINCT d.repo AS src, r.repo AS dst, how FROM {sql_values(DEPS, ['repo', 'name', 'version']).replace('AS t(', 'AS d(')}, {sql_values(REPOS, ['repo']).replace('AS t(', 'AS r(')}, (SELECT unnest(['name', 'local']) AS how) WHERE (how = 'name' AND contains(d.name, r.repo) AND d.repo <> r.repo) OR (how = 'local' AND regexp_matches(d.version, '^(file|link|workspace):') AND d.name = r.repo)""")
def q_cross_dependencies(spark, sf_dir):
    return J.cross_dependencies(spark.createDataFrame(REPOS, "repo string"), spark.createDataFrame(DEPS, "repo string, name string, version string"))


@query(f"""SELECT id, score FROM (SELECT qa_id AS id, CASE WHEN contains(lower(question), 'the') THEN 10 ELSE 0 END + CASE WHEN contains(lower(answer), 'the') THEN 5 ELSE 0 END + CASE WHEN conv_id % 5 = 0 THEN 8 ELSE 0 END AS score FROM {QA_PAIRS_SQL}) WHERE score > 0 ORDER BY score DESC, id LIMIT 20""")
def q_team_search(spark, sf_dir):
    """Every fifth conversation is tagged 'the'."""
    entries = qa_pairs(table(spark, sf_dir, "conversations")).select(F.col("qa_id").alias("id"), "question", "answer", F.when(F.col("conv_id") % 5 == 0, F.array(F.lit("the"))).otherwise(F.array(F.lit("x"))).alias("tags"))
    return A.team_search(entries, "the")


_COMP = "(SELECT lower(substr(p_name, 1, 5)) AS text, CASE p_size % 2 WHEN 0 THEN 'function' ELSE 'class' END AS kind, (p_size % 10) / 10.0 AS score, p_partkey AS source FROM part)"


@query(f"SELECT text, kind, score FROM (SELECT *, row_number() OVER (PARTITION BY text, kind ORDER BY source, score DESC) AS r FROM {_COMP}) WHERE r = 1 ORDER BY score DESC, text, kind LIMIT 30")
def q_completions(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.lower(F.substring("p_name", 1, 5)).alias("text"), F.when(F.col("p_size") % 2 == 0, "function").otherwise("class").alias("kind"), ((F.col("p_size") % 10) / 10.0).alias("score"), F.col("p_partkey").alias("source"))
    return A.completions(rows)


@query("SELECT p_name AS name, CASE p_size % 2 WHEN 0 THEN 'function' ELSE 'class' END AS kind, CASE p_size % 2 WHEN 0 THEN 0.7 ELSE 0.65 END AS score FROM part WHERE starts_with(p_name, substr((SELECT min(p_name) FROM part), 1, 3)) ORDER BY score DESC, name, kind LIMIT 50")
def q_prefix_completions(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "function").otherwise("class").alias("kind"))
    return A.prefix_completions(part, part.agg(F.min("name")).first()[0][:3])


@query("WITH n AS (SELECT DISTINCT p_brand AS name FROM part), a AS (SELECT unnest(['Brand#11', '#2', 'none']) AS ask) SELECT ask, name FROM a, n WHERE ask = name OR (NOT EXISTS (SELECT 1 FROM n m WHERE m.name = ask) AND contains(lower(name), lower(ask)))")
def q_find_name(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"))
    return A.find_name(names, spark.createDataFrame([("Brand#11",), ("#2",), ("none",)], "ask string"))


REFS = [(1, "src/app/main.py"), (2, "web/main.ts"), (3, "src/app/store.py"), (4, "svc/main_test.go")]
USES = [(1, 3), (2, 30)]
_REF = sql_values(REFS, ["qa_id", "path"])


@query(f"""WITH f AS (SELECT unnest(['src/app/main.py', 'web/index.js']) AS file), s AS (SELECT file, r.qa_id, 0.8 + least(coalesce(u.n, 0) * 0.02, 0.2) AS score FROM f JOIN {_REF.replace('AS t(', 'AS r(')} ON file = path LEFT JOIN {sql_values(USES, ['qa_id', 'n']).replace('AS t(', 'AS u(')} USING (qa_id)
  UNION ALL SELECT file, qa_id, 0.6 FROM f JOIN {_REF} ON regexp_extract(file, '([^/.]+)[^/]*$', 1) = regexp_extract(path, '([^/.]+)[^/]*$', 1) AND file <> path) SELECT file, qa_id, max(score) AS score FROM s GROUP BY file, qa_id""")
def q_recommend_for_file(spark, sf_dir):
    files = spark.createDataFrame([("src/app/main.py",), ("web/index.js",)], "file string")
    return A.for_file(spark.createDataFrame(REFS, "qa_id int, path string"), spark.createDataFrame(USES, "qa_id int, n int"), files)


@query("SELECT l_orderkey AS id, list_filter([CASE WHEN sum(l_quantity) * 10 > 1000 THEN 'large change' END, CASE WHEN count(*) * 5 > 20 THEN 'many files' END], lambda x: x IS NOT NULL) AS warnings FROM lineitem GROUP BY l_orderkey")
def q_request_warnings(spark, sf_dir):
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.sum("l_quantity") * 10).alias("additions"), F.lit(0).alias("deletions"), (F.count(F.lit(1)) * 5).alias("files"))
    return A.request_warnings(by)


@query("SELECT id, size FROM (SELECT doc_id AS id, n_chars AS size, sum(n_chars) OVER (ORDER BY doc_id % 3 DESC, doc_id % 50 DESC, doc_id ROWS UNBOUNDED PRECEDING) AS kept FROM documents) WHERE kept > 500000")
def q_evict(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).alias("priority"), (F.col("doc_id") % 50).alias("last_access"), F.col("n_chars").alias("size"))
    return A.evict(rows, "size", 500_000)


_W = "list_distinct(list_filter(string_split_regex(lower(trim({})), '\\s+'), lambda x: x <> ''))".format


@query(f"""SELECT id, ts, score FROM (SELECT c.conv_id * 1000 + c.turn AS id, c.turn AS ts, round(len(list_intersect({_W('c.text')}, {_W('a.text')})) / CAST(len(list_distinct(list_concat({_W('c.text')}, {_W('a.text')}))) AS DOUBLE), 6) AS score
  FROM conversations c, (SELECT text FROM conversations ORDER BY conv_id, turn LIMIT 1) a) WHERE score > 0.5 ORDER BY ts DESC, id LIMIT 5""")
def q_similar_queries(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    asked = rows.orderBy("conv_id", "turn").first().text
    return A.similar_queries(rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("query"), F.col("turn").alias("ts")), asked)


@query(f"""SELECT 'file' AS kind, path AS name, path, 1.0 AS score FROM {SRC} WHERE contains(lower(path), 'main') UNION ALL SELECT 'function', name, path, 0.9 FROM {FUNCTIONS} WHERE contains(lower(name), 'main')
UNION ALL SELECT 'class', regexp_extract(content, 'class\\s+(\\w+)', 1), path, 0.9 FROM {LINES} WHERE regexp_matches(content, '^\\s*(public\\s+)?class\\s+\\w*[Mm]ain')""")
def q_path_search(spark, sf_dir):
    files = _all(spark)
    names = K.functions(files).select(F.lit("function").alias("kind"), "name", "path").unionByName(facts.declarations(files).select("kind", "name", "path"))
    return search.path_search(files, names, "main")


DIFFS = [(1, "+++ b/a.py\n+# TODO add\n-# TODO gone\n+x = 1\n+ FIXME now")]


@query(f"SELECT id, line, trim(substr(content, 2)) AS task FROM (SELECT id, unnest(string_split(diff, chr(10))) AS content, generate_subscripts(string_split(diff, chr(10)), 1) AS line FROM {sql_values(DIFFS, ['id', 'diff'])}) WHERE starts_with(content, '+') AND NOT starts_with(content, '+++') AND regexp_matches(content, 'TODO|FIXME')")
def q_added_tasks(spark, sf_dir):
    return scan.added_tasks(spark.createDataFrame(DIFFS, "id int, diff string"), "id", "diff")


@query("SELECT event_id, CASE level WHEN 'ERROR' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END >= 2 AS logged FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' THEN 'WARNING' ELSE 'INFO' END AS level FROM events)")
def q_level_gate(spark, sf_dir):
    weight = F.when(F.col("level") == "ERROR", 3).when(F.col("level") == "WARNING", 2).otherwise(1)
    return audit(table(spark, sf_dir, "events")).select("event_id", (weight >= 2).alias("logged"))


@query("SELECT doc_id, len(string_split(text, ' ')) * length(lang) * 100 * 0.3 AS estimate, sha256(source) AS source_hash FROM documents")
def q_size_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.size(F.split("text", " ")) * F.length("lang") * 100 * 0.3).alias("estimate"), F.sha2("source", 256).alias("source_hash"))


@query("SELECT conv_id, list_sort(list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]+')))))[1:5] AS words FROM conversations GROUP BY conv_id")
def q_first_words(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    return rows.groupBy("conv_id").agg(F.slice(F.sort_array(F.collect_set("w")), 1, 5).alias("words"))
