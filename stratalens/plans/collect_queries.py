"""Whole-project facts, index levels, audit rows and analyzers."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import collect as C
from stratalens.operators import detect as D
from stratalens.plans.code_queries import FUNCTIONS
from stratalens.plans.detect_queries import _TYPES, NAME, SRC
from stratalens.registry import query, sql_values
from stratalens.sources.corpus import FILES, MANIFESTS, PROJECTS
from stratalens.sources.tables import table

PATHS = [(p,) for p, _ in FILES + MANIFESTS] + [("a/.env",), ("b.PY",), ("img.png",), ("Makefile",)]


def _projects(spark):
    return spark.createDataFrame(PROJECTS, "project string, path string, content string")


@query(f"SELECT path FROM {sql_values(PATHS, ['path'])} WHERE regexp_matches(lower(path), '[^/]\\.(py|js|jsx|tsx?|java|kt|c|cpp|h|hpp|cc|go|rs|rb|php|json|ya?ml|xml|toml|ini|conf|cfg|sh|md|txt|env|html|css)$')")
def q_scannable(spark, sf_dir):
    return C.scannable(spark.createDataFrame(PATHS, "path string"))


@query("SELECT conv_id, turn, regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g') AS question FROM conversations")
def q_graph_questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.normalized(F.col("text")).alias("question"))


XML = [(".repo/manifest.xml", '<manifest><remote name="r"/><project name="vendor/FreeRTOS" path="os/kernel" revision="v1"/><project name="tools/flash"/><project revision="x" name="n" path="drivers/usb"/></manifest>'), ("none.xml", None)]


@query("SELECT * FROM (VALUES ('.repo/manifest.xml', 'vendor/FreeRTOS', 'os/kernel', 'v1', 'unknown'), ('.repo/manifest.xml', 'tools/flash', 'tools/flash', '', 'tool'), ('.repo/manifest.xml', 'n', 'drivers/usb', 'x', 'driver')) AS t(manifest, name, path, revision, kind)")
def q_sub_projects(spark, sf_dir):
    return C.sub_projects(spark.createDataFrame(XML, "path string, content string"))


@query("SELECT path, commit, ts FROM (SELECT l_partkey AS path, l_orderkey AS commit, l_shipdate AS ts, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC) AS r FROM (SELECT DISTINCT l_partkey, l_orderkey, l_shipdate FROM lineitem) JOIN part ON p_partkey = l_partkey WHERE p_size > 40) WHERE r <= 10")
def q_file_history(spark, sf_dir):
    """Parts stand for files, their orders for commits."""
    item = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("commit"), F.col("l_shipdate").alias("ts")).distinct()
    return C.file_history(item, table(spark, sf_dir, "part").filter("p_size > 40").select(F.col("p_partkey").alias("path")))


@query("""SELECT c_nationkey AS repo, max(o_orderkey) FILTER (r = 1) AS last_commit, max(c_name) FILTER (r = 1) AS author, max(o_orderdate) AS at, count(*) AS commits, list_sort(list(DISTINCT c_mktsegment)) AS tags, any_value(n_name) AS remote
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey) GROUP BY c_nationkey""")
def q_repository_info(spark, sf_dir):
    """Nations stand for repositories, orders of their customers for commits."""
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    repo = F.col("c_nationkey").alias("repo")
    commits = both.select(repo, F.col("o_orderkey").alias("commit"), F.col("c_name").alias("author"), F.col("o_orderdate").alias("ts"))
    return C.repository_info(commits, both.select(repo, F.col("c_mktsegment").alias("tag")), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("repo"), F.col("n_name").alias("url")))


@query(f"""SELECT s.project, files, CASE WHEN s.project IN ('droid', 'car') THEN 'large' ELSE 'small' END AS scale, language, platform, coalesce(types, []) AS types, coalesce(entries, []) AS entries, coalesce(configs, []) AS configs, CASE s.project WHEN 'car' THEN ['hud', 'services', 'vehicle'] ELSE [] END AS subsystems, coalesce(processes, []) AS processes
FROM (SELECT project, count(*) AS files, list_sort(list(path) FILTER ({NAME} IN ('main.c', 'main.cpp', 'main.py', 'MainActivity.kt', 'main.tsx', 'app.js'))) AS entries, list_sort(list(path) FILTER (path IN ('build.gradle', 'CMakeLists.txt', 'package.json', 'requirements.txt', 'pyproject.toml', 'tsconfig.json') OR regexp_matches(path, '\\.(ioc|dts|dtsi)$'))) AS configs,
  list_sort(list(DISTINCT string_split(path, '/')[-2]) FILTER (regexp_matches(path, '/main\\.(cpp|c|py|go|rs)$'))) AS processes FROM {SRC} GROUP BY project) s LEFT JOIN (SELECT project, list(type ORDER BY rank) AS types FROM {_TYPES} GROUP BY project) t ON t.project = s.project
  JOIN (VALUES ('py', 'python', 'web'), ('droid', 'kotlin', 'android'), ('native', 'cpp', 'native'), ('web', 'typescript-react', 'web'), ('desk', 'javascript', 'desktop'), ('car', 'python', 'unknown'), ('board', NULL, 'embedded'), ('none', NULL, 'unknown')) AS p(project, language, platform) ON p.project = s.project""")
def q_project_facts(spark, sf_dir):
    return C.project_facts(_projects(spark))


@query("SELECT * FROM (VALUES ('py', 'web/backend.md'), ('droid', 'mobile/android.md'), ('native', 'system/native.md'), ('web', 'web/frontend.md'), ('desk', 'desktop/desktop.md'), ('board', 'embedded/linux.md')) AS t(project, document)")
def q_type_documents(spark, sf_dir):
    return C.type_documents(D.detect_types(_projects(spark)))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 120)) + len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, 'TODO|FIXME|XXX|HACK'))) > 0 AS smelly FROM documents")
def q_deep_index(spark, sf_dir):
    """Texts with long lines or open tasks have smells, at least so many."""
    from stratalens.operators import scan

    docs = table(spark, sf_dir, "documents")
    plain = scan.smells(docs).filter("smell <> 'magic_number'").select("doc_id").distinct().withColumn("found", F.lit(True))
    return C.deep_index(docs).join(plain, "doc_id", "left").select("doc_id", (F.coalesce("found", F.lit(False)) & (F.col("smells") > 0)).alias("smelly"))


def _quality_oracle() -> str:
    from stratalens.registry import ORACLE

    return f"SELECT source, count(*) AS files, round(avg(complexity), 4) AS complexity, round(avg(readability), 4) AS readability, round(avg(security), 4) AS security, round(avg(overall), 4) AS overall FROM ({ORACLE['q_quality']}) JOIN documents USING (doc_id) GROUP BY source"


@query(_quality_oracle())
def q_project_quality(spark, sf_dir):
    return C.project_quality(table(spark, sf_dir, "documents"))


@query("SELECT path || ':0' AS id, content, list_transform(range(0, 8), lambda i: CAST(CAST('0x' || substr(sha256(content), 1 + 8 * i, 8) AS BIGINT) AS DOUBLE) / 4294967296.0) AS embedding FROM " + sql_values([("a.py", "x = 1"), ("b.py", "y = 2\n")], ["path", "content"]) + " UNION ALL SELECT 'c.py:0', 'old', CAST([1.0] AS DOUBLE[])")
def q_vector_index(spark, sf_dir):
    known = spark.createDataFrame([("c.py:0", "old", [1.0])], "id string, content string, embedding array<double>")
    return C.vector_index(spark.createDataFrame([("a.py", "x = 1"), ("b.py", "y = 2\n"), ("c.py", "new")], "path string, content string"), known, 8)


CURSORS = [(1, "src/app/main.py", "    data = load("), (2, "src/app/main.py", "return run(data"), (3, "src/app/main.py", "parse(x)"), (4, "src/app/store.py", "load("), (5, "web/index.js", "start(a, ")]


@query(f"SELECT cursor_id, c.name, min(line) AS line FROM (SELECT cursor_id, path, regexp_extract(before, '(\\w+)\\s*\\([^)]*$', 1) AS name FROM {sql_values(CURSORS, ['cursor_id', 'path', 'before'])}) c JOIN {FUNCTIONS} f ON f.path = c.path AND f.name = c.name GROUP BY cursor_id, c.name")
def q_signature_help(spark, sf_dir):
    return C.signature_help(spark.createDataFrame(CURSORS, "cursor_id int, path string, before string"), spark.createDataFrame(FILES, "path string, content string"))


@query("""SELECT ts, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'warn' ELSE 'info' END AS level, CASE event_type WHEN 'purchase' THEN 'sensitive_access' WHEN 'view' THEN 'qa_query' ELSE event_type END AS operation, CAST(user_id AS VARCHAR) AS user, '' AS file_path,
CASE event_type WHEN 'view' THEN '{"question_hash":"' || substr(md5('q' || user_id), 1, 8) || '","cached":"true"}' ELSE '{}' END AS details, 0 AS duration_ms, event_type <> 'error' AS success, '' AS error FROM events""")
def q_audit_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "sensitive_access").when(F.col("event_type") == "view", "qa_query").otherwise(F.col("event_type"))
    details = F.when(F.col("event_type") == "view", F.concat(F.lit('{"question": "q'), F.col("user_id").cast("string"), F.lit('", "cached": true}')))
    null = F.lit(None)
    return C.audit_rows(events.select("ts", F.col("user_id").cast("string").alias("user"), kind.alias("kind"), null.cast("string").alias("file_path"), details.alias("details"), null.cast("int").alias("duration_ms"), (F.col("event_type") != "error").alias("success"), null.cast("string").alias("error")))


@query(f"""SELECT 'functions' AS analyzer, '{{"line":' || line || ',"name":"' || name || '","path":"' || path || '"}}' AS fact FROM {FUNCTIONS}""")
def q_analyzers(spark, sf_dir):
    return C.analyze(spark.createDataFrame(FILES, "path string, content string"), ["functions"])
