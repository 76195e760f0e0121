"""Records: upkeep over the tables of orders and events, and small cases with SQL that states the rules on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import detect as D
from stratalens.operators import facts as A
from stratalens.operators import records as R
from stratalens.operators import scan
from stratalens.plans.code_queries import LINES
from stratalens.plans.detect_queries import _TYPES
from stratalens.plans.detect_queries import SRC as PROJECT_SRC
from stratalens.registry import query, sql_values
from stratalens.sources.corpus import FILES, PROJECTS
from stratalens.sources.tables import table

CACHES = [("ok", "1.0", 1000, "c1"), ("old", "0.9", 1000, "c1"), ("late", "1.0", -99000, "c1"), ("lazy", "1.0", 1000, "c1"), ("top", "1.0", 1000, "c1"), ("dirty", "1.0", 1000, "c1"), ("new", "1.0", 1000, "c1")]
CACHED = [("ok", "go.mod", "a"), ("lazy", "x.py", "a"), ("top", "go.mod", "a"), ("top", "x.py", "a"), ("dirty", "go.mod", "a"), ("new", "go.mod", "a")]
CURRENT = [("ok", "go.mod", "a"), ("lazy", "x.py", "b"), ("top", "go.mod", "b"), ("top", "x.py", "a"), ("top", "y.py", "c"), ("dirty", "go.mod", "a"), ("new", "go.mod", "a"), ("none", "a", "a")]
GIT = [("ok", False, "c1"), ("old", False, "c1"), ("late", False, "c1"), ("lazy", False, "c1"), ("top", False, "c1"), ("dirty", True, "c1"), ("new", False, "c2"), ("none", False, "c1")]


def _validity(spark, **how):
    caches = spark.createDataFrame(CACHES, "project string, version string, at int, last_commit string")
    caches = caches.withColumn("stamp", F.lit("2024-01-02").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("at"))).drop("at")
    return R.cache_validity(caches, spark.createDataFrame(CACHED, "project string, path string, hash string"), spark.createDataFrame(CURRENT, "project string, path string, hash string"), spark.createDataFrame(GIT, "project string, has_changes boolean, last_commit string"), F.lit("2024-01-02 01:00:00").cast("timestamp_ntz"), **how)


def _validity_sql(rest: str) -> str:
    files = f"SELECT n.project, list_sort(list(n.path)) AS files FROM {sql_values(CURRENT, ['project', 'path', 'hash']).replace('AS t(', 'AS n(')} LEFT JOIN {sql_values(CACHED, ['project', 'path', 'hash']).replace('AS t(', 'AS o(')} USING (project, path) WHERE n.hash IS DISTINCT FROM o.hash GROUP BY n.project"
    reason = f"CASE WHEN secs IS NULL THEN 'missing' WHEN version <> '1.0' THEN 'version' WHEN secs + 86400 < 3600 THEN 'expired' {rest} END"
    return f"""SELECT project, reason IN ('valid', 'lazy') AS is_valid, reason NOT IN ('valid', 'lazy') AS needs_update, CASE reason WHEN 'lazy' THEN 'valid' ELSE reason END AS reason, reason = 'lazy' AS lazy_skip, CASE reason WHEN 'files' THEN files ELSE [] END AS changed FROM (SELECT g.project, coalesce(files, []) AS files, {reason} AS reason
  FROM {sql_values(GIT, ['project', 'has_changes', 'head']).replace('AS t(', 'AS g(')} LEFT JOIN {sql_values(CACHES, ['project', 'version', 'secs', 'last_commit']).replace('AS t(', 'AS c(')} USING (project) LEFT JOIN ({files}) USING (project))"""


_FULL = "WHEN len(coalesce(files, [])) > 0 THEN 'files' WHEN has_changes THEN 'uncommitted' WHEN head <> last_commit THEN 'commits' ELSE 'valid'"


@query(_validity_sql("WHEN NOT list_has_any(coalesce(files, []), ['package.json', 'Cargo.toml', 'go.mod', 'pom.xml', 'CMakeLists.txt', 'requirements.txt', 'AndroidManifest.xml']) THEN 'lazy' " + _FULL))
def q_cache_validity(spark, sf_dir):
    return _validity(spark)


@query(_validity_sql(_FULL))
def q_cache_validity_full(spark, sf_dir):
    return _validity(spark, lazy=False)


@query(_validity_sql("ELSE 'valid'"))
def q_cache_validity_quick(spark, sf_dir):
    return _validity(spark, quick=True)


@query("SELECT p_partkey AS path, CASE WHEN p_size < 20 THEN md5(p_name || 'x') ELSE md5(p_name) END AS hash FROM part WHERE p_size >= 5")
def q_update_hashes(spark, sf_dir):
    """Parts below size 20 changed, those below 5 are gone."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "path")
    return R.update_hashes(part.select("path", F.md5("p_name").alias("hash")), part.filter("p_size < 20"), part.filter("p_size >= 5").select("path", F.md5(F.concat("p_name", F.lit("x"))).alias("hash")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def q_delete_cascade(spark, sf_dir):
    """Customers in debt leave, and their orders with them."""
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return R.cascade({"orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")}, gone, "o_custkey")["orders"]


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 2 = 0 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def q_update_fields(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changes = customer.filter("c_custkey % 7 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, "moved").alias("c_mktsegment"))
    return R.set_fields(customer, changes, "c_custkey")


ACL = [("u1", "qa", "1", "viewer", 1), ("u2", "qa", "1", "editor", 1), ("u3", "qa", "2", "viewer", 1)]
GRANTS = [("u1", "qa", "1", "editor", 2), ("u1", "qa", "1", "admin", 3), ("u4", "qa", "1", "viewer", 2), ("u5", "qa", "1", "king", 2)]
_ENTRY = "user_id string, resource_type string, resource_id string, role string, ts int"


@query("SELECT * FROM (VALUES ('u1', 'qa', '1', 'admin', 3), ('u2', 'qa', '1', 'editor', 1), ('u3', 'qa', '2', 'viewer', 1), ('u4', 'qa', '1', 'viewer', 2)) AS t(user_id, resource_type, resource_id, role, ts)")
def q_grant(spark, sf_dir):
    return R.grant(spark.createDataFrame(ACL, _ENTRY), spark.createDataFrame(GRANTS, _ENTRY), spark.createDataFrame([("viewer",), ("editor",), ("admin",)], "role string"))


@query("SELECT * FROM (VALUES ('u1', 'qa', '1', 'viewer', 1), ('u3', 'qa', '2', 'viewer', 1)) AS t(user_id, resource_type, resource_id, role, ts)")
def q_revoke(spark, sf_dir):
    return R.revoke(spark.createDataFrame(ACL, _ENTRY), spark.createDataFrame([("u2", "qa", "1"), ("u3", "qa", "1")], "user_id string, resource_type string, resource_id string"))


@query(f"SELECT * FROM {sql_values(ACL, ['user_id', 'resource_type', 'resource_id', 'role', 'ts'])}")
def q_access_round_trip(spark, sf_dir):
    lines = R.export_access(spark.createDataFrame(ACL, _ENTRY)).unionByName(spark.createDataFrame([(None,)], "entry string"))
    return R.import_access(lines, _ENTRY)


@query("""SELECT c_custkey AS user_id, o_orderkey AS resource_id FROM customer JOIN orders ON o_custkey = c_custkey UNION SELECT c_custkey, o_orderkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON n_name = 'FRANCE' AND o_orderpriority = '1-URGENT'""")
def q_accessible(spark, sf_dir):
    """Customers read their own orders, and those of the nation that is the team of urgent ones read these."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("resource_id"), F.col("o_custkey").alias("owner"), F.when(F.col("o_orderpriority") == "1-URGENT", "FRANCE").alias("team"), F.lit("team").alias("visibility"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("team"))
    members = users.join(nation, "c_nationkey").select("user_id", "team", F.lit("viewer").alias("role"))
    none = spark.createDataFrame([], "user_id long, resource_id long, role string")
    return R.accessible(users.select("user_id"), orders, members, none, spark.createDataFrame([("viewer", "read")], "role string, action string"))


@query("""SELECT c_custkey AS user_id, o_orderkey AS resource_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 UNION ALL SELECT NULL, o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'""")
def q_accessible_public(spark, sf_dir):
    """Customers in debt read their own orders, and anyone reads those of low priority."""
    users = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    visibility = F.when(F.col("o_orderpriority") == "5-LOW", "public").otherwise("team")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("resource_id"), F.col("o_custkey").alias("owner"), F.lit(None).cast("string").alias("team"), visibility.alias("visibility"))
    none = spark.createDataFrame([], "user_id long, resource_id long, role string")
    members = spark.createDataFrame([], "user_id long, team string, role string")
    return R.accessible(users, orders, members, none, spark.createDataFrame([("viewer", "read")], "role string, action string"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view'")
def q_pending(spark, sf_dir):
    edits = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "view", "pending").otherwise("approved"))
    return R.pending(edits).select("event_id", "user_id")


LINKS, MORE, LESS = [("q1", "i1"), ("q1", "i2"), ("q2", "i2")], [("q1", "i1"), ("q3", "i3")], [("q1", "i2"), ("q9", "i9")]
_LINKED = "(VALUES ('q1', 'i1'), ('q2', 'i2'), ('q3', 'i3')) AS l(qa_id, issue)"


def _links(spark):
    of = lambda rows: spark.createDataFrame(rows, "qa_id string, issue string")
    return R.linked(of(LINKS), of(MORE), of(LESS))


@query(f"SELECT * FROM {_LINKED}")
def q_issue_links(spark, sf_dir):
    return _links(spark)


@query("SELECT * FROM (VALUES ('a.py', '12'), ('a.py', 'i1'), ('b.py', 'i2')) AS t(path, issue)")
def q_issues_of_files(spark, sf_dir):
    texts = spark.createDataFrame([("a.py", "# fixes #12"), ("b.py", "")], "path string, content string")
    return R.issues_of_files(A.issue_references(texts), spark.createDataFrame([("q1", "a.py"), ("q2", "b.py"), ("q7", "b.py")], "qa_id string, path string"), _links(spark))


@query("SELECT 'q2' AS qa_id")
def q_for_review(spark, sf_dir):
    return R.for_review(_links(spark), spark.createDataFrame([("i1", "open"), ("i2", "closed")], "issue string, status string"))


@query("SELECT o_orderkey AS commit, count(DISTINCT l_partkey) AS files, coalesce(list_sort(list(DISTINCT 's' || l_suppkey) FILTER (l_partkey % 3 = 0)), []) AS qa_ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def q_outdated(spark, sf_dir):
    """Orders stand for merges, their parts for files, and the suppliers of every third part for entries."""
    path = F.concat_ws("/", "l_orderkey", "l_partkey").alias("path")
    item = table(spark, sf_dir, "lineitem")
    refs = item.filter("l_partkey % 3 = 0").select(path, F.concat(F.lit("s"), "l_suppkey").alias("qa_id")).distinct()
    return R.outdated(item.select(F.col("l_orderkey").alias("commit"), path), refs)


NAMES = [("main.py", 1, "store"), ("main.py", 2, "json"), ("main.py", 6, "view"), ("web.js", 1, "view"), ("web.js", 2, "view")]
REFS = [("q1", "src/store.py", 1), ("q2", "src/store.py", 2), ("q3", "lib/store/json.py", 1), ("q4", "web/view.ts", 1)]


@query("SELECT * FROM (VALUES ('main.py', 'q3', 0.5), ('main.py', 'q1', 0.5), ('web.js', 'q4', 0.5)) AS t(file, qa_id, score)")
def q_by_structure(spark, sf_dir):
    return R.by_structure(spark.createDataFrame(NAMES, "file string, position int, name string"), spark.createDataFrame(REFS, "qa_id string, path string, place int"))


@query("SELECT p_name AS name, p_type AS description FROM part WHERE contains(lower(p_name), 'green') OR contains(lower(p_type), 'green')")
def q_features(spark, sf_dir):
    return R.features(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("description")), "Green")


SETTINGS = [("cache.ttl", "60"), ("cache.size.max", "1"), ("cachex", "2"), ("log", "on")]


@query(f"SELECT * FROM {sql_values(SETTINGS, ['key', 'value'])} WHERE key <> 'cache' AND NOT starts_with(key, 'cache.')")
def q_config_delete(spark, sf_dir):
    return R.settings_without(spark.createDataFrame(SETTINGS, "key string, value string"), "cache")


VARIABLES = [("t", "name", "string", True, None, "[a-z]+"), ("t", "port", "number", False, None, None), ("t", "debug", "boolean", False, None, None), ("t", "env", "enum", True, ["dev", "prod"], None)]
VALUES = [("a", "t", "name", "demo"), ("a", "t", "port", "80x"), ("a", "t", "env", "test"), ("a", "t", "debug", "TRUE"), ("b", "t", "name", "9x"), ("b", "t", "debug", "maybe"), ("b", "t", "port", "1.5")]


@query("SELECT * FROM (VALUES ('a', CAST([] AS VARCHAR[]), ['env enum', 'port number'], true), ('b', ['missing env'], ['debug boolean', 'name pattern'], false)) AS t(template_id, errors, warnings, valid)")
def q_template_values(spark, sf_dir):
    return R.validated(spark.createDataFrame(VALUES, "template_id string, kind string, name string, value string"), spark.createDataFrame(VARIABLES, "kind string, name string, type string, required boolean, allowed array<string>, pattern string"))


TEMPLATES = [("base", None, "A {% block x %}one{% endblock %} B {% block y %}two{% endblock %} C"), ("kid", "base", "{% block y %}2!{% endblock %}"), ("lone", None, "plain")]


@query("SELECT * FROM (VALUES ('base', 'A {% block x %}one{% endblock %} B {% block y %}two{% endblock %} C'), ('kid', 'A one B 2! C'), ('lone', 'plain')) AS t(name, text)")
def q_template_inheritance(spark, sf_dir):
    return R.inherited(spark.createDataFrame(TEMPLATES, "name string, parent string, text string"))


RULES = [("android", 50, "build.gradle"), ("android", 50, "app/"), ("vehicle", 100, "vehicle/"), ("dts", 0, "*.dts"), ("go", 10, "go.mod")]


@query(f"""SELECT project, type, round(sum(s) * (1 + priority / 100.0), 6) AS score FROM (SELECT project, type, priority, pattern, max(CASE WHEN starts_with(pattern, '*') THEN CASE WHEN ends_with(path, substr(pattern, 2)) THEN 1.0 END WHEN path = pattern THEN 1.5 WHEN starts_with(path, rtrim(pattern, '/') || '/') THEN 1.2 END) AS s FROM {PROJECT_SRC}, {sql_values(RULES, ['type', 'priority', 'pattern']).replace('AS t(', 'AS r(')} GROUP BY ALL) WHERE s IS NOT NULL GROUP BY project, type, priority""")
def q_template_types(spark, sf_dir):
    return R.template_types(spark.createDataFrame(PROJECTS, "project string, path string, content string"), spark.createDataFrame(RULES, "type string, priority int, pattern string"))


CALLS = [("c", 1, "api", "db-1", "get", 7), ("c", 2, "db-1", "log", "put", None)]


@query("SELECT 'c' AS chain, array_to_string(['sequenceDiagram', '    participant api as api', '    participant db_1 as db-1', '    participant log as log', '    api-->>db_1 : get (L7)', '    db_1-->>log : put'], chr(10)) AS text")
def q_sequence_diagram(spark, sf_dir):
    return R.sequence_diagram(spark.createDataFrame(CALLS, "chain string, position int, caller string, callee string, method string, line int"), "chain")


@query("SELECT user_id, 'stateDiagram-v2' || chr(10) || array_to_string(list('    ' || src || ' --> ' || event_type || ' : ' || event_id ORDER BY event_id), chr(10)) AS text FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS src FROM events) WHERE src IS NOT NULL GROUP BY user_id")
def q_state_diagram(spark, sf_dir):
    """How each user moved from event to event."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    moves = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("position"), F.lag("event_type").over(w).alias("src"), F.col("event_type").alias("dst"), F.col("event_id").cast("string").alias("event"))
    return R.state_diagram(moves.filter("src is not null"), "user_id")


@query(rf"SELECT path, 'classDiagram' || chr(10) || array_to_string(list('    class ' || name || ' {{' || chr(10) || '    }}' ORDER BY name), chr(10)) AS text FROM (SELECT path, coalesce(nullif(regexp_extract(content, '^\s*(?:public\s+)?class\s+(\w+)', 1), ''), '') AS name FROM {LINES} WHERE lang IS NOT NULL) WHERE name <> '' GROUP BY path")
def q_class_diagram(spark, sf_dir):
    return R.class_diagram(A.declarations(spark.createDataFrame(FILES, "path string, content string")), "path")


@query("SELECT r_name AS model, 'erDiagram' || chr(10) || string_agg(block, chr(10) ORDER BY entity) AS text FROM (SELECT r_name, n_name AS entity, '    ' || n_name || ' {' || chr(10) || '        int key' || chr(10) || '        string name' || chr(10) || '    }' AS block FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY r_name")
def q_entity_diagram(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    fields = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("field"), F.lit(t).alias("type")) for i, (n, t) in enumerate((("key", "int"), ("name", "string")))]))
    return R.entity_diagram(both.select(F.col("r_name").alias("model"), F.col("n_name").alias("entity"), fields.alias("f")).select("model", "entity", "f.*"), "model")


REQUESTS = [(1, "Add login"), (2, "Fix typo")]
FOUND = [(1, "a.py", "open task", "low"), (1, "a.py", "large file", "medium"), (1, "b.py", "printing", "low")]


def _report(spark, form):
    return R.request_report(spark.createDataFrame(REQUESTS, "pr int, title string"), spark.createDataFrame(FOUND, "pr int, path string, finding string, severity string"), form)


_FOUND = sql_values(FOUND, ["pr", "path", "finding", "severity"]).replace("AS t(", "AS f(")


@query(f"SELECT r.pr, '# ' || title || chr(10) || chr(10) || coalesce(string_agg('- **' || severity || '** `' || path || '`: ' || finding, chr(10) ORDER BY path, finding), '') AS text FROM {sql_values(REQUESTS, ['pr', 'title']).replace('AS t(', 'AS r(')} LEFT JOIN {_FOUND} ON f.pr = r.pr GROUP BY r.pr, title")
def q_request_report(spark, sf_dir):
    return _report(spark, "markdown")


@query(f"SELECT r.pr, '<h1>' || title || '</h1>' || chr(10) || '<ul>' || chr(10) || coalesce(string_agg('<li><b>' || severity || '</b> <code>' || path || '</code>: ' || finding || '</li>', chr(10) ORDER BY path, finding), '') || chr(10) || '</ul>' AS text FROM {sql_values(REQUESTS, ['pr', 'title']).replace('AS t(', 'AS r(')} LEFT JOIN {_FOUND} ON f.pr = r.pr GROUP BY r.pr, title")
def q_request_report_html(spark, sf_dir):
    return _report(spark, "html")


@query("""SELECT * FROM (VALUES (1, '{"title":"Add login","findings":[{"path":"a.py","finding":"large file","severity":"medium"},{"path":"a.py","finding":"open task","severity":"low"},{"path":"b.py","finding":"printing","severity":"low"}]}'), (2, '{"title":"Fix typo","findings":[]}')) AS t(pr, text)""")
def q_request_report_json(spark, sf_dir):
    return _report(spark, "json")


@query(rf"""SELECT type, '## ' || type || ' (' || count(*) || ')' || chr(10) || chr(10) || string_agg('- `' || path || ':' || line || '` ' || text, chr(10) ORDER BY path, line) AS text FROM (SELECT path, line, regexp_extract(content, '(TODO|FIXME|HACK)\b:?\s*(.*)$', 1) AS type, trim(regexp_replace(regexp_extract(content, '(TODO|FIXME|HACK)\b:?\s*(.*)$', 2), '\s+--\s+\w+$', '')) AS text FROM {LINES} WHERE regexp_matches(content, '(#|//)\s*(TODO|FIXME|HACK)\b')) GROUP BY type""")
def q_task_report(spark, sf_dir):
    tasks = scan.todos(spark.createDataFrame(FILES, "path string, content string"), "path", "content")
    return R.task_report(tasks.filter(F.col("type").isin("TODO", "FIXME", "HACK")))


@query(f"""SELECT s.project, '# ' || s.project || chr(10) || chr(10) || '- types: ' || coalesce(kinds, 'unknown') || chr(10) || '- scale: ' || CASE WHEN s.project IN ('droid', 'car') THEN 'large' ELSE 'small' END || ' (' || n || ' files)' || chr(10) || chr(10) || '## Entry points' || chr(10) || chr(10) || coalesce(starts, 'none') AS text
  FROM (SELECT project, count(*) AS n, string_agg(CASE WHEN regexp_matches(path, '(^|/)(main\\.(c|cpp|py|tsx)|MainActivity\\.kt|app\\.js)$') THEN '- ' || path END, chr(10) ORDER BY path) AS starts FROM {PROJECT_SRC} GROUP BY project) s LEFT JOIN (SELECT project, string_agg(type, ', ' ORDER BY rank) AS kinds FROM {_TYPES} GROUP BY project) k ON k.project = s.project""")
def q_overview(spark, sf_dir):
    files = spark.createDataFrame(PROJECTS, "project string, path string, content string")
    return R.overview(D.detect_types(files), D.scale(files), D.entry_points(files))


@query("SELECT c_custkey AS try_id, c_custkey % 3 <> 0 AS right FROM customer")
def q_credentials(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    users = customer.select(F.col("c_custkey").alias("user_id"), F.sha2("c_name", 256).alias("password_hash"))
    tries = customer.select(F.col("c_custkey").alias("try_id"), F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 3 == 0, F.when(F.col("c_custkey") % 2 == 0, "wrong")).otherwise(F.col("c_name")).alias("password"))
    return R.credentials_right(users, tries)


@query("SELECT n_name AS path FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
def q_union_changes(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("path"))
    return R.union_all([table(spark, sf_dir, "nation").select(F.col("n_name").alias("path")), region, region])
