"""Source files, change listings, histories and paths, rendered from the order lines and read back.

An order is a project; every part of it is a function, a class, a test, a commit or a path. The oracles say what must come out of the
tables, without the formats.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import code as K
from stratalens.operators import facts, graph, project, records, review, scan
from stratalens.plans.cyclic_queries import FOLLOWS, _follows
from stratalens.plans.rendered_queries import _DEPS, DEPS
from stratalens.registry import query
from stratalens.sources import files as S
from stratalens.sources.tables import table
from stratalens.streaming import changes as C

#: Parts of an order in the order of their keys: k from 0, n of them, q the last one.
_NUMBERED = "SELECT *, CAST(row_number() OVER (PARTITION BY o ORDER BY p) - 1 AS INTEGER) AS k, CAST(count(*) OVER (PARTITION BY o) AS INTEGER) AS n, max(p) OVER (PARTITION BY o) AS q FROM {}"
NUMBERED = f"({_NUMBERED.format(DEPS)})"


def _parts(spark, sf_dir) -> str:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("__lines")
    return f"({_NUMBERED.format('(' + _DEPS.format('__lines') + ')')})"


def _files(spark, sf_dir, name: str, line: str):
    """A file for each order: a stretch for each of its parts, in the order of the parts."""
    body = f"array_join(transform(sort_array(collect_list(struct(p, {line} AS line))), x -> x.line), '\\n')"
    return spark.sql(f"SELECT concat('repo', o, '/{name}') AS path, {body} AS content FROM {_parts(spark, sf_dir)} GROUP BY o")


def _each(spark, sf_dir, columns: str, where: str = "true"):
    return spark.sql(f"SELECT {columns} FROM {_parts(spark, sf_dir)} WHERE {where}")


#: Six lines a part: import, task, comment, head, docstring, body. Every function calls the last one.
_PYTHON = r"""concat('import lib', s, '\n', '# TODO: ', if(b > 40, 'urgent ', if(b < 10, 'later ', '')), 'check ', a, if(f = 'R', concat(' -- s', s), ''), '\n# Part ', p, '\ndef f', p, '(a, b):\n    "Doc ', p, '."\n    return f', q, if(f = 'A', '(a) if a and b else b', concat('(os.environ["P', p, '_TOKEN"])')))"""


def _modules(spark, sf_dir):
    return _files(spark, sf_dir, "mod.py", _PYTHON)


def _of(columns: str, where: str = "true", name: str = "mod.py") -> str:
    return f"SELECT 'repo' || o || '/{name}' AS path, {columns} FROM {NUMBERED} WHERE {where}"


_NAME, _HEAD, _END = "'f' || p AS name", "6 * k + 4", "CASE WHEN k = n - 1 THEN 6 * n ELSE 6 * k + 9 END"


@query(_of(f"'python' AS lang, {_NAME}, {_HEAD} AS line, {_END} AS end_line"))
def q_order_functions(spark, sf_dir):
    return K.functions(_modules(spark, sf_dir))


@query(_of("'lib' || s AS module"))
def q_order_imports(spark, sf_dir):
    return K.imports(_modules(spark, sf_dir))


@query(_of("'f' || p AS src, 'f' || q AS dst, 6 * k + 6 AS line", "p <> q"))
def q_order_calls(spark, sf_dir):
    return K.calls(_modules(spark, sf_dir))


@query(_of("6 * k + 2 AS line, 'TODO' AS type, CASE WHEN b > 40 THEN 'urgent ' WHEN b < 10 THEN 'later ' ELSE '' END || 'check ' || a AS text, CASE WHEN f = 'R' THEN 's' || s END AS author, CASE WHEN b > 40 THEN 'high' WHEN b < 10 THEN 'low' ELSE 'medium' END AS priority"))
def q_order_todos(spark, sf_dir):
    return scan.todos(_modules(spark, sf_dir), "path", "content")


@query("SELECT name, path, line, true AS is_secret FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, line) AS r FROM (" + _of("'P' || p || '_TOKEN' AS name, 6 * k + 6 AS line", "f <> 'A'") + ")) WHERE r = 1")
def q_order_environment(spark, sf_dir):
    return K.environment(_modules(spark, sf_dir))


@query(_of(f"'function' AS kind, {_NAME}, CAST({_HEAD} AS BIGINT) AS line, CAST(2 AS BIGINT) AS n_params, 'Doc ' || p || '.' AS docstring") + " UNION ALL " + _of("'import', 'lib' || s, CAST(6 * k + 1 AS BIGINT), NULL, NULL"))
def q_order_syntax(spark, sf_dir):
    """What Python's own parser finds."""
    return K.syntax(_modules(spark, sf_dir))


@query(_of(f"{_NAME}, ({_END}) - ({_HEAD}) + 1 AS n_lines, 2 AS n_params, CASE WHEN f = 'A' THEN 3 ELSE 1 END AS cyclomatic, CAST([] AS VARCHAR[]) AS advice"))
def q_order_function_report(spark, sf_dir):
    return review.function_report(_modules(spark, sf_dir))


@query(_of(f"{_NAME}, 'Part ' || p AS comment"))
def q_order_comments(spark, sf_dir):
    return review.comments_above(_modules(spark, sf_dir))


#: Unindented lines are the first four of every six; a chunk closes at the first of them ten lines on, or one or two lines later.
@query(f"""WITH RECURSIVE l AS (SELECT o, 6 * k + j AS line, 6 * n AS n FROM {NUMBERED}, (SELECT unnest([1, 2, 3, 4]) AS j)), c AS (SELECT DISTINCT o, n, 0 AS chunk, 1 AS low FROM l UNION ALL SELECT o, n, chunk + 1, low FROM (SELECT c.o, c.n, c.chunk, min(l.line) AS low FROM c JOIN l ON l.o = c.o AND l.line - c.low >= 10 GROUP BY ALL))
SELECT 'repo' || o || '/mod.py' AS path, chunk, low, coalesce(lead(low) OVER (PARTITION BY o ORDER BY chunk) - 1, n) AS high FROM c""")
def q_order_chunks(spark, sf_dir):
    return K.chunks(_modules(spark, sf_dir))


_CLASSES = {"py": "concat('class C', p, '(B', s, '):\\n    pass')", "ts": "concat('export ', if(f = 'R', 'interface', 'abstract class'), ' C', p, if(b > 25, concat(' extends B', s), ''), ' {\\n}')", "java": "concat('public ', if(f = 'R', 'interface', 'final class'), ' C', p, ' extends B', s, ' {\\n}')", "go": "concat('type C', p, if(f = 'R', ' interface', ' struct'), ' {\\n}')", "rs": "concat('pub ', if(f = 'R', 'enum', 'struct'), ' C', p, ' {\\n}')"}
_DECLARED = {"py": ("python", "'class'", "'B' || s"), "ts": ("typescript", "CASE WHEN f = 'R' THEN 'interface' ELSE 'class' END", "CASE WHEN b > 25 THEN 'B' || s END"), "java": ("java", "CASE WHEN f = 'R' THEN 'interface' ELSE 'class' END", "'B' || s"), "go": ("go", "CASE WHEN f = 'R' THEN 'interface' ELSE 'struct' END", "NULL"), "rs": ("rust", "CASE WHEN f = 'R' THEN 'enum' ELSE 'struct' END", "NULL")}


@query(" UNION ALL ".join(_of(f"'{lang}' AS lang, {kind} AS kind, 'C' || p AS name, {base} AS base, 2 * k + 1 AS line", name=f"types.{ext}") for ext, (lang, kind, base) in _DECLARED.items()))
def q_order_declarations(spark, sf_dir):
    """Classes, interfaces, structures and enumerations of five languages."""
    found = [_files(spark, sf_dir, f"types.{ext}", line) for ext, line in _CLASSES.items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return facts.declarations(out)


_TESTED = r"""SELECT concat('repo', o, '/src/mod', p, '.py') AS path, 'x = 1' AS content FROM {0} UNION ALL SELECT concat('repo', o, '/tests/test_mod', p, '.py'), repeat('def test_it(x):\n    pass\n', b) FROM {0} WHERE f = 'R' AND a = 1"""


def _tested(spark, sf_dir):
    return spark.sql(_TESTED.format(_parts(spark, sf_dir)))


@query(f"SELECT 'repo' || o || '/tests/test_mod' || p || '.py' AS path, 'pytest' AS framework, b AS cases FROM {DEPS} WHERE f = 'R' AND a = 1")
def q_order_test_files(spark, sf_dir):
    return K.test_files(_tested(spark, sf_dir))


@query(f"SELECT 'repo' || o || '/src/mod' || p || '.py' AS path, p IN (SELECT p FROM {DEPS} WHERE f = 'R' AND a = 1) AS covered FROM {DEPS}")
def q_order_coverage(spark, sf_dir):
    return K.coverage(_tested(spark, sf_dir))


_PATH = "concat('repo', o, '/', CASE f WHEN 'R' THEN 'build/' WHEN 'A' THEN concat('src', s, '/') ELSE '' END, CASE WHEN b > 45 THEN concat('.env.', p) WHEN b > 40 THEN concat('id', p, '.key') WHEN b > 30 THEN concat('p', p, '.lock') ELSE concat('mod', p, '.py') END)"


@query(f"SELECT folder, count(*) AS n_files FROM (SELECT 'repo' || o AS folder FROM {DEPS} UNION ALL SELECT 'repo' || o || CASE f WHEN 'R' THEN '/build' ELSE '/src' || s END FROM {DEPS} WHERE f IN ('R', 'A')) GROUP BY folder")
def q_order_folders(spark, sf_dir):
    return S.folders(_each(spark, sf_dir, f"{_PATH} AS path"))


@query(f"SELECT {_PATH} AS path FROM {DEPS} WHERE f <> 'R' AND NOT (b > 30 AND b <= 40)")
def q_order_kept_files(spark, sf_dir):
    """Outside build folders, without lock files, at most three deep."""
    return S.kept(_each(spark, sf_dir, f"{_PATH} AS path"), None, ["*.lock"], 3)


@query(f"SELECT {_PATH} AS path FROM {DEPS} WHERE b > 40")
def q_order_secret_files(spark, sf_dir):
    return S.secret_files(_each(spark, sf_dir, f"{_PATH} AS path"))


@query(f"SELECT '.py' AS extension, count(*) FILTER (b <= 30) AS n FROM {DEPS} UNION ALL SELECT '.lock', count(*) FILTER (b > 30 AND b <= 40) FROM {DEPS} UNION ALL SELECT '.key', count(*) FILTER (b > 40 AND b <= 45) FROM {DEPS} UNION ALL SELECT '.rb', 0")
def q_order_extensions(spark, sf_dir):
    return S.count_extensions(_each(spark, sf_dir, f"{_PATH} AS path"), [".py", ".lock", ".key", ".rb"])


_LOG = "SELECT o_orderkey AS id, concat('h', o_orderkey, '|s', o_orderkey, '|cust', o_custkey, '|', date_format(o_orderdate, 'yyyy-MM-dd'), '|order | ', o_orderpriority) AS line FROM __orders"


def _log(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("__orders")
    return spark.sql(_LOG)


@query("SELECT o_orderkey AS id, 'h' || o_orderkey AS hash, 's' || o_orderkey AS short, 'cust' || o_custkey AS author, strftime(o_orderdate, '%Y-%m-%d') AS date, 'order | ' || o_orderpriority AS subject FROM orders")
def q_order_commits(spark, sf_dir):
    return S.commits(_log(spark, sf_dir))


@query("SELECT 'cust' || o_custkey AS author, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, author LIMIT 10")
def q_order_contributors(spark, sf_dir):
    return S.contributors(_log(spark, sf_dir))


@query(f"SELECT o * 100000 + p AS id, a AS files, CASE WHEN f = 'R' THEN 0 ELSE b END AS insertions, CASE WHEN f = 'N' THEN 0 ELSE a END AS deletions FROM {DEPS}")
def q_order_short_stat(spark, sf_dir):
    line = "concat(' ', a, if(a = 1, ' file', ' files'), ' changed', if(f = 'R', '', concat(', ', b, if(b = 1, ' insertion(+)', ' insertions(+)'))), if(f = 'N', '', concat(', ', a, if(a = 1, ' deletion(-)', ' deletions(-)'))))"
    return S.short_stat(_each(spark, sf_dir, f"o * 100000 + p AS id, {line} AS line"))


@query(f"SELECT o AS file, k + 1 AS line, 'sup' || CASE WHEN f = 'R' THEN s ELSE 0 END AS author, 'x = ' || p AS code FROM {NUMBERED}")
def q_order_blame(spark, sf_dir):
    """Porcelain listings: a header, an author and a code line for each part."""
    rows = "explode(array(struct(4 * k AS n, concat('abc', p, ' 1 1 1') AS line), struct(4 * k + 1 AS n, concat('author sup', if(f = 'R', s, 0)) AS line), struct(4 * k + 2 AS n, concat('\\t', 'x = ', p) AS line)))"
    return S.blame(_each(spark, sf_dir, f"o AS file, {rows} AS r").select("file", "r.*"))


@query("SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'local' ELSE 'remote' END AS kind, list(CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'origin/' END || 'b' || o_orderkey ORDER BY 'b' || o_orderkey) AS names FROM orders GROUP BY 1")
def q_order_branches(spark, sf_dir):
    name = F.concat(F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise("remotes/origin/"), F.lit("b"), "o_orderkey")
    return S.branches(table(spark, sf_dir, "orders").select(name.alias("name")))


@query(f"SELECT o * 100000 + p AS id, CASE WHEN f = 'R' THEN 'renamed' WHEN f = 'A' THEN 'added' WHEN b > 25 THEN 'modified' ELSE 'deleted' END AS change, 'new' || p || '.py' AS path, CASE WHEN f = 'R' THEN 'old' || p || '.py' END AS old_path FROM {DEPS}")
def q_order_name_status(spark, sf_dir):
    line = "CASE WHEN f = 'R' THEN concat('R0', b, '\\t', 'old', p, '.py\\t', 'new', p, '.py') ELSE concat(CASE WHEN f = 'A' THEN 'A' WHEN b > 25 THEN 'M' ELSE 'D' END, '\\t', 'new', p, '.py') END"
    return C.name_status(_each(spark, sf_dir, f"o * 100000 + p AS id, {line} AS line"))


@query(f"SELECT o * 100000 + p AS id, CASE WHEN f = 'R' THEN 'untracked' WHEN f = 'A' THEN 'staged' WHEN b > 25 THEN 'unstaged' ELSE 'conflict' END AS kind, 'p' || p || '.py' AS path FROM {DEPS}")
def q_order_short_status(spark, sf_dir):
    return C.short_status(_each(spark, sf_dir, "o * 100000 + p AS id, concat(CASE WHEN f = 'R' THEN '??' WHEN f = 'A' THEN 'M ' WHEN b > 25 THEN ' M' ELSE 'UU' END, ' p', p, '.py') AS line"))


@query(f"SELECT o * 100000 + p AS id, 'p' || p || '.py' AS path, CASE WHEN f = 'R' THEN 0 ELSE b END AS added, CASE WHEN f = 'R' THEN 0 ELSE a END AS removed FROM {DEPS}")
def q_order_diff_stats(spark, sf_dir):
    return C.diff_stats(_each(spark, sf_dir, "o * 100000 + p AS id, concat(if(f = 'R', '-', cast(b AS string)), '\\t', if(f = 'R', '-', cast(a AS string)), '\\t', 'p', p, '.py') AS line"))


@query(f"SELECT o AS id, CAST(row_number() OVER (PARTITION BY o ORDER BY k) - 1 AS INTEGER) AS position, 'p' || p AS file FROM {NUMBERED}")
def q_order_pushes(spark, sf_dir):
    """Push payloads: a commit for each part, which adds, modifies or removes it."""
    commit = """concat('{"', CASE f WHEN 'R' THEN 'removed' WHEN 'A' THEN 'added' ELSE 'modified' END, '": ["p', p, '"]}')"""
    body = f"concat('{{\"commits\": [', array_join(transform(sort_array(collect_list(struct(p, {commit} AS line))), x -> x.line), ', '), ']}}')"
    return C.pushed_files(spark.sql(f"SELECT o AS id, {body} AS payload FROM {_parts(spark, sf_dir)} GROUP BY o"))


_CHANGED = "concat('src', s, '/', CASE WHEN b > 45 THEN 'Api' WHEN b > 40 THEN 'README' ELSE 'mod' END, p, CASE WHEN b > 40 THEN '.md' WHEN b > 20 THEN '.py' ELSE '.txt' END)"


@query(f"""SELECT {_CHANGED} AS path, CASE WHEN b > 45 THEN 'api_modified' WHEN b > 40 THEN 'structure_changed' ELSE 'module_modified' END AS type, CASE WHEN b > 45 THEN 'high' WHEN b > 40 THEN 'low' ELSE 'medium' END AS priority, CASE WHEN b > 45 THEN 'interfaces' WHEN b > 40 THEN 'overview' ELSE 'module src' || s END AS section FROM {DEPS} WHERE b > 20""")
def q_order_document_changes(spark, sf_dir):
    return project.document_changes(_each(spark, sf_dir, f"{_CHANGED} AS path"))


@query(f"""SELECT o AS repo, count(*) AS changed, count(*) FILTER (b > 45) AS high, count(*) FILTER (b > 20 AND b <= 40) AS medium, count(*) FILTER (b > 40 AND b <= 45) AS low,
  CASE WHEN count(*) FILTER (b > 45) > 0 THEN 'need_update' WHEN count(*) FILTER (b > 20 AND b <= 40) > 0 THEN 'suggest_update' WHEN count(*) FILTER (b > 40) > 0 THEN 'minor_update' ELSE 'synced' END AS status FROM {DEPS} GROUP BY o""")
def q_order_document_status(spark, sf_dir):
    return project.document_status(_each(spark, sf_dir, f"o AS repo, {_CHANGED} AS path"))


@query(f"SELECT 'repo' || o || '/api.proto' AS path, 'grpc' AS protocol, 'S' || p AS interface, unnest(['Get' || p, 'Put' || p]) AS method FROM {DEPS} UNION ALL SELECT 'repo' || o || '/I.aidl', 'aidl', 'I' || p, 'call' || p FROM {DEPS}")
def q_order_interfaces(spark, sf_dir):
    proto = _files(spark, sf_dir, "api.proto", "concat('service S', p, ' {\\n  rpc Get', p, ' (A) returns (B);\\n  rpc Put', p, '(B) returns (A);\\n}')")
    aidl = _files(spark, sf_dir, "I.aidl", "concat('interface I', p, ' {\\n  int call', p, '(in String x);\\n}')")
    return project.interfaces(proto.unionByName(aidl))


@query(f"SELECT 'repo' || o || '/jni.c' AS path, 'com_app_C' || s AS class, 'm' || p AS method FROM {DEPS}")
def q_order_native_functions(spark, sf_dir):
    return review.native_functions(_files(spark, sf_dir, "jni.c", "concat('JNIEXPORT jint JNICALL Java_com_app_C', s, '_m', p, ' (JNIEnv *e, jobject o) { }')"))


_ROLE = "CASE f WHEN 'R' THEN 'editor' WHEN 'A' THEN 'viewer' ELSE 'king' END"


@query(f"""WITH d AS (SELECT 'u' || s AS user_id, 'part' AS resource_type, CAST(p AS VARCHAR) AS resource_id, {_ROLE} AS role, a AS ts FROM {DEPS}),
  acl AS (SELECT user_id, resource_type, resource_id, arg_max(role, (ts, role)) AS role, max(ts) AS ts FROM d WHERE ts <= 2 GROUP BY ALL), g AS (SELECT user_id, resource_type, resource_id, arg_max(role, (ts, role)) AS role, max(ts) AS ts FROM d WHERE ts > 2 AND role <> 'king' GROUP BY ALL)
SELECT * FROM g UNION ALL SELECT * FROM acl ANTI JOIN g USING (user_id, resource_type, resource_id)""")
def q_order_grants(spark, sf_dir):
    """Suppliers' roles on parts: the first two lines of orders are what there is, later ones grant; unknown roles count for nothing."""
    rows = _each(spark, sf_dir, f"concat('u', s) AS user_id, 'part' AS resource_type, cast(p AS string) AS resource_id, {_ROLE} AS role, a AS ts")
    keys = ["user_id", "resource_type", "resource_id"]
    acl = rows.filter("ts <= 2").groupBy(*keys).agg(F.max(F.struct("ts", "role")).alias("m")).select(*keys, "m.role", "m.ts")
    return records.grant(acl, rows.filter("ts > 2"), spark.createDataFrame([("viewer",), ("editor",)], "role string"))


@query(f"WITH RECURSIVE e AS (SELECT * FROM {FOLLOWS}), w AS (SELECT [src] AS path, src AS last, 0 AS depth, false AS closed FROM e WHERE src < 20 GROUP BY src UNION ALL SELECT list_append(path, dst), dst, depth + 1, list_contains(path, dst) FROM w JOIN e ON last = src WHERE depth < 4 AND NOT closed) SELECT path, depth, closed FROM w WHERE depth > 0")
def q_part_chains(spark, sf_dir):
    """Chains of four parts that follow one another, from the parts of the lowest keys."""
    edges = _follows(spark, sf_dir)
    return graph.call_paths(edges, edges.filter("src < 20").select(F.col("src").alias("node")).distinct(), 4)


@query(f"WITH RECURSIVE e AS (SELECT * FROM {FOLLOWS}), w AS (SELECT src AS seed, src AS node, 0 AS distance FROM e WHERE src < 50 GROUP BY src UNION SELECT w.seed, e.dst, w.distance + 1 FROM w JOIN e ON w.node = e.src WHERE w.distance < 3) SELECT seed, node, min(distance) AS distance FROM w WHERE distance > 0 GROUP BY seed, node")
def q_part_hops(spark, sf_dir):
    """Parts within three steps of those of the lowest keys."""
    edges = _follows(spark, sf_dir)
    return graph.k_hop(edges, edges.filter("src < 50").select(F.col("src").alias("node")).distinct(), 3)


@query(f"SELECT p_size > 25 AS is_test, count(*) AS callers FROM (SELECT DISTINCT src FROM {FOLLOWS} JOIN part b ON dst = b.p_partkey AND b.p_size < 10) JOIN part a ON src = a.p_partkey GROUP BY 1")
def q_part_impact(spark, sf_dir):
    """What is bought before small parts, split by size."""
    part = table(spark, sf_dir, "part")
    nodes = part.select(F.col("p_partkey").alias("node"), (F.col("p_size") > 25).alias("is_test"))
    return graph.impact(_follows(spark, sf_dir), part.filter("p_size < 10").select(F.col("p_partkey").alias("node")), nodes)
