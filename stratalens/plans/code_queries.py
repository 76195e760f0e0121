"""Code queries over the inline corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import patterns as P
from stratalens.operators import code as K
from stratalens.operators import scan
from stratalens.registry import query, sql_values
from stratalens.sources.corpus import FILES, MANIFESTS

SRC = sql_values(FILES, ["path", "content"])
LANG = "CASE regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in P.SOURCE_LANGUAGES.items()) + " END"
LINES = f"(SELECT path, {LANG} AS lang, unnest(string_split(content, chr(10))) AS content, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM {SRC})"
_q = lambda p: "$p$" + p + "$p$"
_rules = lambda rules: "coalesce(" + ", ".join(f"CASE WHEN lang = '{g}' AND regexp_matches(content, {_q(p)}) THEN regexp_extract(content, {_q(p)}, {i}) END" for g, p, i in rules) + ")"
FUNCTIONS = f"""(SELECT path, lang, name, line, coalesce(lead(line) OVER (PARTITION BY path ORDER BY line) - 1, total) AS end_line FROM (SELECT path, lang, line, {_rules(P.FUNCTIONS)} AS name FROM {LINES})
  JOIN (SELECT path, len(string_split(content, chr(10))) AS total FROM {SRC}) USING (path) WHERE name IS NOT NULL AND name NOT IN ({', '.join(repr(k) for k in P.NOT_FUNCTIONS)}))"""


def _files(spark):
    return spark.createDataFrame(FILES, "path string, content string")


@query(f"SELECT * FROM {FUNCTIONS}")
def q_functions(spark, sf_dir):
    return K.functions(_files(spark))


@query(f"SELECT path, trim(module) AS module FROM (SELECT path, {_rules(P.IMPORTS)} AS module FROM {LINES}) WHERE module IS NOT NULL")
def q_imports(spark, sf_dir):
    return K.imports(_files(spark))


@query(f"""WITH f AS (SELECT * FROM {FUNCTIONS}), t AS (SELECT path, line, unnest(list_distinct(regexp_extract_all(content, '\\b(\\w+)\\s*\\(', 1))) AS dst FROM {LINES} WHERE lang IS NOT NULL)
SELECT t.path, f.name AS src, t.dst, t.line FROM t JOIN f ON t.path = f.path AND t.line BETWEEN f.line AND f.end_line WHERE f.name <> t.dst AND EXISTS (SELECT 1 FROM f g WHERE g.path = t.path AND g.name = t.dst)""")
def q_calls(spark, sf_dir):
    return K.calls(_files(spark))


@query(f"""SELECT path, line, regexp_extract(content, {_q(P.TODO_COMMENT)}, 1) AS type, trim(regexp_extract(content, {_q(P.TODO_COMMENT)}, 2)) AS text, nullif(trim(regexp_extract(content, {_q(P.TODO_COMMENT)}, 3)), '') AS author,
  CASE WHEN regexp_matches(lower(regexp_extract(content, {_q(P.TODO_COMMENT)}, 2)), '{'|'.join(P.TODO_HIGH)}') THEN 'high' WHEN regexp_matches(lower(regexp_extract(content, {_q(P.TODO_COMMENT)}, 2)), '{'|'.join(P.TODO_LOW)}') THEN 'low' ELSE 'medium' END AS priority FROM {LINES} WHERE regexp_matches(content, {_q(P.TODO_COMMENT)})""")
def q_todos(spark, sf_dir):
    return scan.todos(_files(spark), "path", "content")


_NAME = "regexp_extract(path, '([^/]+)$', 1)"
TESTS = f"(SELECT path, content, coalesce({', '.join(f'''CASE WHEN regexp_matches({_NAME}, {_q('^(?:' + p + ')')}) THEN '{f}' END''' for f, p, _ in P.TEST_FRAMEWORKS)}) AS framework FROM {SRC})"


@query(f"SELECT path, framework, CASE framework {' '.join(f'''WHEN '{f}' THEN len(regexp_extract_all(content, {_q(c)}))''' for f, _, c in P.TEST_FRAMEWORKS)} END AS cases FROM {TESTS} WHERE framework IS NOT NULL")
def q_test_files(spark, sf_dir):
    return K.test_files(_files(spark))


_STEM = "regexp_extract(path, '([^/]+)\\.[A-Za-z0-9]+$', 1)"


@query(f"""WITH t AS (SELECT path, regexp_replace(regexp_replace({_STEM}, '^test_|_test$|\\.(test|spec)$', ''), 'Tests?$', '') AS stem FROM {TESTS} WHERE framework IS NOT NULL)
SELECT path, {_STEM} IN (SELECT stem FROM t) AS covered FROM {SRC} WHERE {LANG} IS NOT NULL AND path NOT IN (SELECT path FROM t)""")
def q_coverage(spark, sf_dir):
    return K.coverage(_files(spark))


@query("SELECT name, path, line, " + " OR ".join(f"contains(lower(name), '{k}')" for k in P.SECRET_NAMES) + " AS is_secret FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, line) AS r FROM (" + " UNION ALL ".join(f"SELECT path, line, unnest(regexp_extract_all(content, {_q(p)}, 1)) AS name FROM {LINES}" for p in P.ENVIRONMENT) + ")) WHERE r = 1")
def q_environment(spark, sf_dir):
    return K.environment(_files(spark))


@query()
def q_syntax(spark, sf_dir):
    """Python's own parser; SQL has none."""
    return K.syntax(_files(spark))


@query(rf"""WITH RECURSIVE l AS (SELECT path, line, trim(content) <> '' AND NOT regexp_matches(content, '^\s') AS open FROM {LINES}), n AS (SELECT path, max(line) AS n FROM l GROUP BY path),
  c AS (SELECT path, 0 AS chunk, 1 AS low FROM n UNION ALL SELECT path, chunk + 1, low FROM (SELECT c.path, c.chunk, min(l.line) AS low FROM c JOIN l ON l.path = c.path AND l.open AND l.line - c.low >= 10 GROUP BY c.path, c.chunk))
SELECT path, chunk, low, coalesce(lead(low) OVER (PARTITION BY path ORDER BY chunk) - 1, n) AS high FROM c JOIN n USING (path)""")
def q_chunks(spark, sf_dir):
    return K.chunks(_files(spark))


@query(rf"""WITH d AS (SELECT path, line, len(regexp_extract_all(content, '\{{')) - len(regexp_extract_all(content, '\}}')) AS d FROM {LINES}), s AS (SELECT path, line, sum(d) OVER (PARTITION BY path ORDER BY line) AS s FROM d),
  r AS (SELECT path, s - least(0, min(s) OVER (PARTITION BY path ORDER BY line)) AS level FROM s) SELECT path, CAST(greatest(0, max(level)) AS INTEGER) AS deepest, greatest(0, max(level)) > 3 AS too_deep FROM r GROUP BY path""")
def q_nesting(spark, sf_dir):
    """The level, which never falls below 0, is the running sum less its least value so far where that is below 0."""
    return scan.nesting(_files(spark), "path", "content")


ALL = sql_values([(p.split("/")[0], p) for p, _ in FILES + MANIFESTS], ["project", "path"])
_DEPTH = "(length(path) - length(replace(path, '/', '')))"


def _projects(spark):
    return spark.createDataFrame([(p.split("/")[0], p) for p, _ in FILES + MANIFESTS], "project string, path string")


@query("SELECT project, language, round(score, 6) AS score FROM (SELECT project, language, score, row_number() OVER (PARTITION BY project ORDER BY round(score, 9) DESC, first) AS r FROM (SELECT project, language, sum(w * (1.0 - " + _DEPTH + " * 0.1)) AS score, min(path) AS first FROM " + ALL + " JOIN " + sql_values([(e, n, float(w)) for e, (n, w) in P.LANGUAGE_WEIGHTS.items()], ["ext", "language", "w"]).replace("AS t(", "AS x(") + " ON ext = lower(regexp_extract(path, '(\\.[A-Za-z0-9]+)$', 1)) WHERE NOT ends_with(language, '-header') GROUP BY project, language)) WHERE r = 1")
def q_language_vote(spark, sf_dir):
    return K.language_vote(_projects(spark))


@query("SELECT project, coalesce(arg_min(system, rank), 'unknown') AS build_system FROM " + ALL + " LEFT JOIN " + sql_values([(i, "^" + p.replace(".", "[.]").replace("*", ".*") + "$", s) for i, (p, s) in enumerate(P.BUILD_FILES)], ["rank", "pattern", "system"]).replace("AS t(", "AS b(") + f" ON regexp_matches({_NAME}, pattern) GROUP BY project")
def q_build_system(spark, sf_dir):
    return K.build_system(_projects(spark))


@query(f"SELECT path, line, rule FROM (" + " UNION ALL ".join(f"SELECT path, line, '{r}' AS rule FROM {LINES} WHERE regexp_matches(content, {_q(p)}){'' if langs is None else ' AND lang IN (' + ', '.join(repr(x) for x in langs) + ')'}" for r, s, p, langs in P.SECURITY_RULES) + ")")  # noqa: F541
def q_code_security(spark, sf_dir):
    return scan.security_issues(K.with_language(_files(spark)), "path", "content").drop("severity")
