"""Checks of documents and changed files, risk summaries and index sizes, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import validation as V
from stratalens.plans.scan_queries import q_risk
from stratalens.registry import ORACLE, query
from stratalens.sources.tables import table

#: Project documents made of the texts: which headings, fields and tables they have depends on a text's size, language, source and label.
_PARTS = [("# 基本信息", "n_chars > 400"), ("## 目录结构", "lang <> 'fr'"), ("## 模块划分", "n_chars > 900"), ("# 入口点", "source <> 'src3'"), ("## 构建指南", "true"), ("## 配置文件", "n_chars < 9000"), ("项目名称", "lang = 'en'"), ("项目类型", "n_chars > 2000"), ("主要语言", "lang <> 'de'"), ("| a | --- |", "n_chars > 700")]
_CONTENT = " || ".join(["text", *[f"CASE WHEN {c} THEN '\n{p}' ELSE '' END" for p, c in _PARTS]])
_DOCUMENTS = f"SELECT doc_id AS key, CASE WHEN source <> 'src0' THEN {_CONTENT} END AS content, CASE WHEN source = 'src1' THEN {{a}}'PROJECT.md', 'other.md'{{b}} WHEN source = 'src2' THEN {{a}}'README_PROJECT.md', 'project.md'{{b}} END AS misplaced FROM documents"


def _has(what: str) -> str:
    return f"contains(content, '{what}')"


_SECTIONS = ", ".join(f"CASE WHEN content IS NOT NULL AND NOT ({_has('# ' + s)}) THEN 'section: {s}' END" for s in V.SECTIONS)
_FIELDS = ", ".join(f"CASE WHEN content IS NOT NULL AND NOT {_has(f)} THEN 'field: {f}' END" for f in V.FIELDS)
_PASSED = " + ".join(f"CAST(coalesce({_has('# ' + s)}, false) AS INTEGER)" for s in V.SECTIONS)
_TABLE = f"({_has('|')} AND {_has('---')})"


@query(f"""WITH d AS ({_DOCUMENTS.format(a='[', b=']')}), e AS (SELECT key, list_filter(list_concat(list_transform(list_filter({V.WRONG_NAMES}, lambda n: list_contains(coalesce(misplaced, []), n)), lambda n: 'misplaced: ' || n), [CASE WHEN content IS NULL THEN 'missing' END, {_SECTIONS}, CASE WHEN content IS NOT NULL AND NOT {_TABLE} THEN 'table' END]), lambda x: x IS NOT NULL) AS errors,
  list_filter([{_FIELDS}], lambda x: x IS NOT NULL) AS warnings, 1 + CAST(content IS NOT NULL AS INTEGER) + {_PASSED} + CAST(coalesce({_TABLE}, false) AS INTEGER) AS passed FROM d)
SELECT key, len(errors) = 0 AS valid, errors, warnings, passed FROM e""")
def q_validated(spark, sf_dir):
    """Project documents checked for place, sections, fields and a table."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("__validated")
    return V.validated(spark.sql(_DOCUMENTS.format(a="array(", b=")").replace("FROM documents", "FROM __validated")))


#: Changed files made of the texts: secrets by other names, two symbols as braces, paths by source and language.
_FILES = r"""SELECT CASE WHEN source = 'src4' THEN 'conf/.env.' WHEN source = 'src5' THEN 'my Token/' WHEN source = 'src6' THEN 'src/a b/' ELSE 'src/' END || doc_id AS path,
  replace(replace(translate(repeat(text, CASE WHEN n_chars > 15000 THEN 8 ELSE 1 END), '#$', '{}'), 'token = ', CASE WHEN lang = 'en' THEN 'Password: ' WHEN lang = 'fr' THEN 'api-key=' ELSE 'token = ' END), 'token =', 'PWD =') AS content FROM documents"""
_LOW = ", ".join(f"CASE WHEN contains(lower(path), '{p}') THEN '{p}' END" for p in V.SENSITIVE_PARTS)


def _found(pattern: str, message: str) -> str:
    """Each match with the breaks of everything before it: the text is cut at the matches."""
    p = pattern.replace("'", "''").replace("[ \\t\\n\\x0B\\f\\r]*", "[ \\t\\n\\v\\f\\r]*")
    cut = f"(SELECT path, string_split_regex(content, '{p}') AS a, regexp_extract_all(content, '{p}') AS b FROM f)"
    breaks = "(length(array_to_string({0}, '')) - length(replace(array_to_string({0}, ''), chr(10), '')))".format
    return f"SELECT path, CAST(1 + {breaks('a[1:i]')} + {breaks('b[1:i - 1]')} AS INTEGER) AS line, 'error' AS severity, 'security' AS category, '{message}' AS message FROM (SELECT path, a, b, unnest(range(1, len(b) + 1)) AS i FROM {cut})"


_DEPTH = "SELECT path, max(d) AS deepest FROM (SELECT path, now - least(0, min(now) OVER (PARTITION BY path ORDER BY i)) AS d FROM (SELECT path, i, sum(CASE WHEN c = '{' THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY i) AS now FROM (SELECT path, generate_subscripts(cs, 1) AS i, unnest(cs) AS c FROM (SELECT path, regexp_extract_all(content, '[{}]') AS cs FROM f)))) GROUP BY path"


@query(f"""WITH f AS ({_FILES})
SELECT path, CAST(0 AS INTEGER) AS line, 'warning' AS severity, 'security' AS category, 'sensitive path: ' || coalesce({_LOW}) AS message FROM f WHERE coalesce({_LOW}) IS NOT NULL
UNION ALL {_found(V.PASSWORD, 'password in the content')} UNION ALL {_found(V.API_KEY, 'API key in the content')}
UNION ALL SELECT path, 0, 'info', 'performance', 'large file' FROM f WHERE strlen(content) > {V.LARGE_BYTES}
UNION ALL SELECT path, 0, 'warning', 'performance', 'deep nesting' FROM ({_DEPTH}) WHERE deepest > {V.DEEP}
UNION ALL SELECT path, 0, 'info', 'style', 'blank in the name' FROM f WHERE contains(path, ' ')""")
def q_file_checks(spark, sf_dir):
    """Suggestions for every document as a changed file."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("__files")
    return V.file_checks(spark.sql(_FILES.replace("FROM documents", "FROM __files")))


@query(f"""WITH r AS ({ORACLE['q_risk']}), l AS (SELECT level, count(*) AS n FROM r GROUP BY level)
SELECT CAST(sum(n) AS BIGINT) AS files, (SELECT list_sort(list(level || ': ' || n)) FROM l) AS levels, CAST(coalesce(sum(n) FILTER (level IN ('high', 'critical')), 0) AS BIGINT) AS high, round((SELECT avg(score) FROM r), 6) AS mean_score,
  list_filter([CASE WHEN coalesce(sum(n) FILTER (level IN ('high', 'critical')), 0) > sum(n) * 0.2 THEN 'refactor: over 20 % of files are of high risk' END, CASE WHEN (SELECT count(*) FROM r WHERE 1 - coverage > 0.8) > sum(n) * 0.5 THEN 'test: over 50 % of files lack coverage' END], lambda x: x IS NOT NULL) AS advice FROM l""")
def q_project_risk(spark, sf_dir):
    """The summary of all documents' risks, whose levels the risk operator gives."""
    found = V.risk_summary(q_risk(spark, sf_dir))
    return found.withColumn("mean_score", F.round("mean_score", 6))


@query("SELECT source, files, lines, CAST(files * lines * 100 * 0.3 AS BIGINT) AS estimate, CAST(files * 200 * 100 * 0.3 AS BIGINT) AS by_default FROM (SELECT source, count(*) AS files, CAST(ceil(avg(length(text) - length(replace(text, chr(10), '')) + 1)) AS BIGINT) AS lines FROM documents GROUP BY source)")
def q_index_size(spark, sf_dir):
    """Estimated sizes of an index over each source's documents, by their lines and by the default."""
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    by = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.ceil(F.avg(lines)).alias("lines"))
    return by.select("source", "files", "lines", V.index_size(F.col("files"), F.col("lines")).alias("estimate"), V.index_size(F.col("files")).alias("by_default"))
