"""Review, function and document queries over the inline corpus."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import functions as F

from stratalens.operators import review as R
from stratalens.plans.code_queries import FUNCTIONS, LINES
from stratalens.plans.search_queries import _norm_sql
from stratalens.registry import query, sql_values
from stratalens.sources.corpus import FILES
from stratalens.sources.tables import QA_PAIRS_SQL, qa_pairs, table
from stratalens.functions import text as T


def _files(spark):
    return spark.createDataFrame(FILES, "path string, content string")


@query(f"""WITH b AS (SELECT f.path, f.name, f.line, string_agg(l.content, chr(10) ORDER BY l.line) AS body, count(*) AS n_lines FROM {FUNCTIONS} f JOIN {LINES} l ON l.path = f.path AND l.line BETWEEN f.line AND f.end_line GROUP BY f.path, f.name, f.line),
  m AS (SELECT path, name, n_lines, CASE WHEN trim(regexp_extract(body, '\\(([^)]*)\\)', 1)) = '' THEN 0 ELSE len(string_split(regexp_extract(body, '\\(([^)]*)\\)', 1), ',')) END AS n_params, 1 + len(regexp_extract_all(body, '\\b(?:if|elif|for|while|case|catch|and|or)\\b|&&|\\|\\|')) AS cyclomatic FROM b)
SELECT *, list_filter([CASE WHEN cyclomatic > 25 THEN 'split' END, CASE WHEN cyclomatic > 15 AND cyclomatic <= 25 THEN 'simplify' END, CASE WHEN n_lines > 100 THEN 'shorten' END, CASE WHEN n_params > 6 THEN 'group parameters' END], lambda x: x IS NOT NULL) AS advice FROM m""")
def q_function_report(spark, sf_dir):
    return R.function_report(_files(spark))


DOCUMENTED = [("a.py", "# Adds.\ndef add(a, b):\n    return a\n\ndef sub(a):\n    return a\n"), ("b.go", "// Runs it.\nfunc run() {\n}\n")]


@query(rf"""WITH l AS (SELECT path, content, lag(content) OVER (PARTITION BY path ORDER BY line) AS above FROM (SELECT path, unnest(string_split(content, chr(10))) AS content, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM {sql_values(DOCUMENTED, ['path', 'content'])}))
SELECT path, regexp_extract(content, '(?:def|func)\s+(\w+)', 1) AS name, trim(regexp_replace(above, '^\s*(#|//)', '')) AS comment FROM l WHERE regexp_matches(content, '^(def|func)\s') AND regexp_matches(above, '^\s*(#|//)')""")
def q_comments_above(spark, sf_dir):
    return R.comments_above(spark.createDataFrame(DOCUMENTED, "path string, content string"))


CHANGED = [(1, "src/auth_token.py", "print(1)"), (1, "a b.py", "x = 1 # TODO"), (2, "ok.c", "int x;"), (3, "big.txt", "word " * 30000)]
_CHANGED = sql_values([(p, f, c) for p, f, c in CHANGED], ["pr", "path", "content"])
_FINDINGS = f"""(SELECT pr, path, 'sensitive path' AS finding, 'high' AS severity FROM {_CHANGED} WHERE regexp_matches(lower(path), 'password|secret|key|token|credential|auth') UNION ALL SELECT pr, path, 'large file', 'medium' FROM {_CHANGED} WHERE length(content) > 102400
  UNION ALL SELECT pr, path, 'blank in name', 'low' FROM {_CHANGED} WHERE contains(path, ' ') UNION ALL SELECT pr, path, 'open task', 'low' FROM {_CHANGED} WHERE regexp_matches(content, 'TODO|FIXME') UNION ALL SELECT pr, path, 'printing', 'low' FROM {_CHANGED} WHERE regexp_matches(content, '\\bprint\\s*\\('))"""


@query(f"SELECT * FROM {_FINDINGS}")
def q_review(spark, sf_dir):
    return R.review(spark.createDataFrame(CHANGED, "pr int, path string, content string"))


@query(f"SELECT c.pr, CASE max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END) WHEN 3 THEN 'critical' WHEN 2 THEN 'needs work' WHEN 1 THEN 'minor' ELSE 'clean' END AS verdict, count(f.finding) AS n FROM (SELECT DISTINCT pr FROM {_CHANGED}) c LEFT JOIN {_FINDINGS} f ON f.pr = c.pr GROUP BY c.pr")
def q_review_summary(spark, sf_dir):
    changed = spark.createDataFrame(CHANGED, "pr int, path string, content string")
    return R.summaries(R.review(changed), changed)


NATIVE = [("jni.c", "JNIEXPORT jint JNICALL Java_com_example_Codec_open(JNIEnv *e) {}\nJNIEXPORT void JNICALL Java_com_example_Codec_close(JNIEnv *e) {}")]


@query(f"SELECT path, unnest(regexp_extract_all(content, 'JNICALL\\s+Java_(\\w+)_(\\w+)\\s*\\(', 1)) AS class, unnest(regexp_extract_all(content, 'JNICALL\\s+Java_(\\w+)_(\\w+)\\s*\\(', 2)) AS method FROM {sql_values(NATIVE, ['path', 'content'])}")
def q_native_functions(spark, sf_dir):
    return R.native_functions(spark.createDataFrame(NATIVE, "path string, content string"))


NOTES = [("project.md", "# P\n\n## Overview\nA tool.\nTwo lines.\n## Modules\n| name | lang |\n|---|---|\n| core | go |\n| web | ts |\n")]
_NOTES = sql_values(NOTES, ["path", "content"])


@query(f"SELECT path, trim(regexp_extract(content, '(?s)(?:^|\\n)## Overview\\n(.*?)(?:\\n## |$)', 1)) AS overview FROM {_NOTES}")
def q_section(spark, sf_dir):
    return spark.createDataFrame(NOTES, "path string, content string").select("path", R.section(F.col("content"), "Overview").alias("overview"))


@query(f"SELECT path, line, list_transform(string_split(regexp_replace(trim(content), '^\\||\\|$', '', 'g'), '|'), lambda x: trim(x)) AS cells FROM (SELECT path, unnest(string_split(content, chr(10))) AS content, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM {_NOTES}) WHERE regexp_matches(content, '^\\|.*\\|\\s*$') AND NOT regexp_matches(content, '^\\|[\\s:|-]+\\|\\s*$')")
def q_table_rows(spark, sf_dir):
    return R.table_rows(spark.createDataFrame(NOTES, "path string, content string"))


SIGNATURES = [(1, "int a, char *path"), (2, "self, x=3, y: int = 4"), (3, "")]


@query(f"SELECT id, list_transform(list_filter(string_split(s, ','), lambda x: trim(x) <> ''), lambda x: regexp_extract(trim(regexp_replace(x, '\\s*[=:].*$', '')), '(\\w+)$', 1)) AS names FROM {sql_values(SIGNATURES, ['id', 's'])}")
def q_parameters(spark, sf_dir):
    return spark.createDataFrame(SIGNATURES, "id int, s string").select("id", R.parameters(F.col("s")).alias("names"))


SIGNED = [(1, "{}", "sha256=" + hmac.new(b"k", b"{}", hashlib.sha256).hexdigest()), (2, "{ }", "sha256=" + hmac.new(b"k", b"{}", hashlib.sha256).hexdigest()), (3, "{}", None)]
# The key, filled up with zeros to a block, under the two masks of the construction.
_INNER, _OUTER = ("'" + "".join(f"\\x{b ^ mask:02X}" for b in b"k".ljust(64, b"\0")) + "'::BLOB" for mask in (0x36, 0x5C))


@query(f"SELECT id, coalesce(signature = 'sha256=' || sha256({_OUTER} || unhex(sha256({_INNER} || encode(payload)))), false) AS valid FROM {sql_values(SIGNED, ['id', 'payload', 'signature'])}")
def q_verified(spark, sf_dir):
    return R.verified(spark.createDataFrame(SIGNED, "id int, payload string, signature string"), "k")


_KEY = f"substr(md5({_norm_sql('question')}), 1, 16)"


@query(f"SELECT cache_key, 1 + count(*) AS access_count FROM (SELECT {_KEY} AS cache_key FROM {QA_PAIRS_SQL}) GROUP BY cache_key")
def q_cache_hits(spark, sf_dir):
    """Every question is asked again of a cache in which each has one access."""
    pairs = qa_pairs(table(spark, sf_dir, "conversations"))
    cache = pairs.select(T.cache_key(F.col("question")).alias("cache_key")).distinct().withColumn("access_count", F.lit(1))
    return R.hits(cache, pairs.select(F.col("qa_id").alias("ask_id"), F.col("question").alias("ask")))
