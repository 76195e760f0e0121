"""Scan and quality queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import patterns as P
from stratalens.functions import text as T
from stratalens.operators import scan
from stratalens.registry import query
from stratalens.sources.tables import lines, table

LINES = "(SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"
_q = lambda p: "$p$" + p + "$p$"


def _masked(column: str) -> str:
    out = column
    for _, _, p, g in P.SECRETS:
        out = f"regexp_replace({out}, {_q(p)}, {_q(chr(92) + '1=' + chr(34) + '***MASKED***' + chr(34)) if g >= 2 else _q('***MASKED***')}, 'g')"
    return out


@query(f"SELECT doc_id, line, type, severity, original, {_masked('original')} AS masked FROM (" + " UNION ALL ".join(f"SELECT doc_id, line, '{t}' AS type, '{s}' AS severity, unnest(regexp_extract_all(content, {_q(p)})) AS original FROM {LINES}" for t, s, p, _ in P.SECRETS) + ")")
def q_secret_scan(spark, sf_dir):
    return scan.secrets(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, md5({_masked('text')}) AS masked_md5 FROM documents")
def q_mask_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.mask(F.col("text"))).alias("masked_md5"))


@query("SELECT doc_id, line, type, regexp_replace(substr(content, 1, 50), '[a-zA-Z0-9]{10,}', 'REDACTED', 'g') AS snippet FROM (" + " UNION ALL ".join(f"SELECT doc_id, line, '{t}' AS type, content FROM {LINES} WHERE regexp_matches(content, {_q(p)})" for t, p in P.SECRET_VALUES) + ")")
def q_secret_values(spark, sf_dir):
    return scan.secret_values(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, len(l) AS n_lines, len(list_filter(l, lambda x: trim(x) = '')) AS n_blank, length(text) AS n_chars, list_max(list_transform(l, lambda x: length(x))) AS longest FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)")
def q_line_stats(spark, sf_dir):
    return scan.line_stats(table(spark, sf_dir, "documents"))


@query("SELECT lang, source, count(*) AS n_files, sum(n_chars) AS total_size, sum(length(text) - length(replace(text, chr(10), '')) + 1) AS total_lines FROM documents GROUP BY lang, source")
def q_files_by_type(spark, sf_dir):
    n = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_chars").alias("total_size"), F.sum(n).alias("total_lines"))


@query(f"SELECT doc_id, line, rule, severity FROM (" + " UNION ALL ".join(f"SELECT doc_id, line, '{r}' AS rule, '{s}' AS severity FROM {LINES} WHERE regexp_matches(content, {_q(p)}){'' if langs is None else ' AND lang IN (' + ', '.join(repr(x) for x in langs) + ')'}" for r, s, p, langs in P.SECURITY_RULES) + ")")  # noqa: F541
def q_security_issues(spark, sf_dir):
    return scan.security_issues(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, line, 'long_line' AS smell FROM {LINES} WHERE length(content) > 120 UNION ALL SELECT doc_id, line, 'todo_fixme' FROM {LINES} WHERE regexp_matches(content, '(TODO|FIXME|XXX|HACK)')")
def q_smells(spark, sf_dir):
    return scan.smells(table(spark, sf_dir, "documents")).filter("smell <> 'magic_number'")


_NUMBER = _q(r"(?s)(.?)\b(\d{2,})\b(\s*[;)\]])?")
# Numbers of two digits or more without a quote before and a closing mark behind.
_MAGIC = f"len(list_filter(list_zip(regexp_extract_all(content, {_NUMBER}, 1), regexp_extract_all(content, {_NUMBER}, 2), regexp_extract_all(content, {_NUMBER}, 3)), lambda x: coalesce(x[1], '') NOT IN (chr(34), chr(39)) AND coalesce(x[3], '') = '' AND length(x[2]) <= 16 AND TRY_CAST(x[2] AS BIGINT) > 10)) > 0"


@query(f"SELECT doc_id, count(*) AS count FROM {LINES} WHERE {_MAGIC} GROUP BY doc_id")
def q_magic_numbers(spark, sf_dir):
    return scan.smells(table(spark, sf_dir, "documents")).filter("smell = 'magic_number'").groupBy("doc_id").count()


@query(f"""SELECT doc_id, min(line) AS start_line, min(line) + 5 AS end_line, count(*) AS n FROM (
  SELECT doc_id, line, trim(regexp_replace(regexp_replace(b, '\\s+', ' ', 'g'), '//.*|/\\*.*?\\*/|#.*', '', 'g')) AS b FROM (
    SELECT doc_id, line, content || chr(10) || lead(content, 1) OVER w || chr(10) || lead(content, 2) OVER w || chr(10) || lead(content, 3) OVER w || chr(10) || lead(content, 4) OVER w AS b FROM {LINES} WINDOW w AS (PARTITION BY doc_id ORDER BY line)) WHERE b IS NOT NULL)
  WHERE b <> '' GROUP BY doc_id, b HAVING count(*) > 1""")
def q_duplicate_blocks(spark, sf_dir):
    return scan.duplicate_blocks(table(spark, sf_dir, "documents"))


_CX = "greatest(0, 100 - (" + " + ".join(f"least(len(regexp_extract_all(text, {_q(p)})) * 2, 20)" for p in P.COMPLEXITY) + "))"


@query(f"SELECT doc_id, {_CX} AS complexity FROM documents")
def q_complexity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.complexity_score(F.col("text")).alias("complexity"))


@query("""SELECT doc_id, round(greatest(0, 100 - least(long * 0.5, 20) - greatest(average - 80, 0) * 0.2 - CASE WHEN blank < 0.1 THEN 10 ELSE 0 END), 6) AS readability FROM (
  SELECT doc_id, len(list_filter(l, lambda x: length(x) > 120)) AS long, list_sum(list_transform(l, lambda x: length(x))) / CAST(len(l) AS DOUBLE) AS average, len(list_filter(l, lambda x: trim(x) = '')) / CAST(len(l) AS DOUBLE) AS blank
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def q_readability(spark, sf_dir):
    return scan.quality(table(spark, sf_dir, "documents")).select("doc_id", F.round("readability", 6).alias("readability"))


_SECURITY = ("SELECT doc_id, greatest(0, 100 - sum(p)) AS security FROM (SELECT doc_id, 0 AS p FROM documents UNION ALL " + " UNION ALL ".join(f"SELECT doc_id, { {'critical': 30, 'error': 15, 'warning': 5}[s]} FROM {LINES} WHERE regexp_matches(content, {_q(p)}){'' if langs is None else ' AND lang IN (' + ', '.join(repr(x) for x in langs) + ')'}" for _, s, p, langs in P.SECURITY_RULES) + ") GROUP BY doc_id")


@query(_SECURITY)
def q_security_score(spark, sf_dir):
    return scan.quality(table(spark, sf_dir, "documents")).select("doc_id", F.col("security").cast("long").alias("security"))


@query(f"""WITH l AS (SELECT doc_id, count(*) AS n, count(*) FILTER (length(content) > 120) AS long, sum(length(content)) AS chars, count(*) FILTER (trim(content) = '') AS blank, count(*) FILTER ({_MAGIC}) AS magic, count(*) FILTER (regexp_matches(content, 'TODO|FIXME|XXX|HACK')) AS tasks FROM {LINES} GROUP BY doc_id),
  s AS ({_SECURITY}), q AS (SELECT doc_id, CAST({_CX} AS DOUBLE) AS complexity, greatest(0, 100 - least(long * 0.5, 20) - greatest(chars / n - 80, 0) * 0.2 - CASE WHEN blank / n < 0.1 THEN 10 ELSE 0 END) AS readability, long + magic + tasks AS smells, tasks, CAST(security AS DOUBLE) AS security FROM documents JOIN l USING (doc_id) JOIN s USING (doc_id))
SELECT doc_id, complexity, round(readability, 6) AS readability, round(maintainability, 6) AS maintainability, security, CAST(round(CAST(CAST(maintainability * 0.3::DOUBLE + readability * 0.25::DOUBLE + complexity * 0.25::DOUBLE + security * 0.2::DOUBLE AS VARCHAR) AS DECIMAL(30, 16)), 2) AS DOUBLE) AS overall FROM (SELECT *, greatest(0.0, (100 - least(smells * 2, 30)) * complexity / 100 - tasks) AS maintainability FROM q)""")
def q_quality(spark, sf_dir):
    found = scan.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "complexity", F.round("readability", 6).alias("readability"), F.round("maintainability", 6).alias("maintainability"), "security", "overall")


@query(f"""SELECT doc_id, CASE WHEN r < .25 THEN 'low' WHEN r < .5 THEN 'medium' WHEN r < .75 THEN 'high' ELSE 'critical' END AS level, round(r * 100, 2) AS score, complexity, coverage, changes, commits, n_lines FROM (
  SELECT *, round(.30 * least(1.0, complexity / 30.0) + .25 * (1 - coverage) + .20 * least(1.0, changes / 10.0) + .15 * (1 - least(1.0, commits / 20.0)) + .10 * least(1.0, n_lines / 500.0), 6) AS r FROM (
    SELECT d.doc_id, 100 - {_CX} AS complexity, CAST(coalesce(l.quality, 0) AS DOUBLE) AS coverage, coalesce(e.changes, 0) AS changes, coalesce(e.commits, 0) AS commits, length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS n_lines
    FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc_id, count(*) AS changes, count(DISTINCT user_id) AS commits FROM events GROUP BY 1) e USING (doc_id)))""")
def q_risk(spark, sf_dir):
    docs, labels, events = (table(spark, sf_dir, n) for n in ("documents", "labels", "events"))
    changes = events.groupBy(F.get_json_object("props", "$.k").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("user_id").alias("commits"))
    n = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    facts = docs.select("doc_id", (100 - T.complexity_score(F.col("text"))).alias("complexity"), n.alias("n_lines")).join(labels.select("doc_id", "quality"), "doc_id", "left").join(changes, "doc_id", "left")
    facts = facts.select("doc_id", "complexity", F.coalesce("quality", F.lit(0)).cast("double").alias("coverage"), F.coalesce("changes", F.lit(0)).alias("changes"), F.coalesce("commits", F.lit(0)).alias("commits"), "n_lines")
    return scan.risk(facts)


@query("""SELECT level, n, round(100.0 * n / sum(n) OVER (), 6) AS share FROM (SELECT CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM labels GROUP BY 1)""")
def q_risk_summary(spark, sf_dir):
    level = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("low")
    by = table(spark, sf_dir, "labels").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(total)).select("level", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("share"))


@query("SELECT doc_id, CAST(max((length(content) - length(ltrim(content, ' '))) // 4) AS INTEGER) AS depth FROM " + LINES + " GROUP BY doc_id")
def q_indent_depth(spark, sf_dir):
    return scan.indent_depth(table(spark, sf_dir, "documents"))


@query(f"""SELECT doc_id, greatest(0, 100 - sum(CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 1 END)) AS score, count(*) AS n_findings FROM (
  {" UNION ALL ".join(f"SELECT doc_id, '{s}' AS severity, unnest(regexp_extract_all(content, {_q(p)})) AS original FROM {LINES}" for t, s, p, _ in P.SECRETS)}) GROUP BY doc_id""")
def q_review_score(spark, sf_dir):
    return scan.review_score(scan.secrets(table(spark, sf_dir, "documents")), "doc_id")


@query("SELECT conv_id, turn, len(regexp_extract_all(text, '[A-Za-z]+')) AS n_words, regexp_matches(lower(text), 'test|spec') AS is_test FROM conversations")
def q_grep(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_count("text", F.lit("[A-Za-z]+")).alias("n_words"), F.lower("text").rlike("test|spec").alias("is_test"))


@query(f"SELECT doc_id, line, content FROM {LINES} WHERE regexp_matches(content, '^(Licensed|Copyright)')")
def q_license_lines(spark, sf_dir):
    return lines(table(spark, sf_dir, "documents")).filter(F.col("content").rlike("^(Licensed|Copyright)"))
