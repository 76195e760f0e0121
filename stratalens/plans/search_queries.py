"""Ranking queries: documents and conversations by text, embeddings by vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import patterns as P
from stratalens.functions import text as T
from stratalens.operators import search
from stratalens.registry import query
from stratalens.sources.tables import QA_PAIRS_SQL, qa_pairs, table

TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')".format
TF = f"(SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK('text')}) AS term FROM documents) GROUP BY ALL)"


def _asked(spark, sf_dir):
    """All items of the benchmark are the queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_ASKED_SQL = "(SELECT item_id AS query_id, text AS query FROM benchmark)"


@query(f"""WITH tf AS {TF}, n AS (SELECT count(*) AS total FROM documents), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  w AS (SELECT doc_id, term, tf * ln(total / (df + 1.0)) AS w FROM tf JOIN df USING (term), n), norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
  q AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({TOK('query')}) AS term FROM {_ASKED_SQL}) GROUP BY ALL),
  qw AS (SELECT query_id, term, tf * ln(total / (coalesce(df, 0) + 1.0)) AS qw FROM q LEFT JOIN df USING (term), n), qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY query_id),
  d AS (SELECT query_id, doc_id, sum(qw * w) AS dot FROM qw JOIN w USING (term) GROUP BY ALL)
SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (
  SELECT query_id, doc_id, round(coalesce(dot / nullif(norm * qnorm, 0), 0), 6) AS score FROM d JOIN norms USING (doc_id) JOIN qn USING (query_id))) WHERE r <= 10""")
def q_tfidf_topk(spark, sf_dir):
    return search.tfidf(table(spark, sf_dir, "documents"), _asked(spark, sf_dir))


@query(f"""WITH tf AS {TF}, s AS (SELECT doc_id, sum(tf) AS size FROM tf GROUP BY doc_id), n AS (SELECT (SELECT count(*) FROM documents) AS total, (SELECT sum(size) FROM s) AS words), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  q AS (SELECT DISTINCT query_id, unnest({TOK('query')}) AS term FROM {_ASKED_SQL})
SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (
  SELECT query_id, doc_id, round(sum(ln((total - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / (words / total)))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN s USING (doc_id), n GROUP BY ALL)) WHERE r <= 10""")
def q_bm25_topk(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents"), _asked(spark, sf_dir))


@query(f"SELECT term, count(DISTINCT conv_id) AS n, list_sort(list(DISTINCT conv_id)) AS keys FROM (SELECT conv_id, unnest({TOK('text')}) AS term FROM conversations) GROUP BY term")
def q_inverted_index(spark, sf_dir):
    by = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).distinct()
    return by.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("conv_id")).alias("keys"))


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOK('text')}) AS term FROM documents) GROUP BY term")
def q_document_frequency(spark, sf_dir):
    return search.document_frequency(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH hits AS (SELECT doc_id, count(DISTINCT term) AS hits FROM (SELECT doc_id, unnest({TOK('text')}) AS term FROM documents) WHERE term IN ('the', 'apache', 'license') GROUP BY doc_id)
SELECT doc_id, hits + CASE WHEN contains(lower(text), 'the apache license') THEN 10 ELSE 0 END AS score FROM hits JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10""")
def q_keyword_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return search.keyword_search(search.inverted_index(docs, "doc_id", "text"), docs, "the apache license")


_COS = "coalesce(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / nullif(sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 0), 0)"


def _query_vector(vectors):
    return list(vectors.filter("vec_id = 0").first()["embedding"])  # one row: the query's input


def _queries(vectors):
    """The stated query set: every row whose id is divisible by 100."""
    return vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _top(where: str) -> str:
    return f"SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (SELECT q.vec_id AS query_id, v.vec_id, round({_COS}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0{where})) WHERE r <= 10"


@query(_top(""))
def q_vector_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return search.vector_search(vectors, _queries(vectors))


@query(_top(" AND v.label = 1"))
def q_vector_topk_filtered(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return search.vector_search(vectors, _queries(vectors), where=F.col("label") == 1)


@query(f"""WITH v AS (SELECT v.vec_id AS id, round({_COS}, 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, v.vec_id LIMIT 20),
  t AS (SELECT doc_id AS id FROM documents WHERE contains(text, 'License') ORDER BY doc_id LIMIT 10)
SELECT id, score FROM (SELECT * FROM v UNION ALL SELECT id, 0.5 FROM t WHERE id NOT IN (SELECT id FROM v)) ORDER BY score DESC, id LIMIT 10""")
def q_hybrid(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    hits = search.vector_top(vectors, _query_vector(vectors), 20).withColumnRenamed("vec_id", "id")
    texts = table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("License"))).orderBy("doc_id").limit(10).select(F.col("doc_id").alias("id"))
    return search.hybrid(hits, texts, 10)


@query(f"SELECT conv_id, turn, {T.first_group_sql('text', P.INTENTS, 'GENERAL')} AS intent, {T.first_group_sql('text', P.DOC_CATEGORIES, 'other')} AS category, {T.first_group_sql('text', P.COMMAND_CATEGORIES, 'other')} AS command_category FROM conversations")
def q_intent_category(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.first_group(c, P.INTENTS, "GENERAL").alias("intent"), T.first_group(c, P.DOC_CATEGORIES, "other").alias("category"), T.first_group(c, P.COMMAND_CATEGORIES, "other").alias("command_category"))


def _norm_sql(column: str) -> str:
    out = f"lower(trim({column}))"
    for p, r in P.QUESTION_REWRITES:
        out = f"regexp_replace({out}, '{p}', '{r}', 'g')"
    return f"regexp_replace(trim(regexp_replace({out}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '[，。！、；：【】（）]', '', 'g')"


@query(f"""SELECT cache_key, min(qa_id) AS first_id, max(qa_id) AS last_id, count(*) AS n FROM (SELECT qa_id, substr(md5({_norm_sql('question')}), 1, 16) AS cache_key FROM {QA_PAIRS_SQL}) GROUP BY cache_key""")
def q_qa_pairs_dedup(spark, sf_dir):
    pairs = qa_pairs(table(spark, sf_dir, "conversations"))
    return pairs.select("qa_id", T.cache_key(F.col("question")).alias("cache_key")).groupBy("cache_key").agg(F.min("qa_id").alias("first_id"), F.max("qa_id").alias("last_id"), F.count(F.lit(1)).alias("n"))


def _chars(c: str) -> str:
    return f"list_distinct(list_filter(string_split({c}, ''), lambda x: x <> ''))"


@query(f"""WITH a AS (SELECT conv_id * 1000 + turn AS ask_id, {_chars(_norm_sql('text'))} AS a, {T.first_group_sql('text', P.INTENTS, 'GENERAL')} AS i FROM conversations WHERE role = 'user'),
  k AS (SELECT item_id AS id, {_chars(_norm_sql('text'))} AS b, {T.first_group_sql('text', P.INTENTS, 'GENERAL')} AS j FROM benchmark),
  s AS (SELECT ask_id, id, round(CASE WHEN i = j THEN sim + 0.1 ELSE sim * 0.8 END, 6) AS score FROM (SELECT ask_id, id, i, j, len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) AS sim FROM a, k))
SELECT ask_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY score DESC, id) AS r FROM s WHERE score >= 0.6) WHERE r = 1""")
def q_find_similar(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ask_id"), F.col("text").alias("ask"))
    known = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    return search.similar_question(asked, known)


_WORDS = "list_distinct(list_filter(string_split_regex(lower(trim({})), '\\s+'), lambda x: x <> ''))".format


@query(f"""SELECT a.turn AS turn_a, b.turn AS turn_b, a.conv_id AS conv_id, round(len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE), 6) AS score FROM
  (SELECT conv_id, turn, {_WORDS('text')} AS w FROM conversations) a JOIN (SELECT conv_id, turn, {_WORDS('text')} AS w FROM conversations) b ON a.conv_id = b.conv_id AND a.turn < b.turn""")
def q_word_jaccard_pairs(spark, sf_dir):
    """Turns of one conversation, pair by pair (a conversation has a few turns)."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("w"))
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") < F.col("b.turn")))
    return both.select(F.col("a.turn").alias("turn_a"), F.col("b.turn").alias("turn_b"), F.col("a.conv_id").alias("conv_id"), F.round(T.jaccard(F.col("a.w"), F.col("b.w")), 6).alias("score"))


@query("SELECT doc_id, list_transform(range(0, 8), lambda i: round(CAST(('0x' || substr(sha256(text), CAST(1 + 8 * i AS INTEGER), 8)) AS BIGINT) / 4294967296.0, 6)) AS v FROM documents")
def q_pseudo_embedding(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(T.pseudo_embedding(F.col("text"), 8), lambda x: F.round(x, 6)).alias("v"))


@query("SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[a-zA-Z0-9_/.-]+\\.(?:py|js|ts|tsx|jsx|java|go|rs|c|cpp|h|hpp|cs|swift|kt|md|yaml|yml|json|toml)'))[1:10] AS refs FROM conversations WHERE regexp_matches(text, '[a-zA-Z0-9_/.-]+\\.(?:py|js|ts|tsx|jsx|java|go|rs|c|cpp|h|hpp|cs|swift|kt|md|yaml|yml|json|toml)')")
def q_file_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.file_refs(F.col("text")).alias("refs"))
    return refs.filter(F.size("refs") > 0)


@query("""SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(substr(text, 1, 30), '[^\\p{L}\\p{N}_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), ''), 'question') AS slug,
  CASE WHEN regexp_matches(source, '^[0-9]') THEN 'n' ELSE '' END || regexp_replace(source, '[^a-zA-Z0-9_]', '_', 'g') AS node, md5(text) AS md5 FROM documents""")
def q_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"), T.diagram_id(F.col("source")).alias("node"), F.md5("text").alias("md5"))
