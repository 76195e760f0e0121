"""SQL (DuckDB) for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from stratalens.llm.media import ROW, WIDTH
from stratalens.llm.quality import ALPHA, DELTA, GRIDS, LEVELS

_WORD = r"'[^\x20\x09-\x0D]+'"


def _severity() -> str:
    ratios = {"symbols_per_word": "n_symbols", "repeated_share": "n_repeat_words", "dup_lines_per_word": "n_dup_lines", "chars_per_word": "word_chars"}
    each = ["(" + " + ".join(f"CAST(CAST({ratios[k]} AS DOUBLE) / greatest(n_words, 1) >= {c} AS INTEGER)" for c in grid) + ")" for k, grid in GRIDS.items()]
    return f"greatest({', '.join(each)})"


QUALITY = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w, row_number() OVER () AS rid FROM documents),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS l FROM t),
g AS (SELECT rid, i, array_to_string(w[i : i + 7], chr(31)) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
b AS (SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM t JOIN l USING (rid) LEFT JOIN r USING (rid)),
s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {_severity()} AS severity FROM b),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1),
c AS (SELECT stratum, level, count(*) AS n, count(*) FILTER (severity >= level) AS k FROM s JOIN good USING (doc_id), (SELECT unnest(range(1, {LEVELS + 1})) AS level) WHERE NOT base_failed GROUP BY stratum, level),
p AS (SELECT stratum, level, k <= {ALPHA} * n AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) <= {DELTA} / (SELECT count(DISTINCT stratum) FROM s) AS ok FROM c),
q AS (SELECT stratum, coalesce(max(level) FILTER (NOT ok), 0) + 1 AS cutoff FROM p GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND severity < coalesce(cutoff, {LEVELS + 1}) AS kept, stratum, severity, coalesce(cutoff, {LEVELS + 1}) AS cutoff FROM s LEFT JOIN q USING (stratum)
"""

NEAR = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || chr(31) || w[i + 1]) ELSE [w[1]] END) AS s FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id WHERE 10 * least(na.n, nb.n) >= 8 * greatest(na.n, nb.n) GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
r AS (SELECT doc_id AS x, doc_id AS y FROM t UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY x) LEFT JOIN n USING (doc_id)
"""

#: Sizes and targets of the mix: with sources in the order of 3 size / weight, the first k are at their limit where the rest's share of
#: what is left, by weight, is no more than the next one's limit.
MIX_TARGETS = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, 3.0 * s / w AS most, row_number() OVER (ORDER BY 3.0 * s / w, source NULLS LAST) AS k, (SELECT sum(s) FROM s) AS total, (SELECT sum(w) FROM s) AS weights FROM s),
c AS (SELECT *, (total - coalesce(sum(3 * s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(weights - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS share FROM o),
f AS (SELECT min(k) AS k, arg_min(share, k) AS share FROM c WHERE share <= most)
SELECT doc_id, size, CAST(c.s AS BIGINT) AS source_size, round(CASE WHEN c.k < coalesce(f.k, 1e18) THEN 3.0 * c.s ELSE w * f.share END, 4) AS target FROM d JOIN c ON c.source IS NOT DISTINCT FROM d.source, f
"""

_DIGITS = "regexp_replace({}, '[^0-9]', '', 'g')".format
#: Counts of the fixed patterns; cards pass when their digits, every second one from the right doubled, add up to a multiple of ten.
PII_COUNTS = rf"""
SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
CAST(len(list_filter(regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda m: len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || left(ltrim(p, '0'), 3) AS INTEGER) > 255)) = 0)) AS BIGINT) AS n_ip,
CAST(len(list_filter(list_transform(regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+'), lambda m: {_DIGITS('m')}), lambda x: length(x) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(x)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(x[length(x) - i] AS INTEGER) ELSE (2 * CAST(x[length(x) - i] AS INTEGER)) // 10 + (2 * CAST(x[length(x) - i] AS INTEGER)) % 10 END)) % 10 = 0)) AS BIGINT) AS n_card,
CAST(len(list_filter(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda m: length({_DIGITS('m')}) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

#: The reflected checksum of polynomial 0xEDB88320: its table, and the fold over a text's bytes in hexadecimal.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
_BYTES = "list_transform(regexp_extract_all({0}, '..'), lambda x: CAST('0x' || x AS BIGINT))".format
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {0}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)".format

#: Stored payloads: a header, then the text's bytes up to whole rows. Items before the payload are the lines with characters other than white space.
MEDIA = rf"""
WITH {_CRC_TABLE},
p AS (SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
q AS (SELECT doc_id, text, n_bytes, greatest(CAST(ceil(n_bytes / {ROW}) AS BIGINT), 1) AS h FROM p),
r AS (SELECT *, text || repeat(' ', h * {ROW} - n_bytes) AS payload, 'P6' || chr(10) || '{WIDTH} ' || h || chr(10) || '255' || chr(10) AS header FROM q),
s AS (SELECT *, {_BYTES("hex(encode(payload))")} AS b FROM r)
SELECT doc_id, n_bytes, h * {ROW} AS payload_bytes, sha256(payload) AS payload_sha256, {_CRC("b[-16:]")} AS tail_crc32, h * {ROW} + length(header) AS media_bytes, sha256(header || payload) AS media_sha256,
'{WIDTH}x' || h || ' rgb ' || CAST(list_sum(b[1:len(b):3]) // (h * {WIDTH}) AS BIGINT) || ',' || CAST(list_sum(b[2:len(b):3]) // (h * {WIDTH}) AS BIGINT) || ',' || CAST(list_sum(b[3:len(b):3]) // (h * {WIDTH}) AS BIGINT) || ' range ' || list_min(b) || '-' || list_max(b) || ' distinct ' || list_unique(b) AS feature,
CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\f\r]'))) AS INTEGER) AS position, n_bytes || ' bytes' AS caption
FROM s, crc
"""

_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: Near words by what is left of them without a letter.
VARIANTS = rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_ALPHABET.upper()}', '{_ALPHABET}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
g AS (SELECT w, count(*) AS m, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM r GROUP BY doc_id, w),
c AS (SELECT w, m, {_CRC(_BYTES("x"))} AS h FROM g, crc),
d AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, m FROM c),
w AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
v AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word AS x, b.word AS y, b.n FROM v a JOIN v b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.rest = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.rest = w.word),
b AS (SELECT x, y, n, count(*) OVER (PARTITION BY x) AS n_near, row_number() OVER (PARTITION BY x ORDER BY n DESC, y) AS k FROM p),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * w.n THEN y END AS form, CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n FROM w LEFT JOIN b ON b.x = w.word AND k = 1),
z AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT z.word, f.form, steps + 1 FROM z JOIN f ON z.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, steps) AS root FROM z GROUP BY word) USING (word)
"""
