"""Column builders for texts, names and scores. Each takes and gives Columns; nulls stay null unless said."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens.functions import patterns as P

TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Distinct words between white space, lower-cased."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.trim(text)), r"[ \t\n\r\f\x0B]+"), ""))


def normalize_question(question: Column) -> Column:
    q = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), P.QUESTION_REWRITES, F.lower(F.trim(question)))
    return F.regexp_replace(F.trim(F.regexp_replace(q, r"[ \t\n\r\f\x0B]+", " ")), r"[，。！、；：【】（）]", "")


def first_group(text: Column, groups: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The first group with a keyword in the lower-cased text."""
    low, out = F.lower(text), None
    for name, keywords in groups:
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keywords])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def first_group_sql(column: str, groups: list[tuple[str, list[str]]], otherwise: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'''contains(lower({column}), '{k}')''' for k in keys)} THEN '{name}'" for name, keys in groups)
    return f"CASE {cases} ELSE '{otherwise}' END"


def cache_key(question: Column) -> Column:
    return F.substring(F.md5(normalize_question(question)), 1, 16)


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.substring(text, 1, 30), r"[^\p{L}\p{N}_]", "_")
    s = F.regexp_replace(F.regexp_replace(s, r"_+", "_"), r"^_|_$", "")
    return F.when(s == "", "question").otherwise(s)


def diagram_id(text: Column) -> Column:
    s = F.regexp_replace(text, r"[^a-zA-Z0-9_]", "_")
    return F.when(s.rlike(r"^[0-9]"), F.concat(F.lit("n"), s)).otherwise(s)


def human_size(size: Column) -> Column:
    out = None
    for power, unit in enumerate(("B", "KB", "MB", "GB")):
        value = F.format_string(f"%.1f {unit}", size / float(1024**power))
        out = F.when(size < 1024 ** (power + 1), value) if out is None else out.when(size < 1024 ** (power + 1), value)
    return out.otherwise(F.format_string("%.1f TB", size / float(1024**4)))


def mask(text: Column) -> Column:
    """Secrets out of a text: the key stays where a pattern has one."""
    for _, _, pattern, groups in P.SECRETS:
        text = F.regexp_replace(text, pattern, '$1="***MASKED***"' if groups >= 2 else "***MASKED***")
    return text


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def characters(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(text, ""), ""))


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns; 0 for a zero norm; the longer is cut to the shorter."""
    dot = f"aggregate(zip_with({a}, {b}, (x, y) -> coalesce(cast(x as double) * cast(y as double), 0D)), 0D, (s, x) -> s + x)"
    norm = lambda v: f"sqrt(aggregate({v}, 0D, (s, x) -> s + cast(x as double) * cast(x as double)))"
    return F.expr(f"coalesce({dot} / nullif({norm(a)} * {norm(b)}, 0D), 0D)")


def pseudo_embedding(text: Column, dimensions: int = 1536) -> Column:
    """Eight shares of a SHA-256 digest, repeated to the asked dimension."""
    digest = F.sha2(text, 256)
    eight = F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("double") / float(2**32) for i in range(8)])
    return F.slice(F.flatten(F.array_repeat(eight, -(-dimensions // 8))), 1, dimensions)


def file_refs(text: Column) -> Column:
    """Up to ten distinct paths with a known extension."""
    pattern = r"[a-zA-Z0-9_/.-]+\.(?:py|js|ts|tsx|jsx|java|go|rs|c|cpp|h|hpp|cs|swift|kt|md|yaml|yml|json|toml)"
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), 1, 10)


def complexity_score(text: Column) -> Column:
    """100 less 2 for each indicator, 20 at most for each kind; 0 at least."""
    penalty = sum((F.least(F.regexp_count(text, F.lit(p)) * 2, F.lit(20)) for p in P.COMPLEXITY), F.lit(0))
    return F.greatest(F.lit(0), F.lit(100) - penalty)


def risk_level(score: Column) -> Column:
    out = None
    for limit, name in P.RISK_BANDS:
        out = F.when(score < limit, name) if out is None else out.when(score < limit, name)
    return out.otherwise("critical")


def todo_priority(text: Column) -> Column:
    low = F.lower(text)
    any_of = lambda keys: reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keys])
    return F.when(any_of(P.TODO_HIGH), "high").when(any_of(P.TODO_LOW), "low").otherwise("medium")
