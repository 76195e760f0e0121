"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

`base_statistics` measures each text. A document's severity is the highest level that any of its ratios reaches on fixed
grids. For each stratum (language) the labelled good documents are the holdout: levels are tested from the most lenient
on, each by the exact binomial tail P(Bin(n, alpha) <= false rejections), and testing stops at the first level that cannot
be certified (fixed-sequence testing); Bonferroni's correction holds over the strata. With probability 1 - delta, then, no
stratum loses more than alpha of its good documents to the method. A stratum with too few labels rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.storage import table, written

WORD_SPLIT = r"[\x20\x09-\x0D]+"
WINDOW = 8
ALPHA, DELTA = 0.05, 0.05
#: Cutoffs of each ratio from lenient to strict.
GRIDS = {
    "symbols_per_word": [3.0, 2.0, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05],
    "repeated_share": [0.30, 0.28, 0.26, 0.24, 0.22, 0.20, 0.18, 0.16, 0.14],
    "dup_lines_per_word": [0.5, 0.4, 0.3, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06],
    "chars_per_word": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0],
}
LEVELS = 9


def _windows(n: Column) -> Column:
    """A hash for each window of WINDOW words over the word hashes in column `h`."""
    return F.when(n >= WINDOW, F.expr(f"transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({', '.join(f'h[i + {k}]' for k in range(WINDOW))}))")).otherwise(F.expr("cast(array() as array<bigint>)"))


def base_statistics(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null texts have no words. Windows are told apart by 64-bit hashes of their words' hashes.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = docs.select("doc_id", "lang", text.alias("t")).withColumn("w", F.array_remove(F.split("t", WORD_SPLIT, -1), ""))
    counted = words.select(
        "doc_id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", WORD_SPLIT, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.when(F.instr("t", "\n") > 0, F.aggregate(F.array(lines), F.lit(0).cast("long"), lambda _, x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))).otherwise(F.lit(0).cast("long")).alias("n_dup_lines"),
        F.expr("transform(w, x -> xxhash64(x))").alias("h"),
    )
    windowed = counted.withColumn("g", _windows(F.size("h"))).drop("h")
    # Only where two windows agree: their positions in order, each covering WINDOW words or up to the next.
    twice = F.expr(
        "aggregate(array(array_sort(transform(g, (x, i) -> struct(x as x, i as i)))), cast(array() as array<int>), (a, s) -> "
        "array_sort(transform(filter(s, (e, k) -> (k > 0 and s[greatest(k - 1, 0)].x = e.x) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].x = e.x)), e -> e.i)))"
    )
    covered = F.expr(f"aggregate(array(p), 0L, (_, q) -> cast(aggregate(transform(q, (v, k) -> if(k < size(q) - 1, least({WINDOW}, q[least(k + 1, size(q) - 1)] - v), {WINDOW})), 0, (a, v) -> a + v) as bigint))")
    repeated = F.when(F.size("g") > F.size(F.array_distinct("g")), twice)
    out = windowed.withColumn("p", repeated).withColumn("n_repeat_words", F.when(F.col("p").isNull(), F.lit(0).cast("long")).otherwise(covered)).drop("g", "p")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def severity() -> Column:
    """0 (no ratio reaches its strictest cutoff) to LEVELS (one reaches its most lenient): the highest over all ratios."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    ratios = {"symbols_per_word": F.col("n_symbols") / n, "repeated_share": F.col("n_repeat_words") / n, "dup_lines_per_word": F.col("n_dup_lines") / n, "chars_per_word": F.col("word_chars") / n}
    return F.greatest(*[sum((ratios[k] >= c).cast("int") for c in grid) for k, grid in GRIDS.items()])


def cutoffs(scored: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """For each stratum the lowest severity that may be rejected: stratum, cutoff (above LEVELS: nothing is rejected), good.

    `scored`: doc_id, stratum, severity, base_failed. A document counts as good if it has labels and all say quality 1.
    """
    good = labels.groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality")).filter("quality = 1 and doc_id is not null").select("doc_id")
    counts = scored.filter("not base_failed").join(good, "doc_id").groupBy("stratum", "severity").agg(F.count(F.lit(1)).alias("n"))
    by = counts.groupBy("stratum").agg(F.sum("n").alias("good"), F.collect_list(F.struct("severity", "n")).alias("each"))
    strata = scored.agg(F.count_distinct(F.coalesce("stratum", F.lit(""))).alias("strata"))
    tested = by.join(F.broadcast(strata)).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(LEVELS))))
    tested = tested.withColumn("false_rejections", F.expr("aggregate(each, 0L, (a, x) -> a + if(x.severity >= level, x.n, 0L))"))
    # log pmf(0) = good ln(1 - alpha); each further term by the ratio of neighbours.
    odds = f"ln({alpha}D / (1D - {alpha}D))"
    tail = F.expr(
        f"aggregate(sequence(0L, false_rejections), struct(good * ln(1D - {alpha}D) as term, 0D as total), (a, k) -> struct(a.term + if(k < good, ln((good - k) / (k + 1D)), 0D) + {odds} as term, a.total + exp(a.term) as total), a -> a.total)"
    )
    certified = (F.col("false_rejections") <= F.lit(alpha) * F.col("good")) & (F.when(F.col("false_rejections") <= F.lit(alpha) * F.col("good"), tail).otherwise(F.lit(1.0)) <= F.lit(delta) / F.col("strata"))
    # Testing goes from the top level down and stops at the first failure.
    return tested.withColumn("certified", certified).groupBy("stratum").agg((F.coalesce(F.max(F.when(~F.col("certified"), F.col("level"))), F.lit(0)) + 1).alias("cutoff"), F.first("good").alias("good"))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Verdict for each row of `docs` (doc_id, text, lang): the base statistics, stratum, severity, cutoff and kept.

    Null or empty texts fail the base rules; a null language is a stratum of its own; repeated rows are judged one by one;
    without labels only the base rules reject. Other columns are ignored.
    """
    scored = written(base_statistics(docs).withColumn("stratum", F.coalesce("lang", F.lit(""))).withColumn("severity", severity()), "quality")
    limits = cutoffs(scored, labels, alpha, delta).select("stratum", "cutoff")
    judged = scored.join(limits, "stratum", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(LEVELS + 1)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("severity") < F.col("cutoff")))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "severity", "cutoff")
