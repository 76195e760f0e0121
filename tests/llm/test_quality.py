import math
import re
from collections import Counter

from stratalens.llm import quality


def _plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if times[x] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def _got(rows):
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows]


def test_base_statistics(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sorted(quality.op6_quality_rules(spark, sf).collect(), key=lambda r: r.doc_id)
    assert _got(rows) == [_plain(docs[r.doc_id]) for r in rows] and len(rows) == len(docs)


def test_odd_texts(spark):
    texts = [None, "", " \n\t ", "a " * 30, "é#é\n\nx\nx\n x", "a\x0bb\x0cc\rd", " ".join(f"w{i % 9}" for i in range(40)), "one two three four five six seven eight nine " * 2000, "x\n" * 3]
    docs = spark.createDataFrame([(i, t, None, 7) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([(None, 1), (0, None)], "doc_id long, quality int")
    rows = sorted(quality.quality_rules(docs, labels).collect(), key=lambda r: r.doc_id)
    assert _got(rows) == [_plain(t) for t in texts]
    assert quality.quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def _tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_cutoffs_keep_the_bound(spark):
    rows, labels = [], []
    for s, (good, bad) in {"a": (400, 6), "b": (400, 60), "c": (20, 0)}.items():
        for i in range(good):
            rows.append((f"{s}{i}", s, 3 if i < bad else 0, False))
            labels.append((f"{s}{i}", 1))
    scored = spark.createDataFrame(rows, "doc_id string, stratum string, severity int, base_failed boolean")
    found = {r.stratum: r.cutoff for r in quality.cutoffs(scored, spark.createDataFrame(labels, "doc_id string, quality int"), 0.05, 0.05).collect()}
    for s, (good, bad) in {"a": (400, 6), "b": (400, 60), "c": (20, 0)}.items():
        top = quality.LEVELS + 1
        for level in range(quality.LEVELS, 0, -1):
            k = bad if level <= 3 else 0
            if k > 0.05 * good or _tail(good, k, 0.05) > 0.05 / 3:
                break
            top = level
        assert found[s] == top
    assert found == {"a": 1, "b": 4, "c": 10}
