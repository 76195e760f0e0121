import re

import numpy as np
import pytest

from stratalens.llm import lines


def _plain(rows, least):
    """Every run of every length, by a table: a line goes if a run of `least` words over it starts earlier."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    docs = []
    for i, text in sorted(rows):
        all_ = (text or "").split("\n")
        docs.append((i, all_, [(n, tuple(word.findall(x)) and x.strip("\x20\x09\x0a\x0b\x0c\x0d"), len(word.findall(x))) for n, x in enumerate(all_) if word.search(x)]))
    seen, out = {}, {}
    for d, (_, _, seq) in enumerate(docs):
        for s in range(len(seq)):
            for e in range(s + 1, len(seq) + 1):
                if sum(x[2] for x in seq[s:e]) >= least:
                    seen.setdefault(tuple(x[1] for x in seq[s:e]), (d, s))
    for d, (i, all_, seq) in enumerate(docs):
        dead = set()
        for s in range(len(seq)):
            for e in range(s + 1, len(seq) + 1):
                if sum(x[2] for x in seq[s:e]) >= least and seen[tuple(x[1] for x in seq[s:e])] < (d, s):
                    dead |= {x[0] for x in seq[s:e]}
        out[i] = "\n".join(x for n, x in enumerate(all_) if n not in dead)
    return out


@pytest.mark.parametrize("least", [1, 7, 12])
def test_random_sequences_against_brute_force(spark, least):
    rng = np.random.default_rng(least)
    kinds = ["a", "b c", "d e f g", "", "  h  i", "j k l m n o p"]
    rows = [(int(i) * 3, "\n".join(rng.choice(kinds, int(rng.integers(0, 14))))) for i in range(40)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()}
    assert got == _plain(rows, least)


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 6000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = lines.dedup_lines(docs)
    assert found.columns == [*docs.columns, "line_dedup"]
    assert {r.doc_id: r.text for r in found.collect()} == _plain(rows, lines.MIN_WORDS)


def test_edge_cases(spark):
    line = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, line, 0), (None, line, 0), (4, line + "\nown", 0), (4, line + "\nown", 1), (5, line + "\n\n" + line, None)], "doc_id long, text string, seq int")
    rows = sorted((r.doc_id or 99, r.text, r.seq or 0, r.line_dedup.n_removed) for r in lines.dedup_lines(docs).collect() if r.text is not None)
    assert rows == [(2, "", 0, 0), (3, line, 0, 0), (4, "own", 0, 1), (4, "own", 1, 1), (5, "", 0, 2), (99, "", 0, 1)]
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_long_lines_that_differ_stay(spark):
    """Lines of 0 and 1 by the parity of the bits of their places, and their complements: equal under any polynomial modulo 2^64."""
    bits = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    other = bits.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"{bits} {tail}"), (2, f"{other} {tail}")], "doc_id long, text string")
    assert [r.text for r in lines.dedup_lines(docs).orderBy("doc_id").collect()] == [f"{bits} {tail}", f"{other} {tail}"]
