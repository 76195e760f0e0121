import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import suffixes


def _plain(rows):
    """Rows (id, text) in order: removed bytes by a table of all windows."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone, fresh = np.zeros(len(raw) + 1, np.int64), []
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k] += 1
                gone[k + 100] -= 1
            else:
                seen.add(w)
        mask = np.cumsum(gone)[: len(raw)] > 0
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out[i] = (len(raw), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~mask].tobytes()).hexdigest())
    return out


def _got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(values):
    s = np.array(values, np.int64)
    assert suffixes.suffix_array(s, 10**6).tolist() == sorted(range(s.size), key=lambda i: values[i:])


@pytest.mark.parametrize("n", [3, 100, 1000, 5001])
def test_truncated_suffix_array_keeps_equal_prefixes_together(n):
    s = np.random.default_rng(n).integers(1, 3, n)
    order = suffixes.suffix_array(s, 8)
    keys = [tuple(s[i : i + 8]) for i in order]
    assert sorted(order) == list(range(n)) and keys == sorted(keys)


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert _got(suffixes.op1_suffix_dedup(spark, sf)) == _plain([(r.doc_id, r.text) for r in docs.collect()])


def test_overlaps_runs_and_hot_passages(spark):
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdé "))
    text = lambda n: "".join(rng.choice(letters, n))
    hot, rows = text(230), []
    for i in range(150):
        rows.append((i * 7, text(int(rng.integers(0, 300))) + (hot[int(rng.integers(0, 60)) :] if i % 3 else "") + text(int(rng.integers(0, 200)))))
    rows += [(2000, "a" * 777), (2001, "ab" * 300), (2002, "a" * 99), (2003, "a" * 100), (2004, rows[5][1] + rows[6][1] + rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _got(suffixes.remove_repeats(df)) == _plain(rows)


def test_edge_cases(spark):
    long = "".join(chr(97 + int(i)) for i in np.random.default_rng(1).integers(0, 26, 153))
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, long, 0), (None, long, 0), (4, long, 0), (4, long, 1), (5, "short", 0)], "doc_id long, text string, n_bytes int")
    rows = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(docs).collect()]
    n = len(long)
    assert sorted(rows, key=lambda r: (r[0] or 0, r[1])) == [(None, n, n), (1, 0, 0), (2, 0, 0), (3, n, 0), (4, n, n), (4, n, n), (5, 5, 0)]
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0
