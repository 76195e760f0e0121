import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import tokens

PIECES = {"a": -1.0, "ab": -1.5, "b": -2.0, "abc": -2.25, "bc": -0.5, tokens.MARK: -1.0, tokens.MARK + "a": -1.25, "cab": -3.0}


def _plain(word, pieces, byte_score):
    """Best (score, fewest tokens) over all segmentations, without sharing."""
    best = {0: (0.0, 0)}
    for i in range(1, len(word) + 1):
        n = len(word[i - 1].encode())
        options = [(best[i - 1][0] + n * byte_score, -(best[i - 1][1] + n))]
        options += [(best[j][0] + pieces[word[j:i]], -(best[j][1] + 1)) for j in range(i) if word[j:i] in pieces]
        s, c = max(options)
        best[i] = (s, -c)
    return best[len(word)][1]


@settings(max_examples=500, deadline=None)
@given(st.sets(st.text(alphabet="abcé", min_size=1, max_size=9), max_size=20))
def test_shared_prefixes_give_the_plain_counts(words):
    words = sorted(tokens.MARK + w for w in words)
    assert tokens.count_tokens(words, PIECES, -4.0) == [_plain(w, PIECES, -4.0) for w in words]


def test_walk_goes_on_between_calls():
    words = sorted(tokens.MARK + w for w in ("a", "ab", "abc", "abcab", "b", "bc", "cab"))
    walk = tokens.Walk(PIECES, -4.0)
    assert [n for w in words for n in walk.tokens([w])] == tokens.count_tokens(words, PIECES, -4.0)


@pytest.mark.parametrize("hot", [0, 5, tokens.HOT])
def test_documents_against_brute_force(spark, sf, hot):
    pieces, byte_score = tokens.load()
    memo = {}
    truth = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        for w in words:
            if w not in memo:
                memo[w] = _plain(tokens.MARK + w, pieces, byte_score)
        truth[r.doc_id] = (len(words), len(set(words)), sum(memo[w] for w in words))
    assert {r.doc_id: (r.n_pretokens, r.n_distinct, r.n_tokens) for r in tokens.token_counts(spark.read.parquet(f"{sf}/documents.parquet"), hot=hot).collect()} == truth


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5), (None, "the the", 5), (3, "x" * 200_000, None)], "doc_id long, text string, n_tokens int")
    began = time.time()
    rows = sorted((tokens.token_counts(docs).collect()), key=lambda r: r.n_pretokens)
    assert [r.n_pretokens for r in rows] == [0, 0, 0, 1, 2] and rows[-1].n_distinct == 1 and time.time() - began < 60
    assert tokens.token_counts(docs.limit(0)).count() == 0


def test_words_part_at_the_six_bytes_and_fast():
    import pyarrow as pa

    odd = [None, "", " \t", "a\x0bb\x0c\r\nc", "a\xa0b\x85c\x1cd e　f", " é  ü "]
    assert [[w.decode() for w in ws] for ws in tokens.words_of(pa.array(odd))] == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in odd]
    texts, spaces = pa.array(["wörter sind über Zeilen verteilt\n" * 3_000] * 10), str.maketrans(dict.fromkeys("\x09\x0a\x0b\x0c\x0d", " "))
    began = time.process_time()
    plain = [list(filter(None, t.translate(spaces).split(" "))) for t in texts.to_pylist()]
    between = time.process_time()
    assert [len(ws) for ws in tokens.words_of(texts)] == [len(ws) for ws in plain] and 2 * (time.process_time() - between) < between - began
