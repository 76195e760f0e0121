"""The alignment of two tokenizers against plain encoding of whole texts by their own libraries."""

import hashlib
import random
from collections import Counter

import pytest

from stratalens.llm import alignment as A

TEXTS = [
    None, "", " ", "  two  spaces ", "plain words here", "line one\nline two\n\n  indented", "tab\tand   nbsp", "naïve café 北京 日本語 text", "emoji 😀👍🏽 joined", "a▁b ▁ mark", "<s> </s> <unk> <|endoftext|>",
    "don't we'll I'm", "1234567 89 3.14", "\r\n windows\r\n", "x" * 3000, "word " * 500, "\x1c sep \x85 nel", "é" * 200 + " é", "trailing ", " leading", "zero\x00byte", "<0x41> bytes",
]


def _plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text, and the count of every pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A.BYTES_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=A.PIECES_FILE)
    known = A.Encoders()
    found, count = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a, bytes_b = [known.a_bytes[i] for i in ids_a], [known.b_bytes[i] for i in ids_b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            ids_a = ids_b = bytes_a = bytes_b = []
        ends, at = {}, 0
        for i, x in enumerate(bytes_a):
            at += len(x)
            ends[at] = i
        links, groups, at, from_a, from_b = [], [], 0, 0, 0
        for j, x in enumerate(bytes_b):
            at += len(x)
            if at in ends:
                links.append((ids_a[ends[at]], ids_b[j]))
                groups.append(",".join(map(str, ids_a[from_a : ends[at] + 1])) + "|" + ",".join(map(str, ids_b[from_b : j + 1])))
                from_a, from_b = ends[at] + 1, j + 1
        found.append((len(ids_a), len(ids_b), links, groups))
        count.update(links)
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(x, y, len(g), len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), digest(g)) for x, y, ls, g in found], count, best


def _row(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


@pytest.mark.parametrize("group", [A.GROUP, 40], ids=["whole groups", "split groups"])
def test_against_plain_encoding(spark, group):
    rng = random.Random(5)
    words = "the of tion an un-der café straße don't 12 , . \n (x) ▁".split(" ")
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(40)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, row string").repartition(3)
    found, pairs = A.align(docs, group=group)
    want, count, best = _plain(texts)
    assert {r.doc_id: _row(r) for r in found.collect()} == dict(enumerate(want))
    assert {(r.a, r.b): (r.n, r.best) for r in pairs.collect()} == {p: (n, n == best[p[1]]) for p, n in count.items()}


def test_query_on_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want, _, _ = _plain(list(texts.values()))
    assert {r.doc_id: _row(r) for r in A.op11_token_alignment(spark, sf).collect()} == dict(zip(texts, want, strict=True))


def test_nulls_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "same text"), (1, "same text"), (1, "same text"), (2, None)], "doc_id long, text string")
    rows = A.align(docs)[0].collect()
    want = _plain(["same text"] * 3 + [None])[0]
    assert sorted(map(_row, rows)) == sorted(want) and sorted(str(r.doc_id) for r in rows) == ["1", "1", "2", "None"]
    assert A.align(spark.createDataFrame([], "doc_id long, text string"))[0].collect() == []


def test_long_text(spark):
    text = "some words, repeated again and again; " * 60_000  # 2.3 MB
    row = A.align(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0].first()
    assert _row(row) == _plain([text])[0][0]


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(A, "KEPT", 5)
    encoders = A.Encoders()
    texts = [f"word{k} other{k % 3} same" for k in range(30)]
    assert [encoders.encode([t])[0] for t in texts] == A.Encoders().encode(texts)
