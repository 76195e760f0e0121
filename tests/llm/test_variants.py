"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import duckdb

from stratalens.llm import variants as V
from stratalens.llm.oracles import VARIANTS
from stratalens.llm.textbytes import Spans


def _near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def _plain(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in words if abs(len(x) - len(w)) <= 1 and _near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 10 * n:
                form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def _found(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string").repartition(3)


def test_words_of_few_letters(spark):
    """Many anagrams of one another, near and not, with letters beyond ASCII, capitals and other scripts between."""
    rng = random.Random(11)
    rows = [(k, " ".join("".join(rng.choices("aabÀé", k=rng.randrange(6, 9))).title() for _ in range(300)) + " Ünïcødé×÷Ÿ 北京") for k in range(12)]
    found = _found(V.spelling_variants(_docs(spark, rows)))
    assert found == _plain(rows) and max(r[4] for r in found) > 3


def test_forms_are_followed_to_the_root(spark):
    words = [("abcdefgh", 30_000), ("abcdefgx", 2_500), ("abcdefyx", 210), ("abcdezyx", 17), ("abcdwzyx", 2), ("abcdefg", 30_000), ("zzzzzzzz", 2)]
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(words) for _ in (0,)]
    found = _found(V.spelling_variants(_docs(spark, rows)))
    assert found == _plain(rows)
    assert len({r[2] for r in found}) < len(found)


def test_odd_rows(spark):
    rows = [(None, "repeated repeated"), (1, None), (2, ""), (3, "12345 --"), (4, "Repeated rеpeated"), (4, "Repeated rеpeated"), (5, "longword" * 20_000), (6, "longword" * 20_000), (7, "longword" * 20_000 + "s"), (8, "longword" * 20_000 + "s")]
    assert _found(V.spelling_variants(_docs(spark, rows))) == _plain(rows[:6]) | {r for r in _found(V.spelling_variants(_docs(spark, rows))) if len(r[0]) > 99}
    long = [r for r in _found(V.spelling_variants(_docs(spark, rows))) if len(r[0]) > 99]
    assert sorted(r[4] for r in long) in ([0, 0], [1, 1], [0], [])
    assert V.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_against_sql_and_plain_comparison(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = con.execute(VARIANTS)
    names = [c[0] for c in found.description]
    rows = V.op13_spelling_variants(spark, sf)
    assert sorted(rows.columns) == sorted(names)
    got = _found(rows)
    assert got == {tuple(dict(zip(names, r, strict=True))[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in found.fetchall()}
    assert got == _plain([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_long_spans_that_differ_have_different_hashes():
    """Sequences of 0 and 1 by the parity of the bits of their places, and their complements: equal under any polynomial modulo 2^64."""
    import numpy as np

    for size in (300, 1024, 2048, 4096):
        bits = np.array([bin(i).count("1") & 1 for i in range(size)], np.uint8)
        raw = np.concatenate([97 + bits, 98 - bits]).astype(np.uint8)
        a, b = Spans(raw).hash(np.array([0, size]), np.array([size, 2 * size]))
        assert a != b
