import zlib

import numpy as np
import pyarrow as pa
import pytest

from stratalens.llm import langid


def _plain(scores, transition):
    """Forward-backward in log space over one sequence, word by word."""
    n, k = scores.shape
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    f, b = np.zeros((n, k)), np.zeros((n, k))
    f[0] = scores[0]
    for t in range(1, n):
        f[t] = lse(f[t - 1][:, None] + transition, 0) + scores[t]
    for t in range(n - 2, -1, -1):
        b[t] = lse(transition + scores[t + 1] + b[t + 1], 1)
    post = f + b
    return np.exp(post - lse(post, 1)[:, None])


@pytest.mark.parametrize("block", [1, 3, 128])
def test_posteriors_equal_plain_forward_backward(block):
    rng = np.random.default_rng(0)
    lengths = [0, 1, 5, 13, 0, 200, 128, 129]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    scores, transition = rng.normal(size=(bounds[-1], 4)) * 2, rng.normal(size=(4, 4))
    got = langid.posteriors(scores, bounds, transition, block)
    for i, n in enumerate(lengths):
        if n:
            part = slice(bounds[i], bounds[i + 1])
            assert np.allclose(got[part], _plain(scores[part], transition), atol=1e-9)


def test_held_out_accuracy_and_code_switching(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(langid.training_rows(docs))
    rows = {r.doc_id: r for r in langid.op2_language_id(spark, sf).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, r in rows.items() if r.held_out]
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == r.held_out for i, r in rows.items())
    assert len(rows) == len(truth) and np.mean([rows[i].lang_pred == truth[i] for i in held]) > 0.97
    mixed = langid.label(pa.array(["the and that was this with " * 4 + "der die und das nicht ein " * 4]), model)
    assert mixed["n_switches"][0] >= 1 and max(mixed["shares"][0]) < 0.9


def test_null_empty_and_letterless_texts(spark):
    model = langid.train(["the cat and the dog"] * 3 + ["der hund und die katze"] * 3, ["en"] * 3 + ["de"] * 3)
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 -- !", "x"), (4, "—", "x"), (None, "the dog", "x"), (5, "der hund " * 50_000, "x"), (5, "der hund", None)], "doc_id long, text string, lang_pred string")
    rows = langid.language_id(docs, model).collect()
    assert [r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 4)] == ["und"] * 4
    assert [r.lang_pred for r in rows if r.doc_id == 5] == ["de", "de"] and [r.lang_pred for r in rows if r.doc_id is None] == ["en"]
    assert langid.language_id(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.language_id(docs, langid.fit(docs.filter("lang_pred is null").withColumnRenamed("lang_pred", "lang"))).collect()} == {"und"}


def test_languages_of_long_texts_and_beside_a_huge_text_are_learned(spark):
    english, german = "the cat and the dog were in the house ", "der hund und die katze waren in dem haus "
    long = [(i, english * 100, "en") for i in range(20)]
    huge = [(100 + i, german, "de") for i in range(200)] + [(99, german * 20_000, "de")]
    spaceless = [(400 + i, "这是一个很长的句子没有空格" * 50, "zh") for i in range(20)]
    docs = spark.createDataFrame(long + huge + spaceless, "doc_id long, text string, lang string")
    model = langid.fit(docs, words=50)
    assert model["langs"] == ["de", "en", "zh"]
    rows = langid.language_id(docs, model).collect()
    truth = {i: lang for i, _, lang in long + huge + spaceless}
    assert all(r.lang_pred == truth[r.doc_id] for r in rows)


def test_training_sample_has_the_words_it_promises_and_no_more_than_a_text_beyond(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "train", lambda texts, langs: seen.update({lang: [t for t, x in zip(texts, langs, strict=True) if x == lang] for lang in langs}) or {"langs": sorted(seen)})
    monkeypatch.setattr(langid, "trained", lambda rows, learn: learn(iter(rows.toArrow().to_batches())))
    rows = [(i, "one two three four five " * (1 + i % 40), "a") for i in range(3_000)] + [(5_000 + i, "six seven", "b") for i in range(10)]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), words=2_000)
    sizes = [t.count(" ") + 1 for t in seen["a"]]
    assert sum(sizes) >= 2_000 > sum(sizes[:-1]) and len(seen["b"]) == 10


def test_long_texts_are_scored_in_parts_and_come_out_alike():
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(n)) + "é ñandú; x1y" for n in (0, 1, 50, 300)]
    model = langid.train(texts * 2, ["a", "b"] * len(texts))
    words = langid.Words(pa.array(texts, pa.large_string()))
    whole = words.scores(model["weights"], model["lexicon"])
    for n in (1, 7, 100):
        assert np.allclose(words.scores(model["weights"], model["lexicon"], n), whole, atol=1e-4)


def test_a_very_long_text():
    model = langid.train(["the cat sat on the mat " * 20, "der hund lief in den wald " * 20], ["en", "de"])
    found = langid.label(pa.array(["der hund und die katze " * 900_000], pa.large_string()), model)
    assert found["lang_pred"] == ["de"] and found["n_words"][0] == 4_500_000
