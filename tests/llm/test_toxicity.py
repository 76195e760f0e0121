import zlib

import numpy as np
import pyarrow as pa

from stratalens.llm import toxicity


def test_label_model_overrules_wrong_annotator_and_discounts_copies():
    rng = np.random.default_rng(1)
    truth = (rng.random(4000) < 0.15).astype(int)
    votes = (rng.random((4000, 6)) < np.where(truth[:, None] == 1, 0.6, 0.02)).astype(float)
    votes = np.concatenate([votes, votes[:, :1]] * 1 + [votes[:, :1]] * 3, axis=1)  # voter 0 five times
    given = np.where(rng.random(4000) < 0.05, 1 - truth, truth)
    post, model = toxicity.label_model(votes, given)
    assert np.mean((post > 0.5) == truth) > np.mean(given == truth)
    # The copies hang on one another, and what they say once counts once.
    copies = [0, 6, 7, 8, 9]
    assert sum(model["parent"][k] in copies for k in copies) == 4
    once, _ = toxicity.label_model(votes[:, :6], given)
    assert np.mean((post > 0.5) != (once > 0.5)) < 0.03


def test_held_out_scores(spark, sf):
    rows = {r.doc_id: r for r in toxicity.op3_toxicity(spark, sf).collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [i for i in truth if rows[i].held_out]
    assert not [i for i in held if truth[i] == 0 and rows[i].predicted]


def test_most_toxic_held_out_rows_are_found(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in toxicity.op3_toxicity(spark, sf).collect()}
    held = [(r.toxic, rows[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    caught = sum(p for t, p in held if t == 1) / sum(t == 1 for t, _ in held)
    assert caught >= 0.85 and sum(p for t, p in held if t == 0) <= 0.01 * len(held)


def test_accuracy_on_unseen_texts():
    rng = np.random.default_rng(2)
    clean, bad = ["tree", "house", "water", "stone", "light", "green"], ["vilewort", "vilemug", "grotscum"]
    text = lambda toxic: " ".join([*rng.choice(clean, 40), *(rng.choice(bad, 2, replace=False) if toxic else [])])
    y = (np.arange(600) % 5 == 0).astype(int)
    model = toxicity.train([text(t) for t in y], y)
    score, _ = toxicity.score(pa.array([text(t) for t in y] + ["tree vilewortish vilemug"]), model)
    assert ((score[:-1] >= 0.7) == y).mean() > 0.99 and score[-1] >= 0.5


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "tree", None), (3, "tree", 1.0), (3, "tree", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.toxicity(docs, model).collect()
    assert len(rows) == 5 and len({r.score for r in rows}) == 1 and all(r.predicted == 0 for r in rows)
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


def test_long_texts_are_taken_in_stretches():
    texts = pa.array(["one vilewort two", "vile wörter " * 300, "", None, "x" * 500 + " end"], pa.large_string())
    flat = lambda n: sorted((int(r), int(h)) for row, hashes in toxicity._raw_features(texts, n) for r, h in zip(row, hashes, strict=True))
    assert flat(64) == flat(1 << 20) == flat(1_000)
