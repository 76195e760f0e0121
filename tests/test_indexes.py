"""The vector index against comparing everything; counted edges against building them anew."""

import random
from collections import Counter

import numpy as np
import pytest

from stratalens.operators import counted as K
from stratalens.operators import vectors as V
from stratalens.sources import buckets as B


def _nearest(rows, queries, k):
    out = set()
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows}
    for q, v in queries:
        length = np.linalg.norm(v)
        score = {i: round(float(u @ np.array(v) / length), 6) if length else 0.0 for i, u in unit.items()}
        out |= {(q, i) for i in sorted(score, key=lambda i: (-score[i], i))[:k]}
    return out


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_vector_index_is_exact(spark, monkeypatch, kind):
    """Copies (ties), vectors of no length, split cells, a query of no length."""
    monkeypatch.setattr(V, "GROUP", 16)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(8, 12))
    rows = [(i, (rng.normal(size=12) if kind == "noise" else middle[i % 8] + 0.05 * rng.normal(size=12)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(30)] + [(500, [0.0] * 12), (501, [0.0] * 12)]
    frame = spark.createDataFrame([*rows, (None, rows[0][1]), (600, None), (0, rows[0][1])], "vec_id long, embedding array<float>").repartition(3)
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    queries = [(i, rows[i * 20][1]) for i in range(20)] + [(99, [0.0] * 12)]
    found, read = V.search(V.build(frame, cells=12), spark.createDataFrame(queries, "query_id long, query array<float>"), 7)
    assert {(r.query_id, r.id) for r in found.collect()} == _nearest(rows, queries, 7)
    report = {r.query_id: r for r in read.collect()}
    assert set(report) == {q for q, _ in queries} and report[99].compared == 432
    if kind == "clusters":
        assert sum(r.cells_read for q, r in report.items() if q != 99) < 0.6 * 20 * report[0].cells


def test_small_and_empty_indexes(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(5, [1.0, 1.0])], "query_id long, query array<double>")
    assert [(r.id, r.score) for r in V.search(V.build(one), asked, 3)[0].collect()] == [(1, 0.707107)]
    assert V.search(V.build(one.limit(0)), asked)[0].collect() == []
    none = spark.createDataFrame([(1, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.id, r.score) for r in V.search(V.build(none), asked, 3)[0].collect()] == [(1, 0.0)]


def test_counted_edges_equal_a_rebuild(spark, tmp_path):
    """Four batches; retractions come before what they take back, some more than there is; one batch is run twice, one after a loss."""
    rng, path = random.Random(5), f"file://{tmp_path}/graph"
    refs, defs, before = Counter(), Counter(), set()
    for version in range(4):
        new = {"r": [], "d": []}
        for _ in range(40):
            change = rng.choice([1, 1, 2, -1])
            new["r"].append((rng.randrange(6), rng.choice("abcd"), change))
            new["d"].append((rng.choice("abcd"), f"f{rng.randrange(5)}", rng.choice([1, -1])))
        new["r"].append((None, "a", 1))
        frames = spark.createDataFrame(new["r"], "qa int, symbol string, change int"), spark.createDataFrame(new["d"], "symbol string, file string, change int")
        K.apply(path, *frames, version)
        if version == 1:
            K.apply(path, *frames, version)
        if version == 2:  # lost behind the base tables
            B.delete(spark, f"{path}/edges/versions/2.json")
            K.apply(path, *frames, version)
        for q, s, n in new["r"][:-1]:
            refs[q, s] += n
        for s, f, n in new["d"]:
            defs[s, f] += n
        edges = Counter()
        for (q, s), n in refs.items():
            for (t, f), m in defs.items():
                edges[q, f] += n * m * (s == t)
        kinds = "qa int, file string, n bigint"
        assert {(r.qa, r.file): r.n for r in K.counts(spark, path, "edges", kinds).collect()} == {k: n for k, n in edges.items() if n > 0}
        now = {k for k, n in edges.items() if n > 0}
        moved = {(r.qa, r.file, r.change) for r in K.came_and_went(spark, path, kinds, version).collect()}
        assert moved == {(*k, "appeared") for k in now - before} | {(*k, "vanished") for k in before - now}
        before = now
    whole = K.counts(spark, path, "edges", kinds).count()
    assert B.purge(spark, f"{path}/edges") >= 0 and B.versions(spark, f"{path}/edges") == [3]
    assert K.counts(spark, path, "edges", kinds).count() == whole
