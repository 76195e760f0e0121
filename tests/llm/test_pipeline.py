import re
from pathlib import Path

import corpus_pipeline as P
from stratalens.llm.storage import collect_garbage
from tests.llm.test_lines import _plain as plain_lines
from tests.llm.test_neardup import _plain as plain_near


def _collect(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 6000")
    columns = docs.columns
    kept = P.language_stage(spark, docs, sf)
    assert kept.columns == columns and kept.count() >= 0.97 * docs.count()
    lined = P.line_stage(spark, kept, sf)
    assert lined.columns == columns
    texts = {i: t for i, t in plain_lines([(r.doc_id, r.text) for r in kept.collect()], 50).items() if re.search(r"\S", t)}
    assert {r.doc_id: r.text for r in lined.collect()} == texts and all(r.n_chars == len(r.text) for r in lined.collect())
    near = P.near_stage(spark, docs, sf)  # on the raw documents, where there are near copies
    assert near.columns == columns and {r.doc_id for r in near.collect()} == {i for i, v in plain_near([(r.doc_id, r.text) for r in docs.collect()], 5).items() if v[2]}
    clean = P.decontamination_stage(spark, docs, sf)
    word = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [word(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    exact = {r.doc_id for r in docs.collect() if any(x in word(r.text) for x in items)}
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and exact and not exact & left and len(left) >= docs.count() - 2 * len(exact)


def test_run(spark, sf):
    rows = P.run(spark, sf).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.target, [0, 0])[0] += r.taken
    assert abs(sum(r.taken for r in rows) - sum(r.size for r in rows)) <= 20


def test_odd_tables_go_through(spark, sf):
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (None, "the and that this with for", "en", None, 3, "x"), (2, "the and that this with from was", "en", "a", 3, "x"), (2, "the and that this with from was", "en", "a", 3, "x")], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    docs = docs.withColumns({c: docs.component_id for c in ("language", "line_dedup", "contamination", "kept", "seq", "doc", "stays", "band", "node")})
    for rows in (docs, docs.limit(0)):
        now = rows
        for _, stage in P.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == docs.columns
        found = P.STAGES[-1][1](spark, now, sf).collect()
        assert len(found) == (2 if rows is docs else 0)


def test_rows_that_share_an_id_stay_unless_equal_or_near(spark, sf):
    text = lambda k: " ".join(f"w{k * j % 101}x{j * j % 89}" for j in range(1, 120))
    rows = [(1, text(3)), (1, text(5)), (1, text(5)), (2, text(5) + " end"), (3, text(7)), (4, text(11)), (4, text(7) + " end"), (4, text(13)), (5, None), (5, text(17))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stay = [(1, text(3)), (1, text(5)), (3, text(7)), (4, text(11)), (4, text(13)), (5, None), (5, text(17))]
    assert _collect(P.near_stage(spark, docs, sf)) == sorted(stay, key=str)


def test_memory_that_the_driver_freed_outside_its_heap_goes_back(spark):
    jvm = spark.sparkContext._jvm
    status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup"
    taken = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path(status).read_text())[1]) / 1024
    held = jvm.java.util.ArrayDeque()
    for _ in range(2_000):
        held.addLast(jvm.java.nio.ByteBuffer.allocateDirect(100_000))
    last = held.peekLast()  # behind what is freed, so that the C library keeps the rest
    collect_garbage(spark)
    before = taken()
    held.clear()
    collect_garbage(spark)
    assert before - taken() > 100 and last.capacity() == 100_000
