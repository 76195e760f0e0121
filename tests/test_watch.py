"""The watched tree: changes between listings, moves, batches that are run again."""

import os

from stratalens.sources import watch as W
from stratalens.streaming.changes import current


def _write(root, path, text):
    where = root / path
    where.parent.mkdir(parents=True, exist_ok=True)
    where.write_text(text)
    os.utime(where, ns=(1_700_000_000_000_000_000 + len(text), 1_700_000_000_000_000_000 + len(text)))


def _run(spark, root, tmp_path, apply):
    stream = W.watch(spark, str(root), str(tmp_path / "snapshots"))
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()


def test_changes_of_a_tree(spark, tmp_path):
    root, table = tmp_path / "tree", f"{tmp_path}/state"
    for path, text in (("a.py", "one"), ("src/b.py", "two two"), ("src/c.py", "three"), (".git/x", "no"), ("node_modules/y.js", "no"), (".hidden", "no")):
        _write(root, path, text)
    seen = []

    def apply(batch, batch_id):
        seen.append((batch_id, sorted((r.change, r.path) for r in batch.collect())))
        W.keep_up(table)(batch, batch_id)

    _run(spark, root, tmp_path, apply)
    _write(root, "a.py", "changed")
    os.rename(root / "src/b.py", root / "moved.py")
    (root / "src/c.py").unlink()
    _write(root, "new/d.py", "four")
    _run(spark, root, tmp_path, apply)
    _run(spark, root, tmp_path, apply)  # nothing new
    full = [rows for _, rows in seen if rows]
    assert full == [[("created", "a.py"), ("created", "src/b.py"), ("created", "src/c.py")], [("created", "moved.py"), ("created", "new/d.py"), ("deleted", "src/b.py"), ("deleted", "src/c.py"), ("modified", "a.py")]]
    last = max(k for k, rows in seen if rows)
    found = {(r.change, r.path, r.old_path) for r in spark.read.parquet(f"{table}/changes/batch={last}").collect()}
    assert found == {("moved", "moved.py", "src/b.py"), ("created", "new/d.py", None), ("deleted", "src/c.py", None), ("modified", "a.py", None)}
    assert {r.path for r in current(spark, f"{table}/files").filter("not gone").collect()} == {"a.py", "moved.py", "new/d.py"}


def test_a_batch_between_two_listings_is_always_the_same(tmp_path):
    root = tmp_path / "tree"
    _write(root, "a", "1")
    reader = W.Tree({"path": str(root), "snapshots": str(tmp_path / "kept")}).streamReader(None)
    start = reader.initialOffset()
    first = reader.latestOffset()
    assert first == {"snapshot": 1} == reader.latestOffset()
    _write(root, "b", "22")
    second = reader.latestOffset()
    (root / "a").unlink()  # after the listing
    rows = lambda: [r for p in reader.partitions(first, second) for r in reader.read(p)]
    assert rows() == rows() and [r[:3] for r in rows()] == [(2, "created", "b")]
    gone = [r for p in reader.partitions(start, second) for r in reader.read(p)]
    assert [(r[1], r[2], r[5] is None) for r in gone] == [("created", "a", True), ("created", "b", False)]
    assert [r[:3] for p in reader.partitions(second, reader.latestOffset()) for r in reader.read(p)] == [(3, "deleted", "a")]


def test_copies_are_paired_once(spark):
    batch = spark.createDataFrame([("created", "n1", "x"), ("created", "n2", "x"), ("created", "n3", None), ("deleted", "o1", None), ("deleted", "o2", None)], "change string, path string, digest string")
    known = spark.createDataFrame([("o1", "x"), ("o2", "y")], "path string, digest string")
    assert {tuple(r) for r in W.moved(batch, known).collect()} == {("moved", "n1", "o1"), ("created", "n2", None), ("created", "n3", None), ("deleted", "o2", None)}
