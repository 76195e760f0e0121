"""The audit journal: retries, attempts that died, rotation, bad lines."""

import json

from stratalens.operators import journal as J

ENTRY = "user string, n long"


def _rows(spark, *rows):
    return spark.createDataFrame(rows, ENTRY)


def test_a_batch_is_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert J.read(spark, path, ENTRY)[0].collect() == []
    assert J.append(_rows(spark, ("a", 1), ("b", None), (None, 3)), path, 7)
    assert not J.append(_rows(spark, ("x", 9)), path, 7)
    good, bad = J.read(spark, path, ENTRY)
    assert sorted(map(str, good.collect())) == sorted(["Row(batch=7, user='a', n=1)", "Row(batch=7, user='b', n=None)", "Row(batch=7, user=None, n=3)"]) and bad.collect() == []
    assert J.append(_rows(spark), path, 8) and J.read(spark, path, ENTRY)[0].count() == 3


def test_attempts_that_died_are_never_read(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    J.append(_rows(spark, ("a", 1)), path, 0)
    (tmp_path / "log" / "lines" / f"{1:020d}-{'a' * 32}").mkdir()
    (tmp_path / "log" / "lines" / f"{1:020d}-{'a' * 32}" / "part-0.txt").write_text('{"user":"ghost","n":0}\n')
    assert [r.user for r in J.read(spark, path, ENTRY)[0].collect()] == ["a"]
    J.append(_rows(spark, ("b", 2)), path, 1)
    assert {r.user for r in J.read(spark, path, ENTRY)[0].collect()} == {"a", "b"}
    assert J.sweep(spark, path) == 1 and {r.user for r in J.read(spark, path, ENTRY)[0].collect()} == {"a", "b"}


def test_bad_lines_are_kept_apart(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    J.append(_rows(spark, ("a", 1)), path, 0)
    folder = json.loads(next((tmp_path / "log" / "commits").glob("*.json")).read_text())["folder"]
    (tmp_path / "log" / folder / "part-9.txt").write_text('{"user": "cut\n\nnot json\n{"user":"b","n":"word"}\n{"user":"c","n":4,"more":true}\n[]\n')
    good, bad = J.read(spark, path, ENTRY)
    assert {(r.user, r.n) for r in good.collect()} == {("a", 1), ("c", 4)}
    assert {r.line for r in bad.collect()} == {'{"user": "cut', "not json", '{"user":"b","n":"word"}', "[]"}


def test_rotation_by_size(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for k in range(6):
        J.append(_rows(spark, *[(f"u{k}", n) for n in range(50)]).coalesce(1), path, k)
    sizes = [c["bytes"] for c in J.commits(spark, path)]
    assert J.rotate(spark, path) == []
    assert J.rotate(spark, path, size=sizes[-1], logs=2) == [0, 1, 2]
    assert {r.batch for r in J.read(spark, path, ENTRY)[0].select("batch").distinct().collect()} == {3, 4, 5}


def test_stream_into_the_journal(spark, tmp_path):
    path, landed = f"file://{tmp_path}/log", str(tmp_path / "landed")
    for k in range(3):
        _rows(spark, (f"u{k}", k)).coalesce(1).write.mode("append").parquet(landed)
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(landed)
        stream.writeStream.foreachBatch(J.sink(path)).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.user for r in J.read(spark, path, ENTRY)[0].collect()) == ["u0", "u1", "u2"]
