"""Operators on small inputs with known answers, nulls, and empty tables."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from stratalens.functions import text as T
from stratalens.operators import blocking, catalog, code, collect, graph, records, reports, scan, search
from stratalens.sources import files, manifests
from stratalens.sources.corpus import FILES, MANIFESTS
from stratalens.plans import review_queries
from stratalens.streaming import changes


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    lit = F.lit
    assert _one(spark, T.normalize_question(lit(" 请问登录如何实现方式吗？ "))) == "登录怎么实现方式吗？"
    assert _one(spark, T.slug(lit("How do  I?"))) == "How_do_I" and _one(spark, T.diagram_id(lit("3-a"))) == "n3_a"
    assert _one(spark, T.mask(lit("password = hunter22 ok"))) == 'password="***MASKED***" ok'
    assert _one(spark, T.human_size(lit(1536.0))) == "1.5 KB"
    assert _one(spark, T.jaccard(F.array(lit("a")), F.array(lit("a"), lit("b")))) == 0.5
    assert len(_one(spark, T.pseudo_embedding(lit("x")))) == 1536
    assert _one(spark, T.normalize_question(lit(None).cast("string"))) is None


def test_scans_take_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "python"), (2, "", "python"), (3, "token = abcdefghijkl\neval(x)", "python")], "doc_id long, text string, lang string")
    assert [(r.doc_id, r.type) for r in scan.secrets(docs).collect()] == [(3, "token")]
    assert [(r.line, r.rule) for r in scan.security_issues(docs).collect()] == [(2, "eval_usage")]
    assert scan.line_stats(docs).count() == 3 and scan.quality(docs).count() == 3
    for f in (scan.secrets, scan.line_stats, scan.smells, scan.todos, scan.duplicate_blocks, scan.quality, scan.nesting):
        assert f(docs.limit(0)).count() == 0


def test_code_blocks_repeat(spark):
    text = "\n".join(["a", "b", "c", "d", "e", "x", "a", " b", "c", "d", "e"])
    rows = scan.duplicate_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.start_line, r.end_line, r.n) for r in rows] == [(1, 6, 2)]


def test_search_without_matches(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "fox red"), (1, "zebra")], "query_id long, query string")
    assert [(r.query_id, r.doc_id) for r in search.bm25(docs, asked).collect()] == [(0, 1), (0, 2)]
    assert {r.query_id for r in search.tfidf(docs, asked).collect()} == {0}
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in search.vector_top(vectors, [1.0, 0.0], 3).collect()] == [(1, 1.0), (3, 0.707107), (2, 0.0)]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert [r.cycle for r in graph.cycles(edges).collect()] == [["a", "b", "c"]]
    hops = {r.node: r.distance for r in graph.k_hop(edges, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert hops == {"b": 1, "c": 2, "a": 3, "d": 3}
    assert {r.node: r.level for r in graph.build_levels(edges, 5).collect()} == {"d": 0}


def test_catalog(spark):
    old, new = (spark.createDataFrame(rows, "k int, v string") for rows in ([(1, "a"), (2, "b"), (3, None)], [(2, "c"), (3, None), (4, "d")]))
    assert sorted(map(tuple, catalog.snapshot_diff(old, new, "k", "v").collect())) == [(1, "deleted"), (2, "modified"), (4, "added")]
    assert sorted(map(tuple, catalog.upsert(old, new, ["k"]).collect()), key=str) == [(1, "a"), (2, "c"), (3, None), (4, "d")]
    steps = spark.createDataFrame([(1, 1, "approve"), (1, 2, "merge"), (2, 1, "merge"), (3, 1, "reject"), (3, 2, "approve")], "id int, t int, action string")
    assert {r.id: r.status for r in catalog.workflow_status(steps, "id", "t").collect()} == {1: "merged", 2: "pending", 3: "rejected"}


def test_code_and_manifests(spark):
    files, conf = spark.createDataFrame(FILES, "path string, content string"), spark.createDataFrame(MANIFESTS, "path string, content string")
    names = {(r.path, r.name) for r in code.functions(files).collect()}
    assert {("src/app/main.py", "load"), ("svc/server.go", "Handle"), ("svc/lib.rs", "open"), ("web/index.js", "stop")} <= names
    assert {(r.src, r.dst) for r in code.calls(files).collect()} >= {("main", "load"), ("main", "run"), ("load", "parse")}
    kinds = {(r.kind, r.name) for r in code.syntax(files).collect()}
    assert ("class", "Store") in kinds and ("function", "get") in kinds
    assert {(r.platform, tuple(r.jobs), tuple(r.stages)) for r in manifests.pipelines(conf).collect()} == {("github", ("deploy", "test"), ()), ("gitlab", ("pack", "unit"), ("build", "test")), ("jenkins", (), ("Build", "Test"))}
    tree = manifests.device_tree(conf).first()
    assert tree.compatible == ["vendor,board", "vendor,soc", "arm,pl011"] and tree.model == "Board One"
    assert [(r.chunk, r.low) for r in code.chunks(files.filter("path = 'src/app/main.py'")).collect()][0] == (0, 1)


def test_templates(spark):
    rows = spark.createDataFrame([("a", True, ["x", "y"]), ("b", False, [])], "k string, big boolean, xs array<string>")
    found = {r.k: r.text for r in reports.rendered(rows, "k", "{{ k }}{% if big %}!{% endif %}{% for x in xs %} {{ x }}{% endfor %}").collect()}
    assert found == {"a": "a! x y", "b": "b"}


def test_incremental_table(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/table"
    for part in ([("a", 1, "x"), ("b", 1, "x"), ("b", 3, "y"), ("b", 2, "z")], [("b", 2, "old"), ("c", 2, "x"), ("c", 2, "z"), ("a", 5, None)]):
        spark.createDataFrame(part, "k string, v int, w string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, v int, w string").parquet(source)
        changes.maintain(stream, changes.upsert_into(target, ["k"], ["v"], buckets=3), f"{tmp_path}/check")
    assert sorted((r.k, r.v, r.w) for r in changes.current(spark, target).collect()) == [("a", 5, None), ("b", 3, "y"), ("c", 2, "z")]
    again = spark.createDataFrame([("b", 2, "old"), ("c", 2, "x"), ("c", 2, "z"), ("a", 5, None)], "k string, v int, w string")
    changes.upsert_into(target, ["k"], ["v"], buckets=3)(again, 1)
    assert changes.current(spark, target).count() == 3 and changes.current(spark, f"{tmp_path}/none") is None


def test_blocking_joins_lose_nothing(spark):
    long = [(i, t) for i, t in enumerate(["src/app/main.py", "a", "", "main.py", "x/main.pyc", "ab", None])]
    short = [(i, t) for i, t in enumerate(["main.py", "a", "ab", "src/app/main.py", "zz", "", None])]
    found = blocking.containing(spark.createDataFrame(long, "i int, t string"), spark.createDataFrame(short, "j int, p string"), "t", "p").select("i", "j").collect()
    assert sorted(map(tuple, found)) == sorted((i, j) for i, t in long for j, p in short if t and p and p in t)
    sets = [(i, sorted({f"w{(i * k) % 17}" for k in range(1, 2 + i % 9)})) for i in range(60)]
    one = spark.createDataFrame(sets, "i int, a array<string>")
    pairs = [(tuple(r.a), tuple(r.b)) for r in blocking.alike(one, one.toDF("j", "b"), "a", "b", 0.5).collect()]
    assert len(pairs) == len(set(pairs))
    assert {(tuple(x), tuple(y)) for _, x in sets for _, y in sets if len(set(x) & set(y)) >= 0.5 * len(set(x) | set(y))} <= set(pairs)
    rows = [(i, float(i * 7 % 101), i + 1) for i in range(100)]
    got = {r.id: r.before for r in blocking.sums_before(spark.createDataFrame(rows, "id int, at double, n long"), "at", "n").collect()}
    assert got == {i: sum(n for _, b, n in rows if b > a) for i, a, _ in rows}
    assert blocking.sums_before(spark.createDataFrame([], "at double, n long"), "at", "n").count() == 0


def test_sinks(spark, tmp_path):
    reports.write(spark.range(5).withColumn("p", F.col("id") % 2), f"{tmp_path}/t", "json", ["p"])
    assert spark.read.json(f"{tmp_path}/t").count() == 5


def test_reviews(spark):
    assert {(r.name, r.comment) for r in review_queries.q_comments_above(spark, "").collect()} == {("add", "Adds."), ("run", "Runs it.")}
    assert {r.id: r.valid for r in review_queries.q_verified(spark, "").collect()} == {1: True, 2: False, 3: False}


def test_long_lines_are_not_cut(spark):
    code, author, path = "x" * 150_000, "n" * 1_500, "p/" * 1_000 + "é"
    lines = spark.createDataFrame([("f", 1, "author " + author), ("f", 2, "\t" + code)], "file string, n int, line string")
    assert [tuple(r) for r in files.blame(lines).collect()] == [("f", 1, author, code)]
    assert changes.short_status(spark.createDataFrame([(1, " M " + path)], "id int, line string")).first().path == path


def test_stores(spark, tmp_path):
    collect.save_index({"l0": spark.range(3), "l1": spark.range(2)}, f"{tmp_path}/index")
    assert {n: t.count() for n, t in collect.load_index(spark, f"{tmp_path}/index", ["l0", "l1", "l2"]).items()} == {"l0": 3, "l1": 2}
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00"), (3, "2024-01-02 11:00:00")], "id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    collect.append_log(rows, f"{tmp_path}/log")
    collect.append_log(rows.filter("id = 3"), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    assert collect.drop_days(spark, f"{tmp_path}/log", "2024-01-02") == 1 and spark.read.json(f"{tmp_path}/log").count() == 3


def test_trees_are_scanned(spark, tmp_path):
    for name, text in (("a/x.py", "x = 1\n"), ("a/b/y.MD", "é"), ("z", "1")):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(text)
    rows = files.scan_tree(spark, f"{tmp_path}/tree").collect()
    assert sorted((r.path, r.ext, r.size, r.content) for r in rows) == [("a/b/y.MD", "md", 2, "é"), ("a/x.py", "py", 6, "x = 1\n"), ("z", "", 1, "1")]


def test_poetry_locks(spark):
    text = '[[package]]\nname = "flask"\nversion = "2.3.2"\n\n[[package]]\nname = "numpy"\nversion = "1.26.0"\n'
    rows = manifests.lock_blocks(spark.createDataFrame([("a/poetry.lock", text), ("b/Cargo.lock", text)], "path string, content string"), "poetry.lock").collect()
    assert sorted((r.path, r.name, r.version) for r in rows) == [("a/poetry.lock", "flask", "2.3.2"), ("a/poetry.lock", "numpy", "1.26.0")]


def test_partial_updates_keep_one_row(spark):
    table = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, None, 30)], "k int, v string, n int")
    changes = spark.createDataFrame([(1, "x", None, 1), (1, "y", None, 3), (1, None, 7, 2), (3, None, None, 1), (9, "z", 1, 1)], "k int, v string, n int, at int")
    assert sorted(map(tuple, records.set_fields(table, changes, "k", "at").collect())) == [(1, "y", 7), (2, "b", 20), (3, None, 30)]
    assert sorted(map(tuple, records.set_fields(table, changes.drop("at"), "k").collect())) == [(1, "y", 7), (2, "b", 20), (3, None, 30)]


def test_public_resources_are_everyones(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    resources = spark.createDataFrame([(10, 1, "t", "team"), (11, 9, "t", "public"), (12, 9, "u", "private")], "resource_id int, owner int, team string, visibility string")
    members = spark.createDataFrame([(2, "t", "viewer")], "user_id int, team string, role string")
    none = spark.createDataFrame([], "user_id int, resource_id int, role string")
    roles = spark.createDataFrame([("viewer", "read")], "role string, action string")
    found = records.accessible(users, resources, members, none, roles).collect()
    assert sorted(map(str, found)) == sorted(map(str, [Row(user_id=1, resource_id=10), Row(user_id=2, resource_id=10), Row(user_id=2, resource_id=11), Row(user_id=None, resource_id=11)]))
    assert records.accessible(users, resources, members, none, roles, "write").count() == 1


def test_pipelines_read_plain_names_without_a_parser():
    import time

    import yaml

    def parsed(content, github):
        try:
            doc = yaml.safe_load(content)
        except yaml.YAMLError:
            doc = None
        doc = doc if isinstance(doc, dict) else {}
        if github:
            return sorted(map(str, doc.get("jobs") or {})), []
        return sorted(str(k) for k, v in doc.items() if isinstance(v, dict) and "script" in v), [str(s) for s in doc.get("stages") or []]

    odd = ["", "\n", "a", "jobs:", "jobs: ab", "jobs:\n  b:\n  a: x\n  b:\n    c: d", "jobs:\n  a:\njobs:\n  b:\n", "jobs:\n  on: x\n  NO:\n", "jobs:\n  a: x\n    b: y\n", "jobs:\n  1:\n    a: b\n", "jobs:\n    a: b\n", "jobs: {a: 1, b: 2}", "jobs:\n- a\n- b\n"]
    odd += ["jobs:\n  'a b':\n    x: y # c\n", "jobs:\n  a:\n\tb: c\n", "stages: [a, b]\nb:\n  script: x\na:\n  script:\n", "stages: [a, no]\n", "stages: ab\n", "stages:\n  a: b\n", "stages:\n- a\n- b\nx:\n  script: [a]\n", "stages: []\nx: script\n", "x:\n  extends:\n    script: a\n", "x:\n  <<: *a\n", f"jobs:\n  {'a' * 1100}: x\n"]
    for content in odd:
        assert [manifests._pipeline(content, g) for g in (True, False)] == [parsed(content, g) for g in (True, False)], content
    assert manifests._pipeline(None, True) == ([], [])
    many = ["name: ci\non: push\njobs:\n" + "".join(f"  job{i + k}:\n    runs-on: linux\n" for k in range(6)) for i in range(300)]
    began = time.process_time()
    truth = [parsed(content, True) for content in many]
    plain = time.process_time()
    assert [manifests._pipeline(content, True) for content in many] == truth
    assert 5 * (time.process_time() - plain) < plain - began
