"""Facts of files and projects over small sources, with SQL that states the rules on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import facts as A
from stratalens.plans.code_queries import FUNCTIONS, LINES, SRC
from stratalens.registry import query, sql_values
from stratalens.sources.corpus import FILES, PROJECTS
from stratalens.sources.tables import table

_LONG = "def long(a):\n" + "".join(f"    x{i} = {i}\n" for i in range(55)) + "\ndef short():\n    return 1\n"
CODE = [("long.py", _LONG), ("bad.py", "import os\nraise ValueError\neval(x)\ncur.execute('select ' + x)\n"), ("ok.py", "# adds\ndef add(a, b):\n    return a + b\n"), ("tests/ok.py", "assert 1\n"), ("type.py", "if node.type == 'a':\n    pass\nx = Pool.get_instance()\n"), ("empty.py", ""), ("null.py", None)]
_CODE = sql_values(CODE, ["path", "content"])
_T = "coalesce(content, '')"
_BREAKS = f"(length({_T}) - length(replace({_T}, chr(10), '')))"


def _code(spark):
    return spark.createDataFrame(CODE, "path string, content string")


@query(rf"""SELECT *, (maintainability + reliability + security + testability) / 4 AS overall FROM (SELECT path,
  CAST(100 - 10 * len(list_filter(string_split(regexp_replace({_T}, '\n(def|class)', chr(1) || '\1', 'g'), chr(1)), lambda f: regexp_matches(f, 'def\s+\w+\([^)]*\):') AND length(f) - length(replace(f, chr(10), '')) > 50)) - CASE WHEN {_BREAKS} > 0 AND len(regexp_extract_all({_T}, '#[^\n]*')) < 0.1 * {_BREAKS} THEN 5 ELSE 0 END AS DOUBLE) AS maintainability,
  CAST(100 - CASE WHEN regexp_matches({_T}, '\braise\s+') AND NOT regexp_matches({_T}, '\btry\s*:') THEN 10 ELSE 0 END AS DOUBLE) AS reliability,
  CAST(100 - 15 * list_sum([CAST(regexp_matches({_T}, p) AS INTEGER) FOR p IN ['\beval\s*\(', '\bexec\s*\(', '\bcompile\s*\(', '\b__import__\s*\(']]) - CASE WHEN regexp_matches({_T}, 'execute\s*\([^)]*\+') THEN 20 ELSE 0 END AS DOUBLE) AS security,
  CAST(100 - CASE WHEN len(regexp_extract_all({_T}, '(?m)^\s*\w+\s*=')) > 5 THEN 10 ELSE 0 END AS DOUBLE) AS testability FROM {_CODE})""")
def q_quality_axes(spark, sf_dir):
    return A.quality_axes(_code(spark))


COMMITS = [("long.py", "ana", f"2024-03-{d:02d} 00:00:00") for d in range(1, 16)] + [("ok.py", "bo", "2023-01-01 00:00:00"), ("ok.py", "bo", "2024-03-10 00:00:00")]
_COMMITS = sql_values(COMMITS, ["path", "author", "ts"])
_FACTORS = rf"""(SELECT path, least(1.0, (1 + len(regexp_extract_all({_T}, '\b(if|for|while|and|or)\b'))) / 30) AS complexity, coalesce(CASE path WHEN 'long.py' THEN 0.9 END, CASE path WHEN 'ok.py' THEN 0.5 END, 0.0) AS test_coverage, least(1.0, coalesce(recent, 0) / 10) AS change_frequency, least(1.0, coalesce(n, 0) / 20) AS author_experience,
  least(1.0, CASE WHEN {_T} = '' THEN 0 ELSE {_BREAKS} + CASE WHEN ends_with({_T}, chr(10)) THEN 0 ELSE 1 END END / 500) AS code_size FROM {_CODE} LEFT JOIN (SELECT path, count(*) AS n, count(*) FILTER (CAST(ts AS TIMESTAMP) >= TIMESTAMP '2024-03-20' - INTERVAL 30 DAY) AS recent FROM {_COMMITS} GROUP BY path) USING (path))"""


def _factors(spark):
    commits = spark.createDataFrame(COMMITS, "path string, author string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    covered = spark.createDataFrame([("long.py", 0.9)], "path string, share double")
    return A.risk_factors(_code(spark), commits, covered, F.lit("2024-03-20").cast("timestamp_ntz"))


@query(f"SELECT * FROM {_FACTORS}")
def q_risk_factors(spark, sf_dir):
    return _factors(spark)


@query(f"SELECT path, list_filter([CASE WHEN complexity > 0.7 THEN 'split large functions' END, CASE WHEN test_coverage > 0.7 THEN 'add unit tests' END, CASE WHEN change_frequency > 0.7 THEN 'stabilise interfaces' END, CASE WHEN author_experience > 0.7 THEN 'have experienced authors review' END, CASE WHEN code_size > 0.7 THEN 'split large files' END], lambda x: x IS NOT NULL) AS advice FROM {_FACTORS}")
def q_recommendations(spark, sf_dir):
    return A.recommendations(_factors(spark))


RISKS = [("a", "high", 0.9), ("a", "low", 0.9), ("a", "low", 0.1), ("b", "low", 0.95), ("b", "critical", 0.2), ("b", "low", 0.1), ("b", "low", 0.1), ("b", "low", 0.0), ("b", "low", 0.0)]


@query(f"SELECT project, list_filter([CASE WHEN avg(CAST(level IN ('high', 'critical') AS DOUBLE)) > 0.2 THEN 'refactor' END, CASE WHEN avg(CAST(test_coverage > 0.8 AS DOUBLE)) > 0.5 THEN 'add tests first' END], lambda x: x IS NOT NULL) AS advice FROM {sql_values(RISKS, ['project', 'level', 'test_coverage'])} GROUP BY project")
def q_project_recommendations(spark, sf_dir):
    return A.project_recommendations(spark.createDataFrame(RISKS, "project string, level string, test_coverage double"))


@query(rf"SELECT path, unnest(list_filter([CASE WHEN regexp_matches({_T}, 'if\s+.*type\s*==') THEN 'factory' END, CASE WHEN regexp_matches({_T}, 'getInstance|get_instance|_instance') THEN 'singleton' END], lambda x: x IS NOT NULL)) AS hint FROM {_CODE}")
def q_design_hints(spark, sf_dir):
    return A.design_hints(_code(spark))


_TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


@query(f"""WITH p AS (SELECT conv_id, turn, {_TOK.format('text')} AS y, lag({_TOK.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM conversations), s AS (SELECT conv_id, turn, x, y, list_distinct(x) AS a, list_distinct(y) AS b FROM p WHERE x IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE 0.4 * len(list_intersect(a, b)) / len(list_distinct(a || b)) + 0.6 * least(1.0, coalesce(list_sum([ln(4.0 / 3) * len(list_filter(x, lambda z: z = t)) * 2.5 / (len(list_filter(x, lambda z: z = t)) + 1.5) FOR t IN list_intersect(b, a)]), 0) / 10) END, 6) AS score FROM s""")
def q_similarity(spark, sf_dir):
    """Each turn against the one before."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return turns.filter("before is not null").select("conv_id", "turn", F.round(A.similarity(F.col("before"), F.col("text")), 6).alias("score"))


@query(f"""WITH l AS (SELECT path, line, regexp_replace(content, '//.*$', '') AS c FROM {LINES} WHERE lang IS NOT NULL), n AS (SELECT path, line, length(c) - length(replace(c, '{{', '')) AS o, length(c) - length(replace(c, '}}', '')) AS e FROM l)
SELECT f.path, f.name, f.line, (SELECT min(x.line) FROM n x WHERE x.path = f.path AND x.line >= f.line AND x.e > 0 AND (SELECT sum(y.o) FROM n y WHERE y.path = f.path AND y.line BETWEEN f.line AND x.line) > 0 AND (SELECT sum(y.o - y.e) FROM n y WHERE y.path = f.path AND y.line BETWEEN f.line AND x.line) <= 0) AS end_line FROM {FUNCTIONS} f""")
def q_function_ends(spark, sf_dir):
    return A.function_ends(spark.createDataFrame(FILES, "path string, content string"))


NEEDS = [("s1", "go", "github.com/gin-gonic/gin"), ("s1", "go", "gorm.io/gorm"), ("s2", "cargo", "Tokio-util"), ("s2", "cargo", "serde_json"), ("s3", "pip", "Flask-Login"), ("s3", "pip", "torchvision"), ("s3", "pip", "left-pad"), ("s4", "npm", "flask")]
_NEEDS = sql_values(NEEDS, ["project", "source", "name"])


@query(f"SELECT DISTINCT project, framework FROM {_NEEDS}, (VALUES ('go', 'gin-gonic/gin', 'Gin'), ('go', 'gorm', 'GORM'), ('go', 'labstack/echo', 'Echo'), ('cargo', 'tokio', 'Tokio'), ('cargo', 'serde', 'Serde'), ('cargo', 'clap', 'Clap'), ('pip', 'flask', 'Flask'), ('pip', 'torch', 'PyTorch'), ('pip', 'numpy', 'NumPy')) AS f(s, part, framework) WHERE source = s AND contains(CASE source WHEN 'go' THEN name ELSE lower(name) END, part)")
def q_frameworks(spark, sf_dir):
    return A.frameworks(spark.createDataFrame(NEEDS, "project string, source string, name string"))


SETUP = [("a/setup.py", "from setuptools import setup\nsetup(name='demo', version=\"1.2\", install_requires=[\n  'flask>=2',\n  \"numpy\",\n])\n"), ("b/setup.py", "setup()\n"), ("c.py", "name='x'\n")]


@query(rf"""SELECT path, regexp_extract(content, 'name\s*=\s*["'']([^"'']+)["'']', 1) AS name, regexp_extract(content, 'version\s*=\s*["'']([^"'']+)["'']', 1) AS version, regexp_extract_all(regexp_extract(content, 'install_requires\s*=\s*\[([^\]]+)\]', 1), '["'']([^"'']+)["'']', 1) AS requires FROM {sql_values(SETUP, ['path', 'content'])} WHERE ends_with(path, 'setup.py')""")
def q_setup_py(spark, sf_dir):
    return A.setup_py(spark.createDataFrame(SETUP, "path string, content string"))


PYTHON = [("p", "requirements.txt"), ("p", "setup.py"), ("p", "manage.py"), ("p", "app.py"), ("p", "src/main.py"), ("q", "pyproject.toml"), ("r", "main.py")]
PYTHON_DEPS = [("p", "Django"), ("p", "requests"), ("p", "Django"), ("r", "flask")]


@query(f"""SELECT project, configs, coalesce(dependencies, []) AS dependencies, CASE project WHEN 'p' THEN ['Django'] ELSE [] END AS frameworks, main_file FROM (SELECT project, list_sort(list(DISTINCT path) FILTER (path IN ('requirements.txt', 'pyproject.toml', 'setup.py', 'setup.cfg'))) AS configs, arg_min(path, CASE path WHEN 'main.py' THEN 1 WHEN 'app.py' THEN 2 WHEN 'run.py' THEN 3 WHEN 'manage.py' THEN 4 WHEN '__main__.py' THEN 5 END) AS main_file
  FROM {sql_values(PYTHON, ['project', 'path'])} WHERE NOT contains(path, '/') GROUP BY project) LEFT JOIN (SELECT project, list_sort(list(DISTINCT name)) AS dependencies FROM {sql_values(PYTHON_DEPS, ['project', 'name'])} GROUP BY project) USING (project) WHERE len(configs) > 0""")
def q_python_projects(spark, sf_dir):
    return A.python_projects(spark.createDataFrame(PYTHON, "project string, path string"), spark.createDataFrame(PYTHON_DEPS, "project string, name string"))


CI = [(".circleci/config.yml", "version: 2\njobs:\n  build:\n    docker: x\n  test-all:\n    docker: y\nworkflows:\n  main:\n    jobs: [build]\n"), ("azure-pipelines.yml", "stages:\n- stage: Build\n  jobs: []\n- stage: Deploy\n"), ("ci.yml", "jobs:\n  a:\n")]


@query("SELECT * FROM (VALUES ('.circleci/config.yml', 'circleci', ['build', 'test-all'], CAST([] AS VARCHAR[])), ('azure-pipelines.yml', 'azure', [], ['Build', 'Deploy'])) AS t(path, platform, jobs, stages)")
def q_other_pipelines(spark, sf_dir):
    return A.other_pipelines(spark.createDataFrame(CI, "path string, content string"))


RUNS = [("p", "github", ["A", "B"]), ("p", "github", ["A"]), ("p", "gitlab", []), ("q", "azure", None)]


@query(f"SELECT project, list_sort(list(DISTINCT platform)) AS platforms, count(*) AS pipelines, len(list_distinct(flatten(list(coalesce(secrets, []))))) AS secrets FROM {sql_values(RUNS, ['project', 'platform', 'secrets'])} GROUP BY project")
def q_pipeline_report(spark, sf_dir):
    return A.pipeline_report(spark.createDataFrame(RUNS, "project string, platform string, secrets array<string>"))


_DECLARED = rf"""(SELECT path, lang, CASE WHEN lang IN ('go', 'rust', 'c') THEN 'struct' ELSE 'class' END AS kind, coalesce(nullif(regexp_extract(content, '^\s*(?:export\s+|default\s+|abstract\s+|public\s+|private\s+|protected\s+|final\s+|static\s+)*class\s+(\w+)', 1), ''), nullif(regexp_extract(content, '^\s*type\s+(\w+)\s+struct', 1), ''), nullif(regexp_extract(content, '^\s*(?:pub\s+)?struct\s+(\w+)', 1), '')) AS name, line, content FROM {LINES} WHERE lang IS NOT NULL)"""


@query(rf"SELECT path, lang, kind, name, nullif(coalesce(nullif(regexp_extract(content, 'extends\s+([\w.]+)', 1), ''), regexp_extract(content, '^\s*class\s+\w+\(\s*([\w.]+)', 1)), '') AS base, line FROM {_DECLARED} WHERE name IS NOT NULL")
def q_declarations(spark, sf_dir):
    return A.declarations(spark.createDataFrame(FILES, "path string, content string"))


DECLARED = [("a.ts", "export abstract class A extends B.C {\n}\nexport interface I extends J {\n"), ("b.rs", "pub(crate) struct S;\npub enum E {\ntrait T {\n"), ("c.go", "type S struct {\ntype R interface {\n"), ("d.cpp", "class D : public E {\nclass F;\n"), ("e.py", "class P(Base, X):\n"), ("f.c", "typedef struct node {\n")]


@query("SELECT * FROM (VALUES ('a.ts', 'typescript', 'class', 'A', 'B.C', 1), ('a.ts', 'typescript', 'interface', 'I', 'J', 3), ('b.rs', 'rust', 'struct', 'S', NULL, 1), ('b.rs', 'rust', 'enum', 'E', NULL, 2), ('b.rs', 'rust', 'trait', 'T', NULL, 3), ('c.go', 'go', 'struct', 'S', NULL, 1), ('c.go', 'go', 'interface', 'R', NULL, 2), ('d.cpp', 'cpp', 'class', 'D', 'E', 1), ('e.py', 'python', 'class', 'P', 'Base', 1), ('f.c', 'c', 'struct', 'node', NULL, 1)) AS t(path, lang, kind, name, base, line)")
def q_declaration_kinds(spark, sf_dir):
    return A.declarations(spark.createDataFrame(DECLARED, "path string, content string"))


@query(rf"""SELECT path, list_sort(list_distinct(regexp_extract_all(content, '(?m)^\s*#include\s*[<"]([^>"]+)[>"]', 1)))[:20] AS includes, list_sort(list_distinct(regexp_extract_all(content, '(?m)^\s*#define\s+(\w+)', 1)))[:20] AS macros FROM {SRC} WHERE regexp_matches(path, '\.(c|h|cc|cpp|hpp)$')""")
def q_c_facts(spark, sf_dir):
    return A.c_facts(spark.createDataFrame(FILES, "path string, content string"))


@query(rf"""SELECT lang, count(*) AS files, sum(f) AS functions, sum(d) AS declarations, sum(i) AS imports FROM (SELECT path, any_value(lang) AS lang, (SELECT count(*) FROM {FUNCTIONS} f WHERE f.path = l.path) AS f, (SELECT count(*) FROM {_DECLARED} d WHERE d.path = l.path AND d.name IS NOT NULL) AS d,
  count(*) FILTER (CASE lang WHEN 'python' THEN regexp_matches(content, '^\s*(import|from)\s') WHEN 'java' THEN regexp_matches(content, '^import\s') WHEN 'c' THEN false WHEN 'cpp' THEN false WHEN 'rust' THEN regexp_matches(content, '^use\s') WHEN 'go' THEN regexp_matches(content, '^import\s+"') ELSE regexp_matches(content, '^import\s.*from|require\(') END) AS i FROM {LINES} l WHERE lang IS NOT NULL GROUP BY path) GROUP BY lang""")
def q_structure_totals(spark, sf_dir):
    return A.structure_totals(spark.createDataFrame(FILES, "path string, content string"))


WEB = [("api.py", "@app.get('/items')\ndef items(): ...\n@router.POST(\"/items\", status=1)\n"), ("src/user.controller.ts", "@Get()\nall() {}\n@Post('create')\n"), ("pages/api/users/index.ts", "x"), ("pages/api/index.js", "x"), ("pages/home.ts", "x")]


@query("SELECT * FROM (VALUES ('api.py', 'fastapi', 'GET', '/items'), ('api.py', 'fastapi', 'POST', '/items'), ('src/user.controller.ts', 'nestjs', 'GET', '/'), ('src/user.controller.ts', 'nestjs', 'POST', 'create'), ('pages/api/users/index.ts', 'next-api', NULL, '/api/users'), ('pages/api/index.js', 'next-api', NULL, '/api/')) AS t(path, kind, method, route)")
def q_routes(spark, sf_dir):
    return A.routes(spark.createDataFrame(WEB, "path string, content string"))


PARTS = [("src/components/Menu.tsx", ""), ("src/App.tsx", ""), ("shop/models.py", ""), ("shop/views.py", ""), ("blog/models.py", ""), ("A.java", "@RestController\n@RequestMapping(\"/a\")\npublic class A {}\n@Service class B {}\n@Entity class C {}\n")]


@query("SELECT * FROM (VALUES ('react', 'Menu', 'src/components/Menu.tsx'), ('django', 'shop', 'shop'), ('RestController', 'A', 'A.java'), ('Service', 'B', 'A.java')) AS t(kind, name, path)")
def q_components(spark, sf_dir):
    return A.components(spark.createDataFrame(PARTS, "path string, content string"))


@query("SELECT * FROM (VALUES ('py', 'backend', 1.0), ('droid', 'backend', 1.0), ('native', 'unknown', 0.0), ('web', 'frontend', 2.5), ('desk', 'frontend', 1.0), ('car', 'backend', 0.5), ('board', 'unknown', 0.0), ('none', 'unknown', 0.0)) AS t(project, kind, score)")
def q_repository_kinds(spark, sf_dir):
    """By hand: of equal scores the first kind counts, as for py with requirements.txt (backend) and pyproject.toml (library)."""
    return A.repository_kinds(spark.createDataFrame(PROJECTS, "project string, path string, content string"))


IPC = [("bus.xml", '<node><interface name="org.x.Log"><method name="Put"/><method name="Get"/></interface></node>'), ("car_someip.json", '{"services": [{"name": "Nav", "methods": [{"name": "go"}], "events": [{"name": "moved"}]}]}'), ("net.c", 'bind(fd, "/run/log.sock");\n// unix socket at /tmp/a.sock\n'), ("x.json", "{}")]
_IPC = "(VALUES ('bus.xml', 'dbus', 'org.x.Log', 'Put'), ('bus.xml', 'dbus', 'org.x.Log', 'Get'), ('car_someip.json', 'someip', 'Nav', 'go'), ('car_someip.json', 'someip', 'Nav', 'event:moved'), ('net.c', 'tcp_socket', 'log', 'connect'), ('net.c', 'tcp_socket', 'log', 'send'), ('net.c', 'tcp_socket', 'log', 'receive'), ('net.c', 'unix_socket', 'a', 'connect'), ('net.c', 'unix_socket', 'a', 'send'), ('net.c', 'unix_socket', 'a', 'receive')) AS t(path, protocol, interface, method)"


@query(f"SELECT * FROM {_IPC}")
def q_more_interfaces(spark, sf_dir):
    return A.more_interfaces(spark.createDataFrame(IPC, "path string, content string"))


@query(f"SELECT interface, '### ' || interface || chr(10) || chr(10) || '- protocol: ' || protocol || chr(10) || '- file: `' || path || '`' || chr(10) || '- methods: ' || count(DISTINCT method) || chr(10) || chr(10) || array_to_string(list_sort(list(DISTINCT '- `' || method || '`')), chr(10)) AS text FROM {_IPC} GROUP BY interface, protocol, path")
def q_interface_document(spark, sf_dir):
    return A.interface_document(A.more_interfaces(spark.createDataFrame(IPC, "path string, content string")))


NOTES = [("a.py", "# see #12 and Issue: #12, PROJ-7\n"), ("b.py", "https://host.org/o/r/issues/45 https://host.org/o/r/-/issues/46"), ("c.py", "nothing")]


@query(rf"SELECT path, unnest(list_distinct(regexp_extract_all(content, '#(\d+)', 1) || regexp_extract_all(content, 'Issue[:\s]+#?(\d+)', 1) || regexp_extract_all(content, '([A-Z]+-\d+)', 1) || regexp_extract_all(content, 'https://[^/\s]+/[^/\s]+/[^/\s]+/(?:-/)?issues/(\d+)', 1))) AS issue FROM {sql_values(NOTES, ['path', 'content'])}")
def q_issue_references(spark, sf_dir):
    return A.issue_references(spark.createDataFrame(NOTES, "path string, content string"))
