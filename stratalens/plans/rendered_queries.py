"""Manifests of every format, rendered from the order lines and read back by the parsers.

An order is a project, its parts are what it depends on: versions, kinds and options come from quantities, flags and suppliers. The
oracles know nothing of the formats: they say what must come out of the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import facts, scan
from stratalens.registry import query
from stratalens.sources import manifests as M
from stratalens.sources.tables import table

#: One row for each part of an order: o, p, a (line), b (quantity), f (flag), s (supplier).
_DEPS = "SELECT l_orderkey AS o, l_partkey AS p, max(l_linenumber) AS a, CAST(max(l_quantity) AS INTEGER) AS b, max(l_returnflag) AS f, max(l_suppkey) AS s FROM {} GROUP BY l_orderkey, l_partkey"
DEPS = f"({_DEPS.format('lineitem')})"


def _files(spark, sf_dir, name: str, content: str):
    """A file of this name for each order; `content` is an expression over its rows."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("__lines")
    return spark.sql(f"SELECT concat('repo', o, '/', '{name}') AS path, {content} AS content FROM ({_DEPS.format('__lines')}) GROUP BY o")


def _body(line: str, sep: str = "\\n", where: str = "true") -> str:
    """The lines of an order's parts, sorted."""
    return f"array_join(sort_array(collect_list({line}) FILTER (WHERE {where})), '{sep}')"


def _rows(name: str, columns: str, rest: str = "") -> str:
    return f"SELECT 'repo' || o || '/{name}' AS path, {columns} FROM {DEPS} {rest}"


_VERSION = "a || '.' || b || '.0'"
_KIND = "CASE WHEN f = 'R' THEN 'dev' ELSE 'prod' END"


def _package_json(spark, sf_dir):
    entry = """concat('"pkg', p, '": "^', a, '.', b, '.0"')"""
    return _files(spark, sf_dir, "package.json", f"""concat('{{"name": "app', o, '", "dependencies": {{', {_body(entry, ', ', "f <> 'R'")}, '}}, "devDependencies": {{', {_body(entry, ', ', "f = 'R'")}, '}}}}')""")


@query(_rows("package.json", f"'app' || o AS project, 'pkg' || p AS name, '^' || {_VERSION} AS version, {_KIND} AS kind"))
def q_order_package_json(spark, sf_dir):
    return M.package_json(_package_json(spark, sf_dir))


@query(_rows("package-lock.json", f"CASE WHEN a = 1 THEN '@acme/' ELSE '' END || 'pkg' || p AS name, {_VERSION} AS version, CASE f WHEN 'R' THEN 'dev' WHEN 'A' THEN 'optional' ELSE 'prod' END AS kind, a <> 1 AS is_direct"))
def q_order_npm_lock(spark, sf_dir):
    entry = """concat('"node_modules/', if(a = 1, '@acme/', ''), 'pkg', p, '": {"version": "', a, '.', b, '.0"', CASE f WHEN 'R' THEN ', "dev": true' WHEN 'A' THEN ', "optional": true' ELSE '' END, '}')"""
    return M.npm_lock(_files(spark, sf_dir, "package-lock.json", f"""concat('{{"lockfileVersion": 3, "packages": {{"": {{"name": "app"}}, ', {_body(entry, ', ')}, '}}}}')"""))


def _requirements(spark, sf_dir):
    return _files(spark, sf_dir, "requirements.txt", "concat('# pinned\\n-r base.txt\\n\\n', " + _body("concat('pkg', p, CASE WHEN b > 40 THEN '' ELSE concat(CASE f WHEN 'R' THEN ' >= ' WHEN 'A' THEN '==' ELSE '~=' END, a, '.', b) END, '  # of ', s)") + ", '\\n')")


@query(_rows("requirements.txt", "'pkg' || p AS name, CASE WHEN b > 40 THEN 'any' WHEN f = 'R' THEN '>=' WHEN f = 'A' THEN '==' ELSE '~=' END AS operator, CASE WHEN b > 40 THEN '' ELSE a || '.' || b END AS version"))
def q_order_requirements(spark, sf_dir):
    return M.requirements(_requirements(spark, sf_dir))


@query(f"""{_rows("pyproject.toml", f"'tool.poetry.dependencies' AS section, 'pkg' || p AS key, '^' || {_VERSION} AS value, CAST(4 + row_number() OVER (PARTITION BY o ORDER BY 'pkg' || p || ' = ') AS INTEGER) AS line")}
UNION ALL SELECT DISTINCT 'repo' || o || '/pyproject.toml', 'tool.poetry', 'name', 'app' || o, 2 FROM {DEPS}""")
def q_order_pyproject(spark, sf_dir):
    return M.sections(_files(spark, sf_dir, "pyproject.toml", "concat('[tool.poetry]\\nname = \"app', o, '\"\\n\\n[tool.poetry.dependencies]\\n', " + _body("""concat('pkg', p, ' = "^', a, '.', b, '.0"')""") + ")"))


def _cargo(spark, sf_dir):
    entry = """concat('pkg', p, ' = ', if(b > 25, concat('{ version = "', a, '.', b, '.0", features = ["x"] }'), concat('"', a, '.', b, '.0"')))"""
    return _files(spark, sf_dir, "Cargo.toml", f"""concat('[package]\\nname = "app', o, '"\\n\\n[dependencies]\\n', {_body(entry, where="f <> 'R'")}, '\\n\\n[dev-dependencies]\\n', {_body(entry, where="f = 'R'")}, '\\n')""")


@query(_rows("Cargo.toml", f"'pkg' || p AS name, {_VERSION} AS version, {_KIND} AS kind"))
def q_order_cargo(spark, sf_dir):
    return M.cargo(_cargo(spark, sf_dir))


_BLOCK = """concat('[[package]]\\nname = "pkg', p, '"\\nversion = "', a, '.', b, '.0"\\n')"""


@query(_rows("Cargo.lock", f"'pkg' || p AS name, {_VERSION} AS version") + " UNION ALL " + _rows("poetry.lock", f"'pkg' || p AS name, {_VERSION} AS version"))
def q_order_lock_blocks(spark, sf_dir):
    """Cargo.lock and poetry.lock."""
    both = [_files(spark, sf_dir, n, f"concat('version = 3\\n\\n', {_body(_BLOCK)})") for n in ("Cargo.lock", "poetry.lock")]
    return M.lock_blocks(both[0], "Cargo.lock").unionByName(M.lock_blocks(both[1], "poetry.lock"))


@query(_rows("yarn.lock", f"CASE WHEN a = 1 THEN '@acme/' ELSE '' END || 'pkg' || p AS name, {_VERSION} AS version"))
def q_order_yarn_lock(spark, sf_dir):
    entry = """concat(if(a = 1, concat('"@acme/pkg', p, '@^1.0"'), concat('pkg', p, '@^', a)), ':\\n  version "', a, '.', b, '.0"\\n  resolved "https://example.org/x"')"""
    return M.yarn_lock(_files(spark, sf_dir, "yarn.lock", f"concat('# yarn lockfile v1\\n\\n', {_body(entry, '\\n\\n')}, '\\n')"))


def _go_mod(spark, sf_dir):
    return _files(spark, sf_dir, "go.mod", "concat('module example.com/app', o, '\\n\\ngo 1.', max(b), '\\n\\nrequire (\\n', " + _body("concat('\\t', 'example.com/pkg', p, ' v', a, '.', b, '.0', if(f = 'R', ' // indirect', ''))") + ", '\\n)\\n')")


@query(_rows("go.mod", f"'example.com/pkg' || p AS name, {_VERSION} AS version, f = 'R' AS indirect, 'example.com/app' || o AS module, '1.' || max(b) OVER (PARTITION BY o) AS go"))
def q_order_go_mod(spark, sf_dir):
    return M.go_mod(_go_mod(spark, sf_dir))


@query(_rows("go.sum", f"'example.com/pkg' || p AS name, {_VERSION} AS version"))
def q_order_go_sum(spark, sf_dir):
    entry = "concat('example.com/pkg', p, ' v', a, '.', b, '.0 h1:abc=\\n', 'example.com/pkg', p, ' v', a, '.', b, '.0/go.mod h1:def=')"
    return M.go_sum(_files(spark, sf_dir, "go.sum", _body(entry)))


def _maven(spark, sf_dir):
    entry = "concat('<dependency><groupId>org.s', s, '</groupId><artifactId>', if(b = 50, 'spring-boot-', 'pkg'), p, '</artifactId><version>', a, '.', b, '.0</version></dependency>')"
    return _files(spark, sf_dir, "pom.xml", f"concat('<project><artifactId>app', o, '</artifactId><dependencies>', {_body(entry)}, '</dependencies></project>')")


@query(_rows("pom.xml", f"""'app' || o AS project, 'org.s' || s AS "group", CASE WHEN b = 50 THEN 'spring-boot-' ELSE 'pkg' END || p AS name, {_VERSION} AS version, max(b) OVER (PARTITION BY o) = 50 AS spring_boot"""))
def q_order_maven(spark, sf_dir):
    return M.maven(_maven(spark, sf_dir))


_CONFIGURATION = "CASE f WHEN 'R' THEN 'testImplementation' WHEN 'A' THEN 'api' ELSE 'implementation' END"


@query(_rows("build.gradle.kts", f"{_CONFIGURATION} AS kind, 'org.s' || s || ':pkg' || p || ':' || {_VERSION} AS module"))
def q_order_gradle(spark, sf_dir):
    entry = f"""concat('    ', {_CONFIGURATION}, if(b > 25, '(', ' '), '"org.s', s, ':pkg', p, ':', a, '.', b, '.0"', if(b > 25, ')', ''))"""
    return M.gradle(_files(spark, sf_dir, "build.gradle.kts", f"concat('plugins {{ }}\\ndependencies {{\\n', {_body(entry)}, '\\n}}\\n')"))


@query(f"""SELECT 'repo' || o || '/build.gradle' AS path, CAST(max(b) AS INTEGER) AS "compileSdk", CASE WHEN max(a) > 2 THEN CAST(min(b) AS INTEGER) END AS "minSdk", CAST(max(a) AS INTEGER) AS "targetSdk" FROM {DEPS} GROUP BY o""")
def q_order_gradle_android(spark, sf_dir):
    return M.gradle_android(_files(spark, sf_dir, "build.gradle", "concat('android {\\n  compileSdk ', max(b), '\\n', if(max(a) > 2, concat('  minSdk = ', min(b), '\\n'), ''), '  targetSdk ', max(a), '\\n}')"))


@query(f"SELECT 'repo' || o || '/CMakeLists.txt' AS path, 'app' || o AS project, max(a) || '.' || max(b) AS version, list('Pkg' || p ORDER BY 'Pkg' || p) FILTER (f <> 'R') AS packages, list('lib' || p ORDER BY 'lib' || p) FILTER (f = 'R') AS targets FROM {DEPS} GROUP BY o HAVING count(*) FILTER (f = 'R') > 0 AND count(*) FILTER (f <> 'R') > 0")
def q_order_cmake(spark, sf_dir):
    packages, targets = _body("concat('find_package(Pkg', p, ' REQUIRED) # not find_package(No)')", where="f <> 'R'"), _body("concat(if(b > 25, 'add_library(lib', 'add_executable(lib'), p, ' x.cpp)')", where="f = 'R'")
    found = M.cmake(_files(spark, sf_dir, "CMakeLists.txt", f"concat('project(app', o, ' VERSION ', max(a), '.', max(b), ' LANGUAGES CXX)\\n', {packages}, '\\n', {targets})"))
    return found.filter("size(packages) > 0 and size(targets) > 0").withColumn("targets", F.sort_array("targets"))


@query(f"SELECT 'repo' || o || '/AndroidManifest.xml' AS path, 'com.app' || o AS package, coalesce(list('android.permission.P' || p ORDER BY 'P' || p) FILTER (f <> 'R'), []) AS permissions, coalesce(list('.A' || p ORDER BY 'A' || p) FILTER (f = 'R'), []) AS components FROM {DEPS} GROUP BY o")
def q_order_android_manifest(spark, sf_dir):
    permissions, components = _body("""concat('<uses-permission android:name="android.permission.P', p, '"/>')""", where="f <> 'R'"), _body("""concat('<activity android:exported="true" android:name=".A', p, '"/>')""", where="f = 'R'")
    return M.android_manifest(_files(spark, sf_dir, "AndroidManifest.xml", f"""concat('<manifest package="com.app', o, '">', {permissions}, '<application>', {components}, '</application></manifest>')"""))


@query(f"SELECT 'repo' || o || '/board.dts' AS path, list_concat(list('v,chip' || p ORDER BY 'v,chip' || p), ['generic,chip']) AS compatible, 'Board ' || o AS model FROM {DEPS} GROUP BY o")
def q_order_device_tree(spark, sf_dir):
    entry = """concat('node', p, ' { compatible = "v,chip', p, '"; };')"""
    rows = M.device_tree(_files(spark, sf_dir, "board.dts", f"""concat('/ {{ model = "Board ', o, '";\\n', {_body(entry)}, '\\nlast {{ compatible = "v,chip', min(p), '", "generic,chip"; }}; }};')"""))
    return rows.withColumn("compatible", F.concat(F.sort_array(F.array_remove("compatible", "generic,chip")), F.filter("compatible", lambda x: x == "generic,chip")))


@query(_rows("defconfig", "'P' || p AS name, CASE f WHEN 'R' THEN 'enabled' WHEN 'A' THEN 'module' ELSE 'value' END AS state, CASE f WHEN 'R' THEN 'y' WHEN 'A' THEN 'm' ELSE CAST(b AS VARCHAR) END AS value"))
def q_order_kernel_config(spark, sf_dir):
    return M.kernel_config(_files(spark, sf_dir, "defconfig", "concat('# CONFIG_OFF is not set\\n', " + _body("concat('CONFIG_P', p, '=', CASE f WHEN 'R' THEN 'y' WHEN 'A' THEN 'm' ELSE cast(b AS string) END)") + ")"))


@query(_rows("flash.ld", "'start' || o AS entry, 'R' || p AS region, CASE f WHEN 'R' THEN 'rx' ELSE 'rwx' END AS access, '0x' || p AS origin, b || 'K' AS size"))
def q_order_linker_script(spark, sf_dir):
    entry = "concat('  R', p, ' (', CASE f WHEN 'R' THEN 'rx' ELSE 'rwx' END, ') : ORIGIN = 0x', p, ', LENGTH = ', b, 'K')"
    return M.linker_script(_files(spark, sf_dir, "flash.ld", f"concat('ENTRY(start', o, ')\\nMEMORY {{\\n', {_body(entry)}, '\\n}}')"))


@query(_rows("FreeRTOSConfig.h", "'configP' || p AS name, b AS value", "WHERE f <> 'R'"))
def q_order_rtos_config(spark, sf_dir):
    return M.defines(_files(spark, sf_dir, "FreeRTOSConfig.h", _body("concat('#define configP', p, '  ', if(f = 'R', '( x )', cast(b AS string)))")))


@query(_rows("Android.mk", "'LOCAL_P' || p AS name, ['a' || a || '.c', 'b' || b || '.c'] AS values", "WHERE f <> 'R'") + " UNION ALL " + _rows("Application.mk", "'APP_P' || p AS name, ['a' || a || '.c', 'b' || b || '.c'] AS values", "WHERE f <> 'R'"))
def q_order_make_variables(spark, sf_dir):
    """Android.mk and Application.mk."""
    line = "concat(if(f = 'R', '# ', ''), '{}_P', p, if(b > 25, ' := ', ' += '), 'a', a, '.c  b', b, '.c')".format
    return M.make_variables(_files(spark, sf_dir, "Android.mk", _body(line("LOCAL"))).unionByName(_files(spark, sf_dir, "Application.mk", _body(line("APP")))))


@query(f"SELECT 'repo' || o || '/ci.yml' AS path, list('P' || p ORDER BY 'P' || p) AS secrets FROM {DEPS} WHERE f = 'R' GROUP BY o")
def q_order_secret_references(spark, sf_dir):
    return M.secret_references(_files(spark, sf_dir, "ci.yml", _body("concat('  run: ', if(f = 'R', concat('echo ${{ secrets.P', p, ' }} ${{secrets.P', p, '}}'), 'echo $P'))")))


_YAML = "repo' || o || '"


@query(
    f"""SELECT 'repo' || o || '/.github/workflows/ci.yml' AS path, 'github' AS platform, list('job' || p ORDER BY 'job' || p) AS jobs, CAST([] AS VARCHAR[]) AS stages FROM {DEPS} GROUP BY o
UNION ALL SELECT 'repo' || o || '/.gitlab-ci.yml', 'gitlab', coalesce(list('job' || p ORDER BY 'job' || p) FILTER (f <> 'R'), []), ['build', 'stage' || max(b)] FROM {DEPS} GROUP BY o
UNION ALL SELECT 'repo' || o || '/Jenkinsfile', 'jenkins', [], list('stage ' || p ORDER BY 'stage ' || p) FROM {DEPS} GROUP BY o"""
)
def q_order_pipelines(spark, sf_dir):
    """Workflows, pipelines and Jenkinsfiles with a job or stage for each part."""
    github = _files(spark, sf_dir, ".github/workflows/ci.yml", "concat('name: ci\\non: push\\njobs:\\n', " + _body("concat('  job', p, ':\\n    runs-on: linux')") + ", '\\n')")
    gitlab = _files(spark, sf_dir, ".gitlab-ci.yml", "concat('stages: [build, stage', max(b), ']\\n', " + _body("concat('job', p, ':\\n  ', if(f = 'R', 'extends', 'script'), ': x')") + ", '\\n')")
    jenkins = _files(spark, sf_dir, "Jenkinsfile", "concat('pipeline { stages {\\n', " + _body("concat('stage(''stage ', p, ''') { }')") + ", '\\n} }')")
    return M.pipelines(github.unionByName(gitlab).unionByName(jenkins)).withColumn("stages", F.when(F.col("platform") == "jenkins", F.sort_array("stages")).otherwise(F.col("stages")))


@query(
    f"""SELECT 'repo' || o || '/.circleci/config.yml' AS path, 'circleci' AS platform, list('job' || p ORDER BY 'job' || p) AS jobs, CAST([] AS VARCHAR[]) AS stages FROM {DEPS} GROUP BY o
UNION ALL SELECT 'repo' || o || '/azure-pipelines.yml', 'azure', [], list('stage' || p ORDER BY 'stage' || p) FROM {DEPS} GROUP BY o"""
)
def q_order_other_pipelines(spark, sf_dir):
    circle = _files(spark, sf_dir, ".circleci/config.yml", "concat('version: 2.1\\njobs:\\n', " + _body("concat('  job', p, ':\\n    docker: x')") + ", '\\nworkflows:\\n  main: x\\n')")
    azure = _files(spark, sf_dir, "azure-pipelines.yml", "concat('stages:\\n', " + _body("concat('- stage: stage', p, '\\n  jobs: []')") + ")")
    return facts.other_pipelines(circle.unionByName(azure)).withColumn("jobs", F.sort_array("jobs"))


@query(_rows(".env", "CAST(row_number() OVER (PARTITION BY o ORDER BY CASE WHEN f = 'R' THEN 'export ' ELSE '' END || 'P' || p || '_') + 1 AS INTEGER) AS line, 'P' || p || CASE WHEN f = 'R' THEN '_TOKEN' ELSE '_URL' END AS name, CASE WHEN f = 'R' THEN '***' ELSE 'v' || b END AS value, f = 'R' AS is_secret"))
def q_order_env_files(spark, sf_dir):
    return scan.env_variables(_files(spark, sf_dir, ".env", "concat('# settings\\n', " + _body("concat(if(f = 'R', 'export ', ''), 'P', p, if(f = 'R', '_TOKEN', '_URL'), '=v', b)") + ")"))


_ALL = f"""(SELECT p, {_KIND} AS kind, '^' || {_VERSION} AS version, 'npm' AS source, 'pkg' || p AS name FROM {DEPS}
UNION ALL SELECT p, 'prod', CASE WHEN b > 40 THEN '' ELSE a || '.' || b END, 'pip', 'pkg' || p FROM {DEPS} UNION ALL SELECT p, {_KIND}, {_VERSION}, 'cargo', 'pkg' || p FROM {DEPS}
UNION ALL SELECT p, 'prod', {_VERSION}, 'go', 'example.com/pkg' || p FROM {DEPS} UNION ALL SELECT p, 'prod', {_VERSION}, 'maven', CASE WHEN b = 50 THEN 'spring-boot-' ELSE 'pkg' END || p FROM {DEPS})"""


def _dependencies(spark, sf_dir):
    files = [f(spark, sf_dir) for f in (_package_json, _requirements, _cargo, _go_mod, _maven)]
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    return M.dependencies(out)


@query(f"SELECT source, kind, count(*) AS n, count(DISTINCT name) AS names FROM {_ALL} GROUP BY source, kind")
def q_order_dependencies(spark, sf_dir):
    """Direct dependencies of five ecosystems under one schema."""
    return _dependencies(spark, sf_dir).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"))


@query(f"SELECT name, list_sort(list(DISTINCT version)) AS versions, CAST(count(DISTINCT version) AS INTEGER) AS n FROM {_ALL} GROUP BY name HAVING count(DISTINCT version) > 1")
def q_order_version_conflicts(spark, sf_dir):
    return M.conflicts(_dependencies(spark, sf_dir))
