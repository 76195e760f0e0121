"""Manifest queries over the inline corpus; those that read grammars SQL can't are checked by tests."""

from __future__ import annotations

from stratalens.operators import scan
from stratalens.registry import query, sql_values
from stratalens.sources import manifests as M
from stratalens.sources.corpus import MANIFESTS
from stratalens.sources.tables import table
from pyspark.sql import functions as F

SRC = sql_values(MANIFESTS, ["path", "content"])
_named = lambda n: f"(SELECT * FROM {SRC} WHERE regexp_extract(path, '([^/]+)$', 1) = '{n}')"
_lines = lambda n: f"(SELECT path, unnest(string_split(content, chr(10))) AS content, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM {_named(n)})"


def _files(spark):
    return spark.createDataFrame(MANIFESTS, "path string, content string")


_NPM = "(" + " UNION ALL ".join(f"SELECT path, json_extract_string(content, '$.name') AS project, k AS name, json_extract_string(content, '$.{f}.\"' || k || '\"') AS version, '{kind}' AS kind FROM (SELECT path, content, unnest(json_keys(content, '$.{f}')) AS k FROM {_named('package.json')} WHERE json_exists(content, '$.{f}'))" for f, kind in (("dependencies", "prod"), ("devDependencies", "dev"), ("peerDependencies", "peer"))) + ")"


@query(f"SELECT * FROM {_NPM}")
def q_package_json(spark, sf_dir):
    return M.package_json(_files(spark))


@query(f"""SELECT path, regexp_replace(k, '^.*node_modules/', '') AS name, json_extract_string(v, '$.version') AS version, CASE WHEN json_extract_string(v, '$.dev') = 'true' THEN 'dev' WHEN json_extract_string(v, '$.optional') = 'true' THEN 'optional' WHEN json_extract_string(v, '$.peer') = 'true' THEN 'peer' ELSE 'prod' END AS kind,
  NOT starts_with(regexp_replace(k, '^.*node_modules/', ''), '@') AS is_direct FROM (SELECT path, k, json_extract(content, '$.packages."' || k || '"') AS v FROM (SELECT path, content, unnest(json_keys(content, '$.packages')) AS k FROM {_named('package-lock.json')}))""")
def q_npm_lock(spark, sf_dir):
    return M.npm_lock(_files(spark))


_R = "$p$" + M.REQUIREMENT + "$p$"
_REQ = f"(SELECT path, regexp_extract(content, {_R}, 1) AS name, coalesce(nullif(regexp_extract(content, {_R}, 2), ''), 'any') AS operator, regexp_extract(content, {_R}, 3) AS version FROM {_lines('requirements.txt')} WHERE regexp_matches(content, {_R}))"


@query(f"SELECT * FROM {_REQ}")
def q_requirements(spark, sf_dir):
    return M.requirements(_files(spark))


_SECTION = """(SELECT path, line, last_value(CASE WHEN regexp_matches(content, '^\\[+[^\\]]+\\]+\\s*$') THEN regexp_extract(content, '^\\[+([^\\]]+)\\]+', 1) END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line) AS section,
  regexp_extract(content, '^([A-Za-z0-9_.-]+)\\s*=\\s*(.+?)\\s*$', 1) AS key, regexp_replace(regexp_extract(content, '^([A-Za-z0-9_.-]+)\\s*=\\s*(.+?)\\s*$', 2), '^"|"$', '', 'g') AS value FROM {})""".format
_CARGO = f"""(SELECT path, key AS name, CASE WHEN starts_with(value, '{{') THEN regexp_extract(value, 'version\\s*=\\s*"([^"]*)"', 1) ELSE value END AS version, CASE section WHEN 'dependencies' THEN 'prod' ELSE 'dev' END AS kind FROM {_SECTION(_lines('Cargo.toml'))} WHERE key <> '' AND section IN ('dependencies', 'dev-dependencies'))"""


@query(f"SELECT * FROM {_CARGO}")
def q_cargo(spark, sf_dir):
    return M.cargo(_files(spark))


@query(f"SELECT path, section, key, value, line FROM {_SECTION(_lines('pyproject.toml'))} WHERE key <> ''")
def q_pyproject(spark, sf_dir):
    return M.sections(M.named(_files(spark), "pyproject.toml"))


@query(f"""SELECT path, regexp_extract(b, 'name = "([^"]+)"', 1) AS name, regexp_extract(b, 'version = "([^"]+)"', 1) AS version FROM (SELECT path, unnest(string_split(content, '[[package]]')) AS b FROM {_named('Cargo.lock')}) WHERE contains(b, 'name = "')""")
def q_cargo_lock(spark, sf_dir):
    return M.lock_blocks(_files(spark), "Cargo.lock")


@query(f"""SELECT path, regexp_extract(b, '^"?(@?[^@"\\n]+)@', 1) AS name, regexp_extract(b, 'version "([^"]+)"', 1) AS version FROM (SELECT path, unnest(string_split(content, chr(10) || chr(10))) AS b FROM {_named('yarn.lock')}) WHERE contains(b, 'version "')""")
def q_yarn_lock(spark, sf_dir):
    return M.yarn_lock(_files(spark))


_GO = f"""(SELECT l.path, regexp_extract(f.content, '(?m)^module\\s+(\\S+)', 1) AS module, regexp_extract(f.content, '(?m)^go\\s+(\\S+)', 1) AS go, regexp_extract(l.content, '^\\s*([a-zA-Z0-9_./-]+\\.[a-zA-Z0-9_./-]+)\\s+v(\\S+)', 1) AS name, regexp_extract(l.content, '^\\s*([a-zA-Z0-9_./-]+\\.[a-zA-Z0-9_./-]+)\\s+v(\\S+)', 2) AS version, contains(l.content, '// indirect') AS indirect
  FROM {_lines('go.mod')} l JOIN {_named('go.mod')} f USING (path) WHERE regexp_matches(l.content, '^\\s*([a-zA-Z0-9_./-]+\\.[a-zA-Z0-9_./-]+)\\s+v(\\S+)'))"""


@query(f"SELECT * FROM {_GO}")
def q_go_mod(spark, sf_dir):
    return M.go_mod(_files(spark))


@query(f"SELECT path, p[1] AS name, arg_max(regexp_replace(regexp_replace(p[2], '/go.mod$', ''), '^v', ''), line) AS version FROM (SELECT path, line, string_split(content, ' ') AS p FROM {_lines('go.sum')}) WHERE len(p) >= 3 GROUP BY path, p[1]")
def q_go_sum(spark, sf_dir):
    return M.go_sum(_files(spark))


_G, _A, _V = (f"regexp_extract_all(content, '<dependency>.*?<{t}>([^<]+)</{t}>', 1)" for t in ("groupId", "artifactId", "version"))
_MVN = f"""(SELECT path, regexp_extract(content, '<artifactId>([^<]+)</artifactId>', 1) AS project, unnest({_G}) AS "group", unnest({_A}) AS name, unnest({_V}) AS version, contains(content, 'spring-boot') AS spring_boot FROM {_named('pom.xml')})"""


@query(f"SELECT * FROM {_MVN}")
def q_maven(spark, sf_dir):
    return M.maven(_files(spark))


_GR = """$p$(?m)^\\s*(\\w*[iI]mplementation|api|kapt|compileOnly)\\s*\\(?["']([^"']+)["']$p$"""


@query(f"SELECT path, unnest(regexp_extract_all(content, {_GR}, 1)) AS kind, unnest(regexp_extract_all(content, {_GR}, 2)) AS module FROM {_named('build.gradle')}")
def q_gradle(spark, sf_dir):
    return M.gradle(_files(spark))


@query("SELECT path, " + ", ".join(f"CAST(nullif(regexp_extract(content, '{k}\\s*=?\\s*(\\d+)', 1), '') AS INTEGER) AS {k}" for k in ("compileSdk", "minSdk", "targetSdk")) + f" FROM {_named('build.gradle')}")
def q_gradle_android(spark, sf_dir):
    return M.gradle_android(_files(spark))


@query(f"SELECT path, regexp_extract(t, 'project\\s*\\(\\s*(\\w+)', 1) AS project, regexp_extract(t, 'VERSION\\s+([0-9.]+)\\s+LANGUAGES', 1) AS version, regexp_extract_all(t, 'find_package\\s*\\(\\s*(\\w+)', 1) AS packages, regexp_extract_all(t, 'add_(?:executable|library)\\s*\\(\\s*(\\w+)', 1) AS targets FROM (SELECT path, regexp_replace(content, '(?m)#.*$', '', 'g') AS t FROM {_named('CMakeLists.txt')})")
def q_cmake(spark, sf_dir):
    return M.cmake(_files(spark))


@query(f"""SELECT path, regexp_extract(content, 'package="([^"]+)"', 1) AS package, regexp_extract_all(content, '<uses-permission[^>]*android:name="([^"]+)"', 1) AS permissions, regexp_extract_all(content, '<(?:activity|service|receiver|provider)[^>]*android:name="([^"]+)"', 1) AS components FROM {_named('AndroidManifest.xml')}""")
def q_android_manifest(spark, sf_dir):
    return M.android_manifest(_files(spark))


@query(rf"""SELECT path, list_filter(l, lambda x, i: list_position(l, x) = i) AS compatible, model FROM (SELECT path, flatten([regexp_extract_all(x, '"([^"]+)"', 1) FOR x IN regexp_extract_all(content, 'compatible\s*=\s*([^;]+);', 1)]) AS l, regexp_extract(content, 'model\s*=\s*"([^"]+)"', 1) AS model FROM {SRC} WHERE regexp_matches(path, '\.dtsi?$'))""")
def q_device_tree(spark, sf_dir):
    return M.device_tree(_files(spark))


@query(f"SELECT path, regexp_extract(content, '^CONFIG_([A-Za-z0-9_]+)=(.*)$', 1) AS name, CASE regexp_extract(content, '^CONFIG_([A-Za-z0-9_]+)=(.*)$', 2) WHEN 'y' THEN 'enabled' WHEN 'm' THEN 'module' ELSE 'value' END AS state, regexp_extract(content, '^CONFIG_([A-Za-z0-9_]+)=(.*)$', 2) AS value FROM (SELECT * FROM {_lines('.config')} UNION ALL SELECT * FROM {_lines('prj.conf')}) WHERE regexp_matches(content, '^CONFIG_')")
def q_kernel_config(spark, sf_dir):
    return M.kernel_config(_files(spark))


_LD = "'(\\w+)\\s*\\((\\w+)\\)\\s*:\\s*ORIGIN\\s*=\\s*(\\w+),\\s*LENGTH\\s*=\\s*(\\w+)'"


@query(f"SELECT path, regexp_extract(content, 'ENTRY\\((\\w+)\\)', 1) AS entry, unnest(regexp_extract_all(content, {_LD}, 1)) AS region, unnest(regexp_extract_all(content, {_LD}, 2)) AS access, unnest(regexp_extract_all(content, {_LD}, 3)) AS origin, unnest(regexp_extract_all(content, {_LD}, 4)) AS size FROM {_named('link.ld')}")
def q_linker_script(spark, sf_dir):
    return M.linker_script(_files(spark))


@query(f"SELECT path, regexp_extract(content, '^#define\\s+(config\\w+)\\s+(\\d+)', 1) AS name, CAST(regexp_extract(content, '^#define\\s+(config\\w+)\\s+(\\d+)', 2) AS INTEGER) AS value FROM {_lines('FreeRTOSConfig.h')} WHERE regexp_matches(content, '^#define\\s+config\\w+\\s+\\d+')")
def q_rtos_config(spark, sf_dir):
    return M.defines(_files(spark))


@query(f"SELECT path, regexp_extract(content, '^((?:LOCAL|APP)_\\w+)\\s*[:+]?=\\s*(.*)$', 1) AS name, string_split_regex(trim(regexp_extract(content, '^((?:LOCAL|APP)_\\w+)\\s*[:+]?=\\s*(.*)$', 2)), '\\s+') AS values FROM {_lines('Android.mk')} WHERE regexp_matches(content, '^(?:LOCAL|APP)_')")
def q_make_variables(spark, sf_dir):
    return M.make_variables(_files(spark))


@query()
def q_pipelines(spark, sf_dir):
    return M.pipelines(_files(spark))


@query(f"SELECT path, list_sort(list_distinct(regexp_extract_all(content, '\\$\\{{\\{{\\s*secrets\\.(\\w+)\\s*\\}}\\}}', 1))) AS secrets FROM {SRC} WHERE regexp_matches(content, '\\$\\{{\\{{\\s*secrets\\.')")
def q_secret_references(spark, sf_dir):
    return M.secret_references(_files(spark))


_DEPS = f"(SELECT path, name, version, kind, 'npm' AS source FROM {_NPM} UNION ALL SELECT path, name, version, 'prod', 'pip' FROM {_REQ} UNION ALL SELECT path, name, version, kind, 'cargo' FROM {_CARGO} UNION ALL SELECT path, name, version, 'prod', 'go' FROM {_GO} UNION ALL SELECT path, name, version, 'prod', 'maven' FROM {_MVN})"


@query(f"SELECT * FROM {_DEPS}")
def q_dependencies(spark, sf_dir):
    return M.dependencies(_files(spark))


@query(f"SELECT source, kind, count(*) AS n FROM {_DEPS} GROUP BY source, kind")
def q_dependency_summary(spark, sf_dir):
    return M.dependencies(_files(spark)).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT name, list_sort(list(DISTINCT version)) AS versions, count(DISTINCT version) AS n FROM {_DEPS} GROUP BY name HAVING count(DISTINCT version) > 1")
def q_version_conflicts(spark, sf_dir):
    return M.conflicts(M.dependencies(_files(spark)))


_E = "$p$^\\s*(?:export\\s+)?([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*(.*)$$p$"


@query(f"SELECT path, line, name, CASE WHEN is_secret THEN '***' ELSE value END AS value, is_secret FROM (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY line DESC) AS r, regexp_matches(lower(name), 'password|passwd|pwd|secret|api_key|apikey|token|private|credential|auth|session|cookie|ssh_?key|aws_|database_url') AS is_secret FROM (SELECT path, line, regexp_extract(content, {_E}, 1) AS name, regexp_replace(trim(regexp_extract(content, {_E}, 2)), '^[\"'']|[\"'']$', '', 'g') AS value FROM {_lines('.env')} WHERE regexp_matches(content, {_E}) AND NOT starts_with(ltrim(content), '#'))) WHERE r = 1")
def q_env_files(spark, sf_dir):
    return scan.env_variables(M.named(_files(spark), ".env"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1)) AS links, len(regexp_extract_all(html, '<script')) AS scripts FROM pages")
def q_html_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    count = lambda p: F.regexp_count("html", F.lit(p))
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), count('<a[^>]*href="([^"]*)"').alias("links"), count("<script").alias("scripts"))
