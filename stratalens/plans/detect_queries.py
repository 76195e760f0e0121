"""What projects are. The SQL spells the rules out that can match the small projects, on its own."""

from __future__ import annotations

from stratalens.operators import detect as D
from stratalens.registry import query, sql_values
from stratalens.sources.corpus import PROJECTS

SRC = sql_values(PROJECTS, ["project", "path", "content"])
NAME = "regexp_extract(path, '([^/]+)$', 1)"
PARTS = "string_split(path, '/')"


def _files(spark):
    return spark.createDataFrame(PROJECTS, "project string, path string, content string")


# (rule's place, type, language, build system, priority, patterns)
_RULES = """(VALUES (11, 'android-app', 'kotlin', 'gradle', 90, ['build.gradle', 'app/src/main']), (20, 'stm32', 'c', 'stm32cubeide', 95, ['*.ioc']), (25, 'esp32', 'c', 'cmake', 85, ['sdkconfig', 'CMakeLists.txt']), (27, 'zephyr', 'c', 'cmake', 85, ['Kconfig', 'CMakeLists.txt', 'zephyr']),
  (30, 'embedded-linux', 'dts', 'dtc', 75, ['*.dts', '*.dtsi']), (37, 'react', 'typescript', 'npm', 85, ['package.json', 'src/index.tsx']), (38, 'react', 'typescript', 'npm', 85, ['package.json', 'src/main.tsx']), (47, 'fastapi', 'python', 'pip', 80, ['main.py', 'requirements.txt', 'fastapi']),
  (48, 'flask', 'python', 'pip', 80, ['app.py', 'requirements.txt']), (50, 'gradle-java', 'java', 'gradle', 90, ['build.gradle', 'src/main/java']), (54, 'electron', 'javascript', 'npm', 80, ['package.json', 'electron']), (56, 'cmake', 'cpp', 'cmake', 70, ['CMakeLists.txt']),
  (60, 'pytorch', 'python', 'pip', 75, ['requirements.txt', 'torch']), (61, 'tensorflow', 'python', 'pip', 75, ['requirements.txt', 'tensorflow'])) AS r(rule, type, language, build_system, priority, patterns)"""
_TYPES = f"""(WITH e AS (SELECT rule, type, language, build_system, priority, len(patterns) AS n, unnest(patterns) AS p FROM {_RULES}),
  h AS (SELECT project, rule, type, language, build_system, priority, n, p, max(CASE WHEN starts_with(p, '*.') THEN CASE WHEN ends_with(path, substr(p, 2)) THEN 2 ELSE 0 END WHEN path = p OR starts_with(path, p || '/') THEN 3
    WHEN p IN ('fastapi', 'torch', 'tensorflow', 'electron', 'zephyr') AND regexp_matches(path, '\\.(py|js|ts|json|h|c|cpp|md)$') AND contains(lower(content), p) THEN 1 ELSE 0 END) AS s FROM {SRC}, e GROUP BY ALL),
  g AS (SELECT project, rule, type, language, build_system, round(sum(s) / 2.0 * (1 + priority / 100.0) * sum(CASE s WHEN 3 THEN 1 WHEN 2 THEN 1 WHEN 1 THEN 0.5 ELSE 0 END) / n, 6) AS score FROM h GROUP BY project, rule, type, language, build_system, priority, n),
  b AS (SELECT project, type, max(score) AS score, arg_max(rule, score) AS rule, any_value(language) AS language, any_value(build_system) AS build_system FROM g WHERE score >= 0.5 GROUP BY project, type)
SELECT project, type, language, build_system, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, rule) AS rank FROM b) WHERE rank <= 3)"""


@query(f"SELECT * FROM {_TYPES}")
def q_project_types(spark, sf_dir):
    return D.detect_types(_files(spark))


@query(f"""SELECT project, coalesce(first(platform ORDER BY rank) FILTER (platform IS NOT NULL), 'unknown') AS platform FROM (SELECT project, rank, CASE WHEN type = 'android-app' THEN 'android' WHEN type IN ('stm32', 'esp32', 'zephyr', 'embedded-linux') THEN 'embedded'
  WHEN type IN ('react', 'fastapi', 'flask') THEN 'web' WHEN type = 'electron' THEN 'desktop' WHEN type = 'cmake' THEN 'native' END AS platform FROM {_TYPES}) GROUP BY project""")
def q_platforms(spark, sf_dir):
    return D.platforms(D.detect_types(_files(spark)))


@query(f"SELECT project, path, CASE {NAME} WHEN 'main.c' THEN 1 WHEN 'main.cpp' THEN 2 WHEN 'main.py' THEN 3 WHEN 'MainActivity.kt' THEN 7 WHEN 'main.tsx' THEN 11 WHEN 'app.js' THEN 25 END AS rank FROM {SRC} WHERE {NAME} IN ('main.c', 'main.cpp', 'main.py', 'MainActivity.kt', 'main.tsx', 'app.js')")
def q_entry_points(spark, sf_dir):
    return D.entry_points(_files(spark))


@query(f"SELECT project, path, CAST(strlen(content) AS BIGINT) AS size, content[:500] AS preview FROM {SRC} WHERE path IN ('build.gradle', 'CMakeLists.txt', 'package.json', 'requirements.txt', 'pyproject.toml', 'tsconfig.json') OR regexp_matches(path, '\\.(ioc|dts|dtsi)$')")
def q_config_files(spark, sf_dir):
    return D.config_files(_files(spark))


@query(f"SELECT DISTINCT project, unnest(list_intersect([lower(x) FOR x IN {PARTS}[:-2]], ['vehicle', 'hud', 'services', 'system', 'core', 'common', 'apps'])) AS subsystem FROM {SRC}")
def q_subsystems(spark, sf_dir):
    return D.subsystems(_files(spark))


@query(f"SELECT DISTINCT project, {PARTS}[-2] AS process FROM {SRC} WHERE regexp_matches(path, '/main\\.(cpp|c|py|go|rs)$')")
def q_process_names(spark, sf_dir):
    return D.process_names(_files(spark))


@query(f"SELECT DISTINCT project, protocol FROM {SRC}, (VALUES ('.aidl', 'binder'), ('.proto', 'grpc'), ('someip', 'someip'), ('dbus', 'dbus'), ('socket', 'socket')) AS p(part, protocol) WHERE contains(lower(path), part)")
def q_protocols(spark, sf_dir):
    return D.protocols(_files(spark))


_LARGE = [("many", f"d{i}/f{i}.c") for i in range(60)] + [("few", "a/b.c"), ("few", "c.c")]


@query(f"""WITH f AS (SELECT project, path FROM {SRC} UNION ALL SELECT * FROM {sql_values(_LARGE, ['project', 'path'])}), d AS (SELECT project, count(DISTINCT folder) AS folders FROM (SELECT project, unnest(list_transform(range(1, len({PARTS})), lambda i: array_to_string({PARTS}[1:i], '/'))) AS folder FROM f) GROUP BY project),
  c AS (SELECT project, count(*) AS files, bool_or(regexp_matches(path, 'AndroidManifest\\.xml|\\.aidl|system/|frameworks/|vehicle/|infotainment/|adas/')) OR count(*) FILTER (contains(lower(path), 'main.')) > 3 AS multi FROM f GROUP BY project)
SELECT project, files, coalesce(folders, 0) AS folders, multi, CASE WHEN files > 5000 OR coalesce(folders, 0) > 500 OR multi THEN 'large' WHEN files > 500 OR coalesce(folders, 0) > 50 THEN 'medium' ELSE 'small' END AS scale FROM c LEFT JOIN d USING (project)""")
def q_scale(spark, sf_dir):
    return D.scale(_files(spark).select("project", "path").unionByName(spark.createDataFrame(_LARGE, "project string, path string")))
