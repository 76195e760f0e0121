"""Facts of files and projects: quality axes, risk factors, advice, frameworks, declarations, routes, repositories, interfaces.

Files are (path, content), or (project, path, content) with paths relative to the project. A null content is an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import text as T
from stratalens.operators import code as K
from stratalens.sources.files import base_name
from stratalens.sources.tables import lines

# Calls that cost safety, decisions that count as complexity, and where a factor of risk reaches 1.
DANGEROUS_CALLS = ["eval", "exec", "compile", "__import__"]
DECISIONS = [r"\bif\b", r"\bfor\b", r"\bwhile\b", r"\band\b", r"\bor\b"]
FULL_COMPLEXITY, FULL_CHANGES, FULL_COMMITS, FULL_LINES = 30, 10, 20, 500
ADVICE = {"complexity": "split large functions", "test_coverage": "add unit tests", "change_frequency": "stabilise interfaces", "author_experience": "have experienced authors review", "code_size": "split large files"}

# Parts of dependency names and the frameworks that they stand for.
GO_FRAMEWORKS = {"gin-gonic/gin": "Gin", "labstack/echo": "Echo", "gofiber/fiber": "Fiber", "go-chi/chi": "Chi", "gorilla/mux": "Gorilla Mux", "gorm": "GORM", "spf13/cobra": "Cobra", "spf13/viper": "Viper"}
RUST_FRAMEWORKS = {
    "tokio": "Tokio", "actix-web": "Actix Web", "rocket": "Rocket", "warp": "Warp", "axum": "Axum", "serde": "Serde", "clap": "Clap", "diesel": "Diesel",
    "sqlx": "SQLx", "sea-orm": "SeaORM", "egui": "egui", "iced": "Iced", "yew": "Yew", "leptos": "Leptos", "bevy": "Bevy",
}
PYTHON_FRAMEWORKS = {
    "django": "Django", "flask": "Flask", "fastapi": "FastAPI", "tornado": "Tornado", "aiohttp": "Aiohttp", "sanic": "Sanic", "starlette": "Starlette",
    "pydantic": "Pydantic", "sqlalchemy": "SQLAlchemy", "pandas": "Pandas", "numpy": "NumPy", "torch": "PyTorch", "tensorflow": "TensorFlow", "scikit-learn": "Scikit-learn",
}
FRAMEWORKS = {"go": GO_FRAMEWORKS, "cargo": RUST_FRAMEWORKS, "pip": PYTHON_FRAMEWORKS}
PYTHON_MAINS = ["main.py", "app.py", "run.py", "manage.py", "__main__.py"]

# What speaks for a kind of repository: files (1), folders (0.5), words of its package.json (0.5).
REPOSITORY_KINDS = {
    "frontend": (["package.json", "tsconfig.json", "webpack.config.js", "vite.config.ts"], ["src/components", "src/pages", "public"], ["react", "vue", "angular", "svelte"]),
    "backend": (["pom.xml", "build.gradle", "go.mod", "requirements.txt"], ["src/main", "api", "controllers", "services"], ["spring", "express", "django", "flask", "fastapi"]),
    "library": (["Cargo.toml", "setup.py", "pyproject.toml"], ["lib", "src/lib"], []),
    "service": (["Dockerfile", "docker-compose.yml", "k8s", ".kubernetes"], ["proto", "protobuf", "grpc"], ["grpc", "protobuf", "microservice"]),
    "mobile": (["pubspec.yaml", "build.gradle", "AndroidManifest.xml", "Info.plist"], ["lib", "android", "ios"], ["flutter", "react-native", "kotlin", "swift"]),
}

# Declarations by language (kind, pattern with the name, and the base where there is one).
DECLARATIONS = [
    ("javascript", "class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)(?:\s+extends\s+([\w.]+))?"),
    ("typescript", "class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+([\w.]+))?"),
    ("typescript", "interface", r"^\s*(?:export\s+)?interface\s+(\w+)(?:\s+extends\s+([\w.]+))?"),
    ("python", "class", r"^\s*class\s+(\w+)(?:\(\s*([\w.]+))?"),
    ("java", "class", r"^\s*(?:public\s+|private\s+|protected\s+)?(?:abstract\s+|final\s+|static\s+)*class\s+(\w+)(?:\s+extends\s+([\w.]+))?"),
    ("java", "interface", r"^\s*(?:public\s+|private\s+|protected\s+)?interface\s+(\w+)(?:\s+extends\s+([\w.]+))?"),
    ("cpp", "class", r"^\s*(?:class|struct)\s+(\w+)(?:\s*:\s*(?:public|private|protected)?\s*([\w:]+))?\s*\{"),
    ("c", "struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)()"),
    ("go", "struct", r"^\s*type\s+(\w+)\s+struct()"),
    ("go", "interface", r"^\s*type\s+(\w+)\s+interface()"),
    ("rust", "struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)()"),
    ("rust", "enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)()"),
    ("rust", "trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)()"),
]
STEREOTYPES = ["Controller", "RestController", "Service", "Repository", "Component", "Configuration"]


def _text() -> Column:
    return F.coalesce("content", F.lit(""))


def quality_axes(files: DataFrame) -> DataFrame:
    """Four axes of each file, 100 less penalties, 0 at least, and their mean: maintainability (10 for each function of more than 50 line
    breaks, 5 where fewer than a tenth of the line breaks come with a comment), reliability (10 for raising without a try), security (15
    for each kind of dangerous call, 20 for statements that are joined together), testability (10 for more than 5 assignments)."""
    text = _text()
    breaks = lambda c: F.size(F.split(c, "\n", -1)) - 1
    functions = F.regexp_extract_all(text, F.lit(r"(?s)def\s+\w+\([^)]*\):[^}]*?(?=\ndef|\nclass|\z)"), F.lit(0))
    comments = F.regexp_count(text, F.lit("(?s)#.*|\"\"\".*?\"\"\"|'''.*?'''"))
    few = (breaks(text) > 0) & (comments / breaks(text) < 0.1)
    maintainability = 100 - 10 * F.size(F.filter(functions, lambda f: breaks(f) > 50)) - F.when(few, 5).otherwise(0)
    reliability = 100 - F.when(text.rlike(r"\braise\s+") & ~text.rlike(r"\btry\s*:"), 10).otherwise(0)
    dangerous = reduce(lambda a, b: a + b, [F.when(text.rlike(rf"\b{c}\s*\("), 15).otherwise(0) for c in DANGEROUS_CALLS])
    security = 100 - dangerous - F.when(text.rlike(r"execute\s*\([^)]*\+"), 20).otherwise(0)
    testability = 100 - F.when(F.regexp_count(text, F.lit(r"(?m)^\s*\w+\s*=")) > 5, 10).otherwise(0)
    axes = {"maintainability": maintainability, "reliability": reliability, "security": security, "testability": testability}
    out = files.select("path", *[F.greatest(F.lit(0), c).cast("double").alias(n) for n, c in axes.items()])
    return out.withColumn("overall", (F.col("maintainability") + F.col("reliability") + F.col("security") + F.col("testability")) / 4)


def risk_factors(files: DataFrame, commits: DataFrame, covered: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Factors of each file between 0 and 1, from its text, its commits (path, author, ts), and measured coverage (path, share) or else
    half for a test file (test_x, x_test.py, tests/x) and nothing without: path, complexity, test_coverage, change_frequency,
    author_experience, code_size. Without any commit of the file there are no changes and no experience."""
    full = lambda c, most: F.least(F.lit(1.0), c / float(most))
    decisions = reduce(lambda a, b: a + b, [F.regexp_count(_text(), F.lit(p)) for p in DECISIONS], F.lit(1))
    trailing = F.when(_text() == "", 0).otherwise(F.size(F.split(_text(), "\n", -1)) - F.when(_text().endswith("\n"), 1).otherwise(0))
    own = files.select("path", full(decisions, FULL_COMPLEXITY).alias("complexity"), full(trailing, FULL_LINES).alias("code_size"))
    recent = F.count(F.when(F.col("ts") >= now - F.make_dt_interval(F.lit(days)), F.lit(1)))
    done = commits.groupBy("path").agg(full(recent, FULL_CHANGES).alias("change_frequency"), full(F.count(F.lit(1)), FULL_COMMITS).alias("author_experience"))
    names = files.select("path", F.explode(F.array(F.concat(F.lit("test_"), "path"), F.regexp_replace("path", r"\.py", "_test.py"), F.concat(F.lit("tests/"), "path"))).alias("test")).filter("test <> path")
    tested = names.join(files.select(F.col("path").alias("test")), "test", "left_semi").select("path", F.lit(0.5).alias("assumed")).distinct()
    out = own.join(done, "path", "left").join(covered.select("path", "share"), "path", "left").join(tested, "path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("path", "complexity", zero(F.coalesce("share", "assumed")).alias("test_coverage"), zero(F.col("change_frequency")).alias("change_frequency"), zero(F.col("author_experience")).alias("author_experience"), "code_size")


def recommendations(factors: DataFrame, above: float = 0.7) -> DataFrame:
    """Advice on each file for its factors above a limit, in their order: path, advice."""
    each = F.array(*[F.when(F.col(n) > above, F.lit(a)) for n, a in ADVICE.items()])
    return factors.select("path", F.filter(each, lambda x: x.isNotNull()).alias("advice"))


def project_recommendations(risks: DataFrame) -> DataFrame:
    """Advice on projects of files (project, level, test_coverage): project, advice."""
    share = lambda c: F.avg(c.cast("double"))
    by = risks.groupBy("project").agg(share(F.col("level").isin("high", "critical")).alias("high"), share(F.col("test_coverage") > 0.8).alias("low"))
    each = F.array(F.when(F.col("high") > 0.2, F.lit("refactor")), F.when(F.col("low") > 0.5, F.lit("add tests first")))
    return by.select("project", F.filter(each, lambda x: x.isNotNull()).alias("advice"))


def design_hints(files: DataFrame) -> DataFrame:
    """Files that ask for a pattern: path, hint (factory: decisions on a type; singleton: shared instances)."""
    each = F.array(F.when(_text().rlike(r"if\s+.*type\s*=="), F.lit("factory")), F.when(_text().rlike("getInstance|get_instance|_instance"), F.lit("singleton")))
    return files.select("path", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("hint"))


def similarity(a: Column, b: Column, k1: float = 1.5) -> Column:
    """0.4 of the token Jaccard and 0.6 of a tenth (1 at most) of the BM25 score of `b` in an index of `a` alone; 0 without tokens. In
    an index of one text idf is ln(4/3) for every term it has, and its length is the mean length."""
    x, y = T.tokens(a), T.tokens(b)
    jaccard = T.jaccard(F.array_distinct(x), F.array_distinct(y))
    idf = F.log(F.lit(4.0 / 3.0))
    term = lambda t: F.size(F.filter(x, lambda z: z == t)).cast("double")
    bm25 = F.aggregate(F.array_intersect(y, x), F.lit(0.0), lambda s, t: s + idf * term(t) * (k1 + 1) / (term(t) + k1))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(0.4 * jaccard + 0.6 * F.least(bm25 / 10, F.lit(1.0)))


def function_ends(files: DataFrame) -> DataFrame:
    """Last line of each function by its braces: where their running sum first comes back to 0 from the line of its name on; null where
    it never does. Comments from // on don't count: path, name, line, end_line."""
    count = lambda c: F.length("code") - F.length(F.replace(F.col("code"), F.lit(c), F.lit("")))
    each = lines(K.with_language(files), "path", "content").withColumn("code", F.regexp_replace("content", "//.*$", ""))
    each = each.select("path", F.col("line").alias("at"), count("{").alias("opened"), count("}").alias("closed"))
    total = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("level", F.sum(F.col("opened") - F.col("closed")).over(total)).withColumn("seen", F.sum("opened").over(total))
    start = each.select("path", F.col("at").alias("line"), (F.col("level") - F.col("opened") + F.col("closed")).alias("low"), (F.col("seen") - F.col("opened")).alias("before"))
    known = K.functions(files).select("path", "name", "line").join(start, ["path", "line"])
    closing = each.filter("closed > 0")
    met = known.join(closing, "path").filter((F.col("at") >= F.col("line")) & (F.col("level") <= F.col("low")) & (F.col("seen") > F.col("before")))
    return known.select("path", "name", "line").join(met.groupBy("path", "name", "line").agg(F.min("at").alias("end_line")), ["path", "name", "line"], "left")


def frameworks(deps: DataFrame) -> DataFrame:
    """Frameworks that dependencies (project, source, name) stand for, by a part of their names: project, framework."""
    low = F.when(F.col("source") == "go", F.col("name")).otherwise(F.lower("name"))
    each = [F.when((F.col("source") == s) & F.contains(low, F.lit(k)), F.lit(f)) for s, table in FRAMEWORKS.items() for k, f in table.items()]
    return deps.select("project", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("framework")).distinct()


def setup_py(files: DataFrame) -> DataFrame:
    """setup.py: path, name, version, requires; empty where absent."""
    value = lambda k: F.regexp_extract(_text(), rf"{k}\s*=\s*[\"']([^\"']+)[\"']", 1)
    block = F.regexp_extract(_text(), r"install_requires\s*=\s*\[([^\]]+)\]", 1)
    return files.filter(base_name() == "setup.py").select("path", value("name").alias("name"), value("version").alias("version"), F.regexp_extract_all(block, F.lit("[\"']([^\"']+)[\"']"), F.lit(1)).alias("requires"))


def python_projects(files: DataFrame, deps: DataFrame) -> DataFrame:
    """Rollup of Python projects of files (project, path) and dependencies (project, name): project, configs, dependencies, frameworks
    and main_file, the first of the known ones at the root."""
    root = files.filter(~F.contains("path", F.lit("/")))
    configs = F.sort_array(F.collect_set(F.when(F.col("path").isin("requirements.txt", "pyproject.toml", "setup.py", "setup.cfg"), F.col("path"))))
    order = F.array_position(F.array(*[F.lit(m) for m in PYTHON_MAINS]), F.col("path"))
    by = root.groupBy("project").agg(configs.alias("configs"), F.min_by("path", F.when(order > 0, order)).alias("main_file")).filter(F.size("configs") > 0)
    names = deps.groupBy("project").agg(F.sort_array(F.collect_set("name")).alias("dependencies"))
    used = frameworks(deps.withColumn("source", F.lit("pip"))).groupBy("project").agg(F.sort_array(F.collect_set("framework")).alias("frameworks"))
    none = F.array().cast("array<string>")
    return by.join(names, "project", "left").join(used, "project", "left").select("project", "configs", F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("frameworks", none).alias("frameworks"), "main_file")


def other_pipelines(files: DataFrame) -> DataFrame:
    """Pipelines of further CI services: path, platform, jobs (of the jobs block) and stages, each in order."""
    platform = F.when(F.col("path").rlike(r"(^|/)\.circleci/config\.yml$"), "circleci").when(base_name().isin("azure-pipelines.yml", ".azure-pipelines.yml"), "azure")
    jobs = F.regexp_extract_all(F.regexp_extract(_text(), r"(?s)(?:^|\n)jobs:[ \t]*\n((?:[ \t]+[^\n]*\n?|\n)*)", 1), F.lit(r"(?m)^  ([\w-]+):"), F.lit(1))
    stages = F.regexp_extract_all(_text(), F.lit(r"(?m)^\s*-\s*stage:\s*(\S+)"), F.lit(1))
    none = F.array().cast("array<string>")
    found = files.withColumn("platform", platform).filter("platform is not null")
    return found.select("path", "platform", F.when(F.col("platform") == "circleci", jobs).otherwise(none).alias("jobs"), F.when(F.col("platform") == "azure", stages).otherwise(none).alias("stages"))


def pipeline_report(pipelines: DataFrame) -> DataFrame:
    """Of pipelines (project, platform, secrets): project, platforms, pipelines and distinct secrets."""
    each = pipelines.withColumn("row", F.monotonically_increasing_id()).select("project", "platform", "row", F.explode_outer("secrets").alias("secret"))
    return each.groupBy("project").agg(F.sort_array(F.collect_set("platform")).alias("platforms"), F.count_distinct("row").alias("pipelines"), F.count_distinct("secret").alias("secrets"))


def declarations(files: DataFrame) -> DataFrame:
    """Classes, interfaces, structures, enumerations and traits by the lines that declare them: path, lang, kind, name, base (null
    without one), line."""
    each = lines(K.with_language(files), "path", "content", ("lang",))
    found = [F.when((F.col("lang") == g) & F.col("content").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("content", p, 1).alias("name"), F.nullif(F.regexp_extract("content", p, 2), F.lit("")).alias("base"))) for g, k, p in DECLARATIONS]
    return each.select("path", "lang", F.coalesce(*found).alias("d"), "line").filter("d is not null").select("path", "lang", "d.*", "line")


def structure_totals(files: DataFrame) -> DataFrame:
    """Functions, declarations and imports of each language: lang, files, functions, declarations, imports."""
    known = K.with_language(files)
    count = lambda rows, name: rows.join(known.select("path", "lang"), "path").groupBy("lang").agg(F.count(F.lit(1)).alias(name))
    out = known.groupBy("lang").agg(F.count(F.lit(1)).alias("files"))
    for rows, name in ((K.functions(files).select("path"), "functions"), (declarations(files).select("path"), "declarations"), (K.imports(files).select("path"), "imports")):
        out = out.join(count(rows, name), "lang", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def c_facts(files: DataFrame, k: int = 20) -> DataFrame:
    """Includes and macros of C and C++ sources, distinct, in order, k at most of each: path, includes, macros."""
    of = lambda p: F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(_text(), F.lit(p), F.lit(1)))), 1, k)
    return files.filter(F.lower("path").rlike(r"\.(c|h|cc|cpp|hpp)$")).select("path", of(r'(?m)^\s*#include\s*[<"]([^>"]+)[>"]').alias("includes"), of(r"(?m)^\s*#define\s+(\w+)").alias("macros"))


def routes(files: DataFrame) -> DataFrame:
    """Web routes: decorated functions in Python, decorated methods of controllers, files below pages/api: kind, path, method, route."""
    python = F.transform(
        F.arrays_zip(F.regexp_extract_all(_text(), F.lit(r"(?i)@(?:app|router)\.(get|post|put|delete|patch)\([\"']([^\"']+)[\"']"), F.lit(1)).alias("m"), F.regexp_extract_all(_text(), F.lit(r"(?i)@(?:app|router)\.(get|post|put|delete|patch)\([\"']([^\"']+)[\"']"), F.lit(2)).alias("r")),
        lambda z: F.struct(F.lit("fastapi").alias("kind"), F.upper(z["m"]).alias("method"), z["r"].alias("route")),
    )
    nest = F.transform(
        F.arrays_zip(F.regexp_extract_all(_text(), F.lit(r"@(Get|Post|Put|Delete|Patch)\([\"']?([^\"')\s]*)"), F.lit(1)).alias("m"), F.regexp_extract_all(_text(), F.lit(r"@(Get|Post|Put|Delete|Patch)\([\"']?([^\"')\s]*)"), F.lit(2)).alias("r")),
        lambda z: F.struct(F.lit("nestjs").alias("kind"), F.upper(z["m"]).alias("method"), F.when(z["r"] == "", "/").otherwise(z["r"]).alias("route")),
    )
    below = F.regexp_replace(F.regexp_extract("path", r"^pages/api/(.*)\.[tj]s$", 1), "/index$", "")
    page = F.array(F.struct(F.lit("next-api").alias("kind"), F.lit(None).cast("string").alias("method"), F.concat(F.lit("/api/"), F.when(below == "index", "").otherwise(below)).alias("route")))
    each = F.when(F.col("path").endswith(".py"), python).when(F.col("path").endswith(".controller.ts"), nest).when(F.col("path").rlike(r"^pages/api/.*\.[tj]s$"), page)
    return files.select("path", F.explode(each).alias("r")).select("path", "r.*")


def components(files: DataFrame) -> DataFrame:
    """Named parts of user interfaces and servers: components (tsx and jsx files whose path speaks of them), Django applications
    (folders at the root with models and views), and Java classes by their stereotype: kind, name, path."""
    view = files.filter(F.col("path").rlike(r"\.[tj]sx$") & F.contains(F.lower("path"), F.lit("component"))).select(F.lit("react").alias("kind"), F.regexp_replace(base_name(), r"\.[tj]sx$", "").alias("name"), "path")
    app = files.filter(F.col("path").rlike(r"^[^/]+/(models|views)\.py$")).groupBy(F.substring_index("path", "/", 1).alias("name")).agg(F.count_distinct("path").alias("n")).filter("n = 2")
    app = app.select(F.lit("django").alias("kind"), "name", F.col("name").alias("path"))
    pattern = rf"@({'|'.join(STEREOTYPES)})\b(?:\([^)]*\))?\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:public\s+|final\s+|abstract\s+)*class\s+(\w+)"
    both = F.arrays_zip(F.regexp_extract_all(_text(), F.lit(pattern), F.lit(1)).alias("kind"), F.regexp_extract_all(_text(), F.lit(pattern), F.lit(2)).alias("name"))
    java = files.filter(F.col("path").endswith(".java")).select(F.explode(both).alias("z"), "path").select("z.kind", "z.name", "path")
    return view.unionByName(app).unionByName(java)


def repository_kinds(files: DataFrame) -> DataFrame:
    """Kind of each project by its best score, the first of equals, unknown without any: project, kind, score."""
    parts = F.split("path", "/")
    places = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    by = files.groupBy("project").agg(F.array_distinct(F.flatten(F.collect_set(places))).alias("places"), F.max(F.when(F.col("path") == "package.json", F.lower(_text()))).alias("package"))
    has = lambda x: F.array_contains("places", F.lit(x)).cast("double")
    word = lambda x: F.coalesce(F.contains("package", F.lit(x)).cast("double"), F.lit(0.0))
    scores = [F.struct(sum([*(has(f) for f in fs), *(has(d) * 0.5 for d in ds), *(word(w) * 0.5 for w in ws)], F.lit(0.0)).alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, (k, (fs, ds, ws)) in enumerate(REPOSITORY_KINDS.items())]
    best = F.array_max(F.array(*scores))
    return by.select("project", F.when(best["score"] > 0, best["kind"]).otherwise("unknown").alias("kind"), best["score"].alias("score"))


def more_interfaces(files: DataFrame) -> DataFrame:
    """Interfaces beyond AIDL and proto files: D-Bus XML, SOME/IP JSON and sockets in sources: path, protocol, interface, method."""
    bus = F.explode(F.regexp_extract_all(_text(), F.lit(r'(?s)<interface\s+name="[^"]+">.*?</interface>'), F.lit(0)))
    dbus = files.filter(F.col("path").endswith(".xml")).select("path", bus.alias("b"))
    dbus = dbus.select("path", F.lit("dbus").alias("protocol"), F.regexp_extract("b", r'<interface\s+name="([^"]+)"', 1).alias("interface"), F.explode(F.regexp_extract_all("b", F.lit(r'<method\s+name="([^"]+)"'), F.lit(1))).alias("method"))
    schema = "services array<struct<name: string, methods: array<struct<name: string>>, events: array<struct<name: string>>>>"
    someip = files.filter(F.lower("path").rlike(r"someip.*\.json$")).select("path", F.explode(F.from_json("content", schema)["services"]).alias("s"))
    none = F.array().cast("array<string>")
    named = F.concat(F.coalesce(F.col("s.methods.name"), none), F.coalesce(F.transform(F.col("s.events.name"), lambda e: F.concat(F.lit("event:"), e)), none))
    someip = someip.select("path", F.lit("someip").alias("protocol"), F.coalesce("s.name", F.lit("unknown")).alias("interface"), F.explode(named).alias("method"))
    sources = files.filter(F.col("path").rlike(r"\.(c|cc|cpp|java|kt|py)$"))
    found = [("unix_socket", r"(?i)unix\s*socket.*?(\S+\.sock)"), ("tcp_socket", r"(?i)(?:connect|bind)\s*\([^,]+,\s*\"([^\"]+)\"")]
    sockets = [sources.select("path", F.lit(p).alias("protocol"), F.explode(F.array_distinct(F.regexp_extract_all(_text(), F.lit(x), F.lit(1)))).alias("s")) for p, x in found]
    socket = sockets[0].unionByName(sockets[1])
    stem = F.regexp_replace(F.regexp_extract("s", r"([^/]+)$", 1), r"(.)\.[^.]*$", "$1")
    socket = socket.select("path", "protocol", stem.alias("interface"), F.explode(F.array(*[F.lit(m) for m in ("connect", "send", "receive")])).alias("method"))
    return dbus.unionByName(someip).unionByName(socket)


def interface_document(interfaces: DataFrame, k: int = 10) -> DataFrame:
    """A section of text for each interface (path, protocol, interface, method), with its first k methods: interface, text."""
    by = interfaces.groupBy("interface", "protocol", "path").agg(F.sort_array(F.collect_set("method")).alias("m"))
    listed = F.array_join(F.transform(F.slice("m", 1, k), lambda x: F.concat(F.lit("- `"), x, F.lit("`"))), "\n")
    more = F.when(F.size("m") > k, F.concat(F.lit("\n- ... ("), F.size("m").cast("string"), F.lit(" in all)"))).otherwise("")
    return by.select("interface", F.concat(F.lit("### "), "interface", F.lit("\n\n- protocol: "), "protocol", F.lit("\n- file: `"), "path", F.lit("`\n- methods: "), F.size("m").cast("string"), F.lit("\n\n"), listed, more).alias("text"))


def issue_references(files: DataFrame) -> DataFrame:
    """Issues that files speak of: path, issue (#12, Issue 12, ABC-12, or the number of a link), each once."""
    found = F.concat(*[F.regexp_extract_all(_text(), F.lit(p), F.lit(1)) for p in (r"#(\d+)", r"Issue[:\s]+#?(\d+)", r"([A-Z]+-\d+)", r"https://[^/\s]+/[^/\s]+/[^/\s]+/(?:-/)?issues/(\d+)")])
    return files.select("path", F.explode(F.array_distinct(found)).alias("issue"))
