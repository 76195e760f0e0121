"""What a project is: types by rules, platform, entry points, configuration, subsystems, processes, protocols, size.

Files are (project, path, content) with paths relative to the project; folders are those on the paths of files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.sources.files import base_name, folders

# Project types (patterns, type, language, priority, build system). '*.x' is a suffix; others are paths of files or
# folders, or, if they are among CONTENT_WORDS, words of content.
TYPE_RULES = [
    ([".repo/manifest.xml", "device/"], "aosp", "java", 200, "soong"),
    ([".repo/manifest.xml", "vendor/"], "android-vendor-sdk", "c", 200, "make"),
    ([".repo/manifest.xml", "frameworks/"], "aosp", "java", 200, "soong"),
    ([".repo/manifest.xml", "project/"], "chip-sdk", "c", 195, "make"),
    ([".repo/manifest.xml", "sdk/"], "chip-sdk", "c", 195, "make"),
    ([".repo/manifest.xml", "bsp/"], "chip-sdk", "c", 195, "make"),
    ([".repo/manifest.xml", "freertos"], "freertos-sdk", "c", 190, "make"),
    ([".repo/manifest.xml", "rt-thread"], "rtthread-sdk", "c", 190, "scons"),
    ([".repo/manifest.xml", "zephyr"], "zephyr-sdk", "c", 190, "cmake"),
    ([".repo/manifest.xml"], "repo-mono", "multi", 180, "repo"),
    (["AndroidManifest.xml"], "android-app", "kotlin", 100, "gradle"),
    (["build.gradle", "app/src/main"], "android-app", "kotlin", 90, "gradle"),
    (["build.gradle.kts", "app/src/main"], "android-app", "kotlin", 90, "gradle"),
    (["Android.mk", "jni"], "android-ndk", "c", 80, "ndk-build"),
    (["Android.bp"], "aosp", "java", 85, "soong"),
    (["frameworks", "system", "hardware"], "aosp", "java", 70, "soong"),
    (["*.xcodeproj"], "ios", "swift", 100, "xcode"),
    (["*.xcworkspace"], "ios", "swift", 100, "xcode"),
    (["Podfile"], "ios", "swift", 85, "cocoapods"),
    (["Package.swift"], "swift", "swift", 80, "spm"),
    (["*.ioc"], "stm32", "c", 95, "stm32cubeide"),
    (["*.uvprojx", "*.uvproj"], "keil", "c", 95, "keil"),
    (["*.ewp"], "iar", "c", 95, "iar"),
    (["platformio.ini"], "platformio", "c", 90, "platformio"),
    (["pico_sdk_import.cmake"], "pico", "c", 90, "cmake"),
    (["sdkconfig", "CMakeLists.txt"], "esp32", "c", 85, "cmake"),
    (["FreeRTOSConfig.h"], "freertos", "c", 90, "make"),
    (["Kconfig", "CMakeLists.txt", "zephyr"], "zephyr", "c", 85, "cmake"),
    (["rtconfig.h"], "rt-thread", "c", 90, "scons"),
    (["defconfig", "Kbuild"], "embedded-linux", "c", 80, "make"),
    (["*.dts", "*.dtsi"], "embedded-linux", "dts", 75, "dtc"),
    (["Buildroot", "Config.in"], "buildroot", "make", 85, "make"),
    (["meta-", "recipes-"], "yocto", "python", 85, "bitbake"),
    (["poky", "bitbake"], "yocto", "python", 80, "bitbake"),
    (["feeds.conf", "openwrt"], "openwrt", "c", 80, "make"),
    (["QNX_TARGET"], "qnx", "c", 90, "make"),
    (["*.build", "startup-"], "qnx", "c", 75, "make"),
    (["package.json", "src/index.tsx"], "react", "typescript", 85, "npm"),
    (["package.json", "src/main.tsx"], "react", "typescript", 85, "npm"),
    (["nuxt.config.js"], "nuxt", "javascript", 90, "npm"),
    (["nuxt.config.ts"], "nuxt", "typescript", 90, "npm"),
    (["next.config.js"], "nextjs", "javascript", 90, "npm"),
    (["next.config.ts"], "nextjs", "typescript", 90, "npm"),
    (["vue.config.js"], "vue", "javascript", 90, "npm"),
    (["angular.json"], "angular", "typescript", 95, "npm"),
    (["svelte.config.js"], "svelte", "javascript", 90, "npm"),
    (["manage.py", "settings.py"], "django", "python", 95, "pip"),
    (["main.py", "requirements.txt", "fastapi"], "fastapi", "python", 80, "pip"),
    (["app.py", "requirements.txt"], "flask", "python", 80, "pip"),
    (["pom.xml"], "maven", "java", 95, "maven"),
    (["build.gradle", "src/main/java"], "gradle-java", "java", 90, "gradle"),
    (["go.mod"], "go", "go", 95, "go-mod"),
    (["Cargo.toml"], "rust", "rust", 95, "cargo"),
    (["*.pro"], "qt", "cpp", 85, "qmake"),
    (["package.json", "electron"], "electron", "javascript", 80, "npm"),
    (["pubspec.yaml", "lib/main.dart"], "flutter", "dart", 95, "flutter"),
    (["CMakeLists.txt"], "cmake", "cpp", 70, "cmake"),
    (["Makefile"], "makefile", "c", 70, "make"),
    (["meson.build"], "meson", "c", 80, "meson"),
    (["BUILD", "WORKSPACE"], "bazel", "java", 90, "bazel"),
    (["requirements.txt", "torch"], "pytorch", "python", 75, "pip"),
    (["requirements.txt", "tensorflow"], "tensorflow", "python", 75, "pip"),
    (["*.ipynb"], "jupyter", "python", 70, "pip"),
    (["Assets", "ProjectSettings"], "unity", "csharp", 95, "unity"),
    (["*.uproject", "Source"], "unreal", "cpp", 95, "unreal"),
    (["project.godot"], "godot", "gdscript", 95, "godot"),
]
CONTENT_WORDS = ["fastapi", "torch", "tensorflow", "electron", "zephyr", "rtthread"]
CONTENT_SUFFIXES = [".py", ".js", ".ts", ".json", ".h", ".c", ".cpp", ".md"]
PLATFORMS = {
    "android-app": "android", "android-ndk": "android", "ios": "ios", "flutter": "cross-platform", "react-native": "cross-platform",
    "stm32": "embedded", "esp32": "embedded", "pico": "embedded", "keil": "embedded", "iar": "embedded", "freertos": "embedded", "zephyr": "embedded",
    "rt-thread": "embedded", "embedded-linux": "embedded", "buildroot": "embedded", "yocto": "embedded", "qnx": "embedded", "aosp": "embedded",
    "react": "web", "vue": "web", "angular": "web", "svelte": "web", "nextjs": "web", "nuxt": "web", "django": "web", "fastapi": "web", "flask": "web",
    "electron": "desktop", "qt": "desktop", "cmake": "native", "makefile": "native", "go": "cross-platform", "rust": "cross-platform",
}
ENTRY_NAMES = [
    "main.c", "main.cpp", "main.py", "main.go", "main.rs", "Main.kt", "MainActivity.kt", "MainActivity.java", "index.js", "index.ts", "main.tsx", "index.tsx",
    "app.py", "run.py", "__main__.py", "Program.cs", "main.dart", "app_main.c", "app_main.cpp", "main_task.c", "main_loop.c", "application_main.c",
    "server.js", "server.ts", "app.js", "app.ts", "index.php", "index.rb", "Application.java", "Application.kt", "AppDelegate.swift", "AppDelegate.m", "main.m", "main.swift",
]
CONFIG_NAMES = [
    "AndroidManifest.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "CMakeLists.txt", "Makefile", "package.json", "package-lock.json",
    "Cargo.toml", "Cargo.lock", "go.mod", "go.sum", "pom.xml", "requirements.txt", "pyproject.toml", "poetry.lock", "Android.mk", "Android.bp", "Application.mk",
    "sdkconfig", "Kconfig", "defconfig", ".config", "pubspec.yaml", "pubspec.lock", "Podfile", "Podfile.lock", "Gemfile", "Gemfile.lock", "composer.json", "composer.lock",
    "vite.config.js", "vite.config.ts", "webpack.config.js", "tsconfig.json", ".eslintrc.js", ".eslintrc.json", ".prettierrc", ".prettierrc.json",
    "tailwind.config.js", "tailwind.config.ts", "next.config.js", "next.config.ts", "nuxt.config.js", "nuxt.config.ts", "vue.config.js", "angular.json",
]
CONFIG_SUFFIXES = [".ioc", ".dts", ".dtsi", ".uvprojx", ".ewp", ".pro"]
SUBSYSTEMS = ["vehicle", "infotainment", "adas", "cluster", "tbox", "hud", "ivi", "autonomous", "frameworks", "system", "hardware", "packages", "services", "apps", "core", "common"]
PROCESS_PATHS = ["AndroidManifest.xml", ".aidl", "system/", "frameworks/", "vehicle/", "infotainment/", "adas/"]
PROCESS_MAINS = ["main.cpp", "main.c", "main.py", "main.go", "main.rs"]
PROTOCOL_PARTS = {".aidl": "binder", ".hal": "hwbinder", ".proto": "grpc", "dbus": "dbus", "someip": "someip", "vsomeip": "someip", "commonapi": "someip", "binder": "binder", "socket": "socket", "grpc": "grpc"}


def _places(files: DataFrame) -> DataFrame:
    """Paths of files and of the folders above them: project, place."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.select("project", F.explode(prefixes).alias("place")).distinct()


def detect_types(files: DataFrame, k: int = 3, least: float = 0.5) -> DataFrame:
    """Types of each project: 1 for a suffix, 1.5 for a path, 0.5 for a word of content; times (1 + priority / 100) and the share of
    patterns matched (a word counts half). Each type counts by its best rule; the k best of at least `least`: project, type,
    language, build_system, score, rank. Rules are a fixed table and are sent to all executors."""
    rows = [(i, t, lang, p, b, len(ps), x, x.removeprefix("*")) for i, (ps, t, lang, p, b) in enumerate(TYPE_RULES) for x in ps]
    rules = files.sparkSession.createDataFrame(rows, "rule int, type string, language string, priority int, build_system string, n int, pattern string, value string")
    suffix, word = F.col("pattern").startswith("*."), F.col("pattern").isin(CONTENT_WORDS)
    names = files.select("project", F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("value")).distinct()
    by_suffix = names.join(F.broadcast(rules.filter(suffix)), "value").select("project", "rule", "pattern", F.lit(1.0).alias("s"), F.lit(1.0).alias("m"))
    exact = _places(files).join(F.broadcast(rules.filter(~suffix)), F.col("place") == F.col("value")).select("project", "rule", "pattern", F.lit(1.5).alias("s"), F.lit(1.0).alias("m"))
    readable = files.filter(reduce(lambda a, b: a | b, [F.col("path").endswith(x) for x in CONTENT_SUFFIXES]))
    held = F.filter(F.array(*[F.when(F.contains(F.lower("content"), F.lit(w)), F.lit(w)) for w in CONTENT_WORDS]), lambda x: x.isNotNull())
    words = readable.select("project", F.explode(held).alias("value")).distinct()
    by_word = words.join(F.broadcast(rules.filter(word)), "value").select("project", "rule", "pattern", F.lit(0.5).alias("s"), F.lit(0.5).alias("m"))
    hits = by_suffix.unionByName(exact).unionByName(by_word).groupBy("project", "rule", "pattern").agg(F.max("s").alias("s"), F.max("m").alias("m"))
    scored = hits.groupBy("project", "rule").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
    scored = scored.join(F.broadcast(rules.select("rule", "type", "language", "priority", "build_system", "n").distinct()), "rule")
    scored = scored.withColumn("score", F.round(F.col("s") * (1 + F.col("priority") / 100.0) * (F.col("m") / F.col("n")), 6)).filter(F.col("score") >= least)
    best = scored.groupBy("project", "type").agg(F.max(F.struct("score", (-F.col("rule")).alias("order"), "language", "build_system")).alias("b")).select("project", "type", "b.*")
    w = Window.partitionBy("project").orderBy(F.desc("score"), F.desc("order"))
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("project", "type", "language", "build_system", "score", "rank")


def platforms(types: DataFrame) -> DataFrame:
    """Platform of each project by its first type (project, type, rank) that has one, else unknown."""
    table = F.create_map(*[F.lit(x) for pair in PLATFORMS.items() for x in pair])
    known = types.withColumn("platform", F.try_element_at(table, F.col("type")))
    first = F.min_by("platform", F.when(F.col("platform").isNotNull(), F.col("rank")))
    return known.groupBy("project").agg(F.coalesce(first, F.lit("unknown")).alias("platform"))


def entry_points(files: DataFrame) -> DataFrame:
    """Files with a known entry name, in the order of the names: project, path, rank (from 1)."""
    rank = F.array_position(F.array(*[F.lit(n) for n in ENTRY_NAMES]), base_name())
    return files.select("project", "path", rank.alias("rank")).filter("rank > 0")


def config_files(files: DataFrame, k: int = 20, preview: int = 500) -> DataFrame:
    """The first k configuration files of each project, those with known names at its root first: project, path, size, preview."""
    suffix = F.coalesce(*[F.when(F.col("path").endswith(x), F.lit(len(CONFIG_NAMES) + 1 + i)) for i, x in enumerate(CONFIG_SUFFIXES)])
    named = F.array_position(F.array(*[F.lit(n) for n in CONFIG_NAMES]), F.col("path"))
    known = files.withColumn("order", F.coalesce(F.nullif(named.cast("int"), F.lit(0)), suffix)).filter("order is not null")
    w = Window.partitionBy("project").orderBy("order", "path")
    out = known.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return out.select("project", "path", F.octet_length("content").cast("long").alias("size"), F.substring("content", 1, preview).alias("preview"))


def subsystems(files: DataFrame, k: int = 10) -> DataFrame:
    """Known subsystem names among the folders of each project, in alphabetical order, k at most: project, subsystem."""
    each = _places(files).join(files.select("project", F.col("path").alias("place")), ["project", "place"], "left_anti")
    found = each.select("project", F.lower(base_name("place")).alias("subsystem")).filter(F.col("subsystem").isin(SUBSYSTEMS)).distinct()
    w = Window.partitionBy("project").orderBy("subsystem")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def process_names(files: DataFrame) -> DataFrame:
    """Folders that hold a main file, by their own names: project, process."""
    parts = F.split("path", "/")
    return files.filter((F.size(parts) > 1) & F.lower(base_name()).isin(PROCESS_MAINS)).select("project", F.element_at(parts, -2).alias("process")).distinct()


def protocols(files: DataFrame) -> DataFrame:
    """Protocols between processes that parts of paths speak of: project, protocol."""
    held = F.filter(F.array(*[F.when(F.contains(F.lower("path"), F.lit(p)), F.lit(n)) for p, n in PROTOCOL_PARTS.items()]), lambda x: x.isNotNull())
    return files.select("project", F.explode(held).alias("protocol")).distinct()


def several_processes(project_path: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(project_path, F.lit(x)) for x in PROCESS_PATHS])


def scale(files: DataFrame) -> DataFrame:
    """Size class of each project: large above 5000 files or 500 folders or with several processes (an indicator in a path, or more
    than three files whose path holds 'main.'), medium above 500 files or 50 folders: project, files, folders, multi, scale."""
    mains = F.sum(F.contains(F.lower("path"), F.lit("main.")).cast("int"))
    by = files.groupBy("project").agg(F.count(F.lit(1)).alias("files"), (F.max(several_processes(F.col("path"))) | (mains > 3)).alias("multi"))
    below = folders(files.select(F.concat("project", F.lit("/"), "path").alias("path"))).filter("folder like '%/%'")
    count = below.groupBy(F.substring_index("folder", "/", 1).alias("project")).agg(F.count(F.lit(1)).alias("folders"))
    out = by.join(count, "project", "left").withColumn("folders", F.coalesce("folders", F.lit(0)))
    size = F.when((F.col("files") > 5000) | (F.col("folders") > 500) | F.col("multi"), "large").when((F.col("files") > 500) | (F.col("folders") > 50), "medium").otherwise("small")
    return out.select("project", "files", "folders", "multi", size.alias("scale"))
