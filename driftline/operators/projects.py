"""Projects in a tree of files: where they begin, and what their files say about them.

Everything is a join on folders or an aggregate by project. A file belongs to every project above it, so it meets the projects'
folders through its own ancestors. Lists are cut to their first entries by rank, which Spark does before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.tables import cut

# Folders that are not looked into, how deep a project is read, and how long its lists are.
SKIPPED = ("node_modules", ".git", ".idea", ".vscode", ".trae", ".venv", ".workbuddy", "target", "output", "dist", "build", "logs", "tmp", "temp", "screenshots", "reports", "test-reports", "testreports", "archives", "defects", "delivery")
DEPTH = 12
MOST = {"modules": 40, "dependencies": 60, "entry_points": 20, "configs": 20, "conventions": 10}
# Build systems by the files at a project's root, in order, and what trees without one are called.
SYSTEMS = (("Maven", ("pom.xml",)), ("Gradle", ("build.gradle", "build.gradle.kts")), ("npm", ("package.json",)), ("Go", ("go.mod",)), ("Python", ("requirements.txt", "pyproject.toml")), ("Rust", ("Cargo.toml",)))
WAR, JAR, BYTECODE, SOURCES = "Java Web 部署包（WAR 解包）", "Java 应用产物（JAR 解包）", "Java 字节码产物（非标准布局）", "Java 源码工程（非标准布局）"
# Files that make a folder a project by themselves, and one that a module has.
OWN = ("package.json", "go.mod", "Cargo.toml", "requirements.txt", "pyproject.toml")
BUILD = ("pom.xml", "build.gradle", "build.gradle.kts", "package.json")
# Patterns of modules and dependencies.
MODULE, ARTIFACT, PACKAGING = r"<module>([^<]+)</module>", r"<artifactId>([^<]+)</artifactId>", r"<packaging>([^<]+)</packaging>"
INCLUDE = r"include\s*\(?\s*['\"]([^'\"]+)['\"]"
GRADLE_DEPENDENCY = r"(?:implementation|api|compileOnly|testImplementation|runtimeOnly)\s*\(?\s*['\"]([^'\"]+)['\"]"
NPM_DEPENDENCY = r'"([a-zA-Z0-9@/_\-.]+)"\s*:\s*"[^}]"'
# Techniques by what a dependency's name holds, the first that fits.
STACK = (("spring", "Spring"), ("mybatis", "MyBatis"), ("rocketmq", "消息队列"), ("kafka", "消息队列"), ("redis", "Redis"), ("react", "前端框架"), ("vue", "前端框架"), ("hibernate", "Hibernate"))


def looked_at(files: DataFrame) -> DataFrame:
    """files (path, ...) outside skipped and hidden folders."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    return files.where(~F.exists(folders, lambda d: d.isin(*SKIPPED) | F.contains(d, F.lit("@tmp")) | d.startswith(".")))


def _all(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1), lambda x: F.trim(x))


def _folders_above(folder: Column) -> Column:
    """A folder's ancestors, the root '' among them, not itself."""
    return F.when(folder == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("")), paths.ancestors(folder)))


def roots(files: DataFrame) -> DataFrame:
    """(root) of the projects of a tree (path, text): folders whose file says so, aggregating builds, and builds that the nearest one above does not name as a module; the tree itself where there is none."""
    own = looked_at(files).select("path", "text", paths.file_name(F.col("path")).alias("name"), paths.parent(F.col("path")).alias("dir"))
    poms = own.where("name = 'pom.xml'").select("dir", _all(F.col("text"), MODULE).alias("modules"), F.get(_all(F.col("text"), PACKAGING), F.lit(0)).alias("packaging"))
    above = poms.select(F.col("dir").alias("of"), F.explode(_folders_above(F.col("dir"))).alias("up")).join(poms.select(F.col("dir").alias("up"), "modules"), "up")
    nearest = above.groupBy("of").agg(F.max_by("modules", F.struct(F.length("up"), "up")).alias("named"))
    builds = poms.join(nearest, F.col("dir") == F.col("of"), "left")
    whole = (F.col("packaging") == "pom") & (F.size("modules") > 0)
    alone = ~F.coalesce(F.array_contains("named", paths.file_name(F.col("dir"))), F.lit(False))
    found = builds.where(F.coalesce(whole, F.lit(False)) | alone).select(F.col("dir").alias("root")).union(own.where(F.col("name").isin(*OWN)).select("dir")).distinct()
    none = found.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("").alias("root"))
    return found.union(none)


def _first(rows: DataFrame, value: str, order: list, k: int, name: str) -> DataFrame:
    """(root, name): each root's first k different values in order, as a list."""
    distinct = rows.groupBy("root", value).agg(F.min(F.struct(*order)).alias("o"))
    ranked = distinct.withColumn("n", F.row_number().over(W.partitionBy("root").orderBy("o", value))).where(F.col("n") <= k)
    return ranked.groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", value))), lambda x: x[value]).alias(name))


def contexts(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(root, build_system, modules, dependencies, entry_points, configs, tech_stack, conventions, summary) of projects (root) in a tree (path, text). text may be null for files that no list reads. Every file of a project counts, not only the first thousands."""
    own = looked_at(files).select("path", "text", F.explode(F.concat(_folders_above(paths.parent(F.col("path"))), F.array(paths.parent(F.col("path"))))).alias("root"))
    own = own.join(projects.select("root"), "root").withColumn("rel", F.when(F.col("root") == "", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)")))
    own = own.where(paths.depth(F.col("rel")) < DEPTH).select("root", "rel", "text", paths.file_name(F.col("rel")).alias("name"), F.concat(F.lit("/"), "rel").alias("p"))
    here = lambda *names: F.coalesce(F.bool_or(F.col("rel").isin(*names)), F.lit(False))
    system = None
    for label, names in SYSTEMS:
        system = F.when(here(*names), label) if system is None else system.when(here(*names), label)
    p, name = F.col("p"), F.col("name")
    library = F.contains(p, F.lit("/WEB-INF/lib/")) & p.endswith(".jar")
    manifest = p.endswith("/META-INF/MANIFEST.MF") | p.endswith("/META-INF/MANIFEST.xml")
    system = (system.when(F.bool_or(F.contains(p, F.lit("/WEB-INF/"))), WAR).when(F.bool_or(manifest), JAR)
              .when(F.bool_or(p.endswith(".class")), BYTECODE).when(F.bool_or(p.endswith(".java")), SOURCES).otherwise("none"))
    package = F.when(F.contains(p, F.lit("/src/main/java/")), F.split(paths.parent(F.substring_index(p, "/src/main/java/", -1)), "/"))
    package = F.when(F.get(package, F.lit(0)) != "", package)
    count = lambda *ends: F.count_if(name.rlike("(" + "|".join(ends) + r")\.java$"))
    pick = lambda key: F.nullif(F.trim(F.regexp_extract("text", rf"(?m)^[ \t]*{key}:([^\n]*)$", 1)), F.lit(""))
    titled = F.when(manifest, F.struct("rel", pick("Implementation-Title").alias("title"), pick("Implementation-Version").alias("version")))
    low, low_p = F.lower(name), F.lower(p)
    main = name.rlike(r"(?i)(application|app|main|bootstrap|starter|launcher)\.java$")
    page = ~name.endswith(".java") & (name.isin("index.html", "main.js", "main.ts") | name.endswith("App.jsx") | name.endswith("App.vue"))
    config = low.isin("application.yml", "application.properties", "application.yaml", "config.json", ".env.example") | low.endswith(".conf") | low.rlike(r"(?s)^application-.*\.(yml|yaml|properties)$")
    deployed = low_p.rlike(r"/(meta-inf/manifest\.mf|meta-inf/manifest\.xml|web-inf/web\.xml|deploy\.xml)$") | (F.contains(low_p, F.lit("/web-inf/classes/")) & low_p.endswith(".properties"))
    read = name.isin(*BUILD, "settings.gradle") | main  # files whose text some list needs
    shown = library | page | config | deployed
    facts = own.groupBy("root").agg(
        system.alias("build_system"), F.count_if(library).alias("libraries"), F.min(titled).alias("manifest"), F.min(package).alias("low"), F.max(package).alias("high"), F.max(F.size(package)).alias("deepest"),
        count("Mapper", "Dao").alias("mappers"), count("Service").alias("services"), count("Controller", "Resource").alias("controllers"))
    facts = cut(facts)
    typed = own.where(read | shown).join(facts.select(F.col("root").alias("r"), "build_system"), F.col("root") == F.col("r")).drop("r")
    typed = cut(typed.withColumn("text", F.when(read, F.col("text"))))
    bs, rel = F.col("build_system"), F.col("rel")
    odd = bs.isin(WAR, JAR, BYTECODE, SOURCES)

    def each(when: Column, pattern: str) -> DataFrame:
        return typed.where(when).select("root", "rel", F.posexplode(_all(F.col("text"), pattern)).alias("at", "v"))

    settings = typed.where("build_system = 'Gradle' AND rel IN ('settings.gradle', 'build.gradle.kts')").groupBy("root").agg(F.max_by("text", "rel").alias("text"), F.max("rel").alias("rel"))
    gradle = settings.select("root", "rel", F.posexplode(_all(F.col("text"), INCLUDE)).alias("at", "v")).withColumn("v", F.replace("v", F.lit(":"), F.lit("/")))
    named = each((bs == "Maven") & (rel == "pom.xml"), MODULE).unionByName(gradle)
    below = typed.where(name.isin(*BUILD) & F.contains(rel, F.lit("/"))).select("root", "rel", F.lit(0).alias("at"), paths.parent(rel).alias("v"))
    # Folders of build files stand in where no build names modules.
    modules = named.withColumn("late", F.lit(0)).unionByName(below.withColumn("late", F.lit(1)))
    modules = modules.withColumn("early", F.min("late").over(W.partitionBy("root"))).where("late = early")
    modules = _first(modules, "v", ["rel", "at"], MOST["modules"], "modules")
    wanted = each((bs == "Maven") & (rel == "pom.xml"), ARTIFACT).unionByName(each((bs == "Gradle") & rel.isin("build.gradle", "build.gradle.kts"), GRADLE_DEPENDENCY)).unionByName(each((bs == "npm") & (rel == "package.json"), NPM_DEPENDENCY))
    wanted = wanted.unionByName(typed.where(odd & library).select("root", "rel", F.lit(0).alias("at"), F.expr("substring(name, 1, length(name) - 4)").alias("v")))
    dependencies = _first(wanted, "v", ["rel", "at"], MOST["dependencies"], "dependencies")
    entry = _first(typed.where((main & F.contains(F.col("text"), F.lit("public static void main"))) | page), "rel", ["rel"], MOST["entry_points"], "entry_points")
    configs = _first(typed.where(config | (odd & deployed)).select("root", "rel", F.when(config, 0).otherwise(1).alias("late")), "rel", ["late", "rel"], MOST["configs"], "configs")
    found = facts
    for more in (modules, dependencies, entry, configs):
        found = found.join(more.withColumnRenamed("root", "of"), F.col("root") == F.col("of"), "left").drop("of")
    none = F.array().cast("array<string>")
    found = found.withColumns({c: F.coalesce(c, none) for c in ("modules", "dependencies", "entry_points", "configs")})
    technique = lambda d: F.coalesce(*[F.when(F.contains(F.lower(d), F.lit(word)), F.lit(label)) for word, label in STACK])
    stack = F.array_distinct(F.concat(F.array("build_system"), F.array_compact(F.transform("dependencies", technique))))
    shared = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.greatest(F.size("low"), F.lit(1)) - 1), lambda i: ~F.get("low", i).eqNullSafe(F.get("high", i)))), F.size("low"))
    root = F.when(shared == 0, "(默认包/无层级)").otherwise(F.array_join(F.slice("low", F.lit(1), shared), "."))
    m = F.col("manifest")
    conventions = F.array_compact(F.array(
        F.when(odd & (F.col("libraries") > 0), F.concat(F.lit("WEB-INF/lib 依赖库 "), "libraries", F.lit(" 个"))),
        F.when(odd & (m["title"].isNotNull() | m["version"].isNotNull()), F.concat(F.lit("部署包标识："), F.coalesce(m["title"], F.lit("")), F.coalesce(F.concat(F.lit(" v"), m["version"]), F.lit("")))),
        F.when(F.col("low").isNotNull(), F.concat(F.lit("Java 包根："), root, F.lit("（公共 "), shared, F.lit(" 级 / 最深 "), "deepest", F.lit(" 级）"))),
        *[F.when(F.col(c) > 0, F.concat(F.lit(f"{text}（"), c, F.lit(" 个）"))) for c, text in (("mappers", "持久层命名 *Mapper/*Dao"), ("services", "服务层命名 *Service"), ("controllers", "接口/控制层命名 *Controller/*Resource"))]))
    found = found.withColumns({"tech_stack": stack, "conventions": F.slice(conventions, 1, MOST["conventions"])})
    listed = lambda c, mark: F.array_join(c, mark)
    conv = F.size("conventions") > 0
    summary = (F.when((bs == "none") & (F.size("modules") == 0), "未识别到标准构建系统，仅基于目录结构推断；架构分层信息有限，请谨慎参考。")
               .when(odd, F.concat(F.lit("未识别到标准构建系统，按目录特征推断为 "), bs, F.when(conv, F.concat(F.lit("（"), listed("conventions", "；"), F.lit("）"))).otherwise(""), F.lit("；无标准源码工程结构，架构分层信息有限，请谨慎参考。")))
               .otherwise(F.concat(F.when(F.size("modules") > 0, F.concat(F.lit("多模块工程（"), bs, F.lit("），模块含 "), listed("modules", "、"), F.lit("；"))).otherwise(F.concat(F.lit("单模块工程（"), bs, F.lit("）；"))),
                                   F.when(F.size("entry_points") > 0, F.concat(F.lit("入口/主类："), listed("entry_points", "、"), F.lit("；"))).otherwise(""), F.when(conv, F.concat(F.lit("约定："), listed("conventions", "；"), F.lit("。"))).otherwise(""))))
    return found.select("root", "build_system", "modules", "dependencies", "entry_points", "configs", "tech_stack", "conventions", summary.alias("summary"))
