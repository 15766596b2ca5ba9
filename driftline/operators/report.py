"""What a comparison hands on: nodes, exports, tables of reports, routes and facts about projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels, paths
from ..functions.text import human_size, shown_time
from ..sources.tables import cut

# Labels and headings of reports.
STATUS_LABELS = {"ADDED": "新增 +", "DELETED": "删除 -", "MODIFIED": "修改 ~", "UNCHANGED": "未变 ="}
REPORT, PLAIN_TITLE = "报告", "AI 智能分析报告"
FOLDER_ROWS = (("仅左侧存在 (LEFT_ONLY)", "left_only"), ("仅右侧存在 (RIGHT_ONLY)", "right_only"), ("两侧不同 (MODIFIED)", "modified"), ("  ├ 内容不同", "content_changed"),
               ("  └ 仅属性不同", "attr_only_changed"), ("完全相同 (SAME)", "same"), ("类型冲突 (TYPE_MISMATCH)", "type_mismatch"))
SCANNED = "扫描文件 / 目录"
# Files at a project's root and the build system that they belong to, in the order in which they are tried.
BUILD_FILES = (("Maven", ("pom.xml",)), ("Gradle", ("build.gradle", "build.gradle.kts")), ("npm", ("package.json",)), ("Go", ("go.mod",)), ("Python", ("requirements.txt", "pyproject.toml")), ("Rust", ("Cargo.toml",)))


def nodes(diff: DataFrame) -> DataFrame:
    """(key, node): each entry of a diff in JSON; what is null is left out."""
    node = F.struct("key", paths.file_name(F.col("key")).alias("name"), "status", F.col("file_class").alias("fileClass"), F.col("old_size").alias("oldSize"), F.col("new_size").alias("newSize"))
    return diff.select("key", F.to_json(node).alias("node"))


def exit_code(changes: Column, error: Column) -> Column:
    """2 where a side could not be read, 1 where something changed, else 0."""
    return F.when(error.isNotNull(), 2).when(changes > 0, 1).otherwise(0)


def class_files(diff: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, content) of an export of changed classes: the class, from the old side if it is gone, and a file beside it that names its status. Keys that could leave the folder raise."""
    changed = diff.where((F.col("status") != "UNCHANGED") & (F.col("file_class") == "CLASS")).select(
        F.when(paths.is_unsafe(F.col("key")), F.raise_error(F.concat(F.lit("a key leaves its folder: "), "key"))).otherwise(F.col("key")).alias("key"), "status")
    own = lambda side, wanted: side.select("key", "text").join(wanted, "key")
    files = own(new, changed.where("status <> 'DELETED'")).unionByName(own(old, changed.where("status = 'DELETED'")))
    name = paths.file_name(F.col("key"))
    mark = F.concat(F.substring("key", F.lit(1), F.length("key") - F.length(name)), F.lit("."), "status", F.lit("."), name)
    return files.select(F.col("key").alias("path"), F.coalesce("text", F.lit("")).alias("content")).unionByName(changed.select(mark.alias("path"), F.concat_ws(" ", "status", "key").alias("content")))


def load_rows(lines: DataFrame) -> DataFrame:
    """(label, elapsed, ts, ok) of a load test's lines: time, duration, label, success."""
    r = F.from_csv("line", F.lit("ts STRING, elapsed STRING, label STRING, success STRING"), {"mode": "PERMISSIVE"})
    number = lambda c: F.expr(f"try_cast(r.{c} AS BIGINT)")
    own = lines.select(r.alias("r")).select(F.coalesce(F.nullif("r.label", F.lit("")), F.lit("ALL")).alias("label"), number("elapsed").alias("elapsed"), F.coalesce(number("ts"), F.lit(0)).alias("ts"), (F.lower(F.coalesce("r.success", F.lit("true"))) == "true").alias("ok"))
    return own.where("elapsed IS NOT NULL")


def load_xml(spark: SparkSession, path: str) -> DataFrame:
    """load_rows of logs in XML: samples by their attributes. What is no sample, or has no duration, doesn't count."""
    rows = spark.read.format("xml").schema("_ts STRING, _t STRING, _lb STRING, _s STRING").option("rowTag", "httpSample").option("mode", "PERMISSIVE").load(path)
    number = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    own = rows.select(F.coalesce(F.nullif("_lb", F.lit("")), F.lit("ALL")).alias("label"), number("_t").alias("elapsed"), F.coalesce(number("_ts"), F.lit(0)).alias("ts"), (F.lower(F.coalesce(F.nullif("_s", F.lit("")), F.lit("true"))) == "true").alias("ok"))
    return own.where("elapsed IS NOT NULL")


def load_summary(rows: DataFrame) -> DataFrame:
    """By label: calls, durations, errors, and calls a second of the whole test."""
    span = rows.agg(((F.max(F.col("ts") + F.col("elapsed")) - F.min("ts")) / 1000.0).alias("seconds"))
    by = rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("elapsed"), 4).alias("mean"), F.min("elapsed").alias("least"), F.max("elapsed").alias("most"), F.count_if(~F.col("ok")).alias("errors"))
    rate = F.round(100.0 * F.col("errors") / F.col("n"), 4)
    return by.crossJoin(F.broadcast(span)).select("*", rate.alias("error_rate"), F.round(F.col("n") / F.col("seconds"), 6).alias("per_second")).drop("seconds")  # span is one row


def field(answer: str, *names: str) -> Column:
    """The first of several fields that an answer in JSON has, lists joined as text; null where it isn't whole."""
    found = []
    for name in names:
        raw = F.get_json_object(answer, f"$.{name}")
        found.append(F.when(raw.startswith("["), F.array_join(F.from_json(raw, "array<string>"), "; ")).otherwise(raw))
    return F.coalesce(*found)


def status_label(status: Column) -> Column:
    out = F.when(status == "ADDED", STATUS_LABELS["ADDED"])
    for s in ("DELETED", "MODIFIED"):
        out = out.when(status == s, STATUS_LABELS[s])
    return out.otherwise(STATUS_LABELS["UNCHANGED"])


def cell(value: Column) -> Column:
    """A table's cell: bars don't end it."""
    return F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|"))


def title(focus: Column) -> Column:
    return F.when(focus.isNull() | (focus == ""), PLAIN_TITLE).when(focus.endswith(REPORT), focus).otherwise(F.concat(focus, F.lit(REPORT)))


def route(key: Column, cls: Column) -> Column:
    """Which comparison an entry takes."""
    return (F.when(cls == "CLASS", "class").when(cls.isin("ARCHIVE", "JAR"), "archive").when(cls == "OFFICE", "office")
            .when(paths.is_text_diffable(cls) | paths.is_known_text(key), "text").otherwise("binary"))


def coverage(changed: DataFrame, k: int) -> DataFrame:
    """One row: changes, those of low risk by rule, those read closely and their share in per cent."""
    low = labels.heuristic_risk(F.col("key"), F.col("file_class")) == "LOW"
    read = F.least(F.count("*"), F.lit(k).cast("long"))
    return changed.agg(F.count("*").alias("total_changed"), F.count_if(low).alias("low"), read.alias("read"), F.round(100.0 * read / F.count("*"), 2).alias("coverage"))


def fingerprints(files: DataFrame) -> DataFrame:
    """(project, files, java_files, fingerprint) of files (project, path, mtime): number of files, last change, build files."""
    names = [n for _, own in BUILD_FILES for n in own]
    build = F.when(paths.file_name(F.col("path")).isin(*names), F.col("path"))
    by = files.groupBy("project").agg(F.count("*").alias("files"), F.count_if(F.col("path").endswith(".java")).alias("java_files"), F.max("mtime").alias("last"), F.array_join(F.sort_array(F.collect_set(build)), ",").alias("build"))
    return by.select("project", "files", "java_files", F.sha2(F.concat_ws("|", "files", "last", "build"), 256).alias("fingerprint"))


def stale(now: DataFrame, known: DataFrame, time: Column, lifetime: int) -> DataFrame:
    """Projects of now that known (project, fingerprint, read_at) doesn't have, has with another fingerprint, or read too long ago."""
    fresh = known.where(time - F.col("read_at") <= lifetime).select("project", "fingerprint")
    return now.join(fresh, ["project", "fingerprint"], "left_anti")


def build_systems(files: DataFrame, by: list[str]) -> DataFrame:
    """(by, build) of files (by, path below the root): by what lies at the root, else by what kind of files there are."""
    out = None
    for name, own in BUILD_FILES:
        hit = F.bool_or(F.col("path").isin(*own))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    inside = F.concat(F.lit("/"), "path")
    out = (out.when(F.bool_or(F.contains(inside, F.lit("/WEB-INF/"))), "war").when(F.bool_or(inside.endswith("/META-INF/MANIFEST.MF") | inside.endswith("/META-INF/MANIFEST.xml")), "jar")
           .when(F.bool_or(inside.endswith(".class")), "bytecode").when(F.bool_or(inside.endswith(".java")), "source").otherwise("none"))
    return files.groupBy(*by).agg(out.alias("build"))


def nearest(rows: DataFrame, dirs: DataFrame, key: str) -> DataFrame:
    """rows (key, path) with the deepest of dirs (dir) above their path, null without one."""
    ups = rows.select(key, F.explode(paths.ancestors(F.col("path"))).alias("dir"))
    best = ups.join(dirs.distinct(), "dir").groupBy(key).agg(F.max_by("dir", F.length("dir")).alias("dir"))
    return rows.join(best, key, "left")


def folder_table(summary: DataFrame) -> DataFrame:
    """(line_no, line) of the table of a folder report, from its one row of counts."""
    lines = [F.concat(F.lit(f"| {name} | "), F.col(c), F.lit(" |")) for name, c in FOLDER_ROWS]
    lines.append(F.concat(F.lit(f"| {SCANNED} | "), "scanned_files", F.lit(" / "), "scanned_dirs", F.lit(" |")))
    return summary.select(F.posexplode(F.array(*lines)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


#: Marks of a folder's tree, and what attributes are called.
MARKS = {"LEFT_ONLY": "[<]", "RIGHT_ONLY": "[>]", "MODIFIED": "[*]", "TYPE_MISMATCH": "[!]", "SAME": "[=]"}
ATTRIBUTES = {"SIZE": "大小 ", "MTIME": "修改时间 ", "CONTENT": "内容不同", "TYPE": "类型冲突(文件/目录)"}
LEGEND = "图例：`[<]` 仅左侧  `[>]` 仅右侧  `[*]` 两侧不同  `[!]` 类型冲突  `[=]` 相同"
NO_LINES = "_无文本文件内容差异（或文本文件内容未变，仅属性变化）。_"


def marker(status: Column, differs_below: Column) -> Column:
    """The mark of an entry; a folder that is the same but for what lies below it has that of a change."""
    out = F.when(differs_below, MARKS["MODIFIED"])
    for name, mark in MARKS.items():
        out = out.when(status == name, mark)
    return out


def attribute_summary(changes: Column) -> Column:
    """What changed of an entry with left_size, right_size, left_mtime_ms, right_mtime_ms."""
    has = lambda c: F.array_contains(changes, c)
    pair = lambda show, c: F.concat(show(F.col(f"left_{c}")), F.lit("→"), show(F.col(f"right_{c}")))
    sized = lambda n: F.coalesce(human_size(n), F.lit("-"))
    parts = F.array_compact(F.array(F.when(has("SIZE"), F.concat(F.lit(ATTRIBUTES["SIZE"]), pair(sized, "size"))), F.when(has("MTIME"), F.concat(F.lit(ATTRIBUTES["MTIME"]), pair(shown_time, "mtime_ms"))),
                                    F.when(has("CONTENT"), ATTRIBUTES["CONTENT"]), F.when(has("TYPE"), ATTRIBUTES["TYPE"])))
    return F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))


def folder_tree(diff: DataFrame) -> DataFrame:
    """(a, b, c, line) of folder_diff as a tree: folders before files, by name, indented by depth."""
    path, is_dir = F.col("path"), F.col("type") == "DIR"
    below = diff.where("status <> 'SAME'").select(F.explode(paths.ancestors(path)).alias("dir")).distinct()
    rows = diff.join(below, path == F.col("dir"), "left")
    differs = is_dir & (F.col("status") == "SAME") & F.col("dir").isNotNull()
    names = F.split(path, "/")
    # Each step of a path says first whether it is a folder; a folder's step ends below any name's characters.
    place = F.array_join(F.transform(names, lambda x, i: F.concat(F.when((i < F.size(names) - 1) | is_dir, "0").otherwise("1"), x)), "\u0001")
    more = F.when(F.col("status") == "MODIFIED", F.concat(F.lit(" "), attribute_summary(F.col("changes")))).when(differs, " (子树含差异)").otherwise("")
    line = F.concat(F.repeat(F.lit("  "), F.size(names) - 1), F.lit("- "), marker(F.col("status"), differs), F.lit(" "), paths.file_name(path), F.when(is_dir, "/").otherwise(""), more)
    return rows.select(F.lit(0).alias("a"), place.alias("b"), F.lit(0).alias("c"), line.alias("line"))


def folder_report(diff: DataFrame, units: DataFrame, errors: DataFrame, left: str, right: str) -> DataFrame:
    """(line_no, line) of the report of two folders: counts, tree, line differences of modified texts (key, old_lines, new_lines), and what could not be read (path, error)."""
    from . import document, lines
    from .diff import folder_summary

    spark = diff.sparkSession
    diff = cut(diff)
    counts = folder_table(folder_summary(diff)).select(F.col("line_no").alias("a"), F.lit("").alias("b"), F.lit(0).alias("c"), "line")
    failed = errors.agg(F.count("*").alias("n"))
    ops = lines.lcs_diff(units, "key", "old_lines", "new_lines")
    mark = F.when(F.col("op") == "del", "- ").when(F.col("op") == "add", "+ ").otherwise("  ")
    shown = units.select("key").distinct()
    each = (ops.select(F.lit(0).alias("a"), F.col("key").alias("b"), (F.col("pos") + 3).alias("c"), F.concat(mark, "text").alias("line"))
            .unionByName(shown.select(F.lit(0).alias("a"), F.col("key").alias("b"), F.posexplode(F.array(F.concat(F.lit("### "), "key"), F.lit(""), F.lit("```diff"))).alias("c", "line")))
            .unionByName(shown.select(F.lit(0).alias("a"), F.col("key").alias("b"), F.explode(F.array(F.struct(F.lit((1 << 31) - 2).alias("c"), F.lit("```").alias("line")), F.struct(F.lit((1 << 31) - 1).alias("c"), F.lit("").alias("line")))).alias("e")).select("a", "b", "e.*")))
    n = F.col("n")
    head = document.fixed(spark, ["# 文件夹对比报告", "", f"- 左侧目录: `{left}`", f"- 右侧目录: `{right}`", "", "## 一、差异汇总", "", "| 维度 | 数量 |", "|---|---|"])
    return document.assembled([
        head, counts, document.of_row(failed, F.concat(F.lit("| 读取错误（已隔离） | "), n, F.lit(" |")), F.lit("")), document.fixed(spark, ["## 二、差异树（展开视图）", "", LEGEND, ""]), folder_tree(diff), document.fixed(spark, ["", "## 三、修改文件内容差异（行级）", ""]), each,
        document.of_row(units.agg(F.count("*").alias("n")).where("n = 0"), F.lit(NO_LINES)), document.of_row(failed.where("n > 0"), F.lit(""), F.lit("## 四、读取错误明细（已隔离，不影响其余比对）"), F.lit("")),
        errors.select(F.lit(0).alias("a"), F.col("path").alias("b"), F.lit(0).alias("c"), F.concat(F.lit("- "), "path", F.lit(": "), "error").alias("line"))])


def default_rule(key: Column, kind: str) -> Column:
    """What a rule of a kind would say for a key."""
    name = paths.file_name(key)
    if kind == "ext":
        return F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    if kind == "name":
        return name
    return F.regexp_extract(key, r"^(.*/)?[^/]*$", 1) if kind == "prefix" else key


# Characters of a log's end, and of a bundle.
LOG_TAIL, BUNDLE = 256 << 10, 5 << 20


def tail(body: Column, most: int) -> Column:
    """The last characters of a log, from the first whole line."""
    end = F.substring(body, F.length(body) - most + 1, F.lit(most))
    return F.when(F.length(body) <= most, body).otherwise(F.substring(end, F.instr(end, "\n") + 1, F.lit(most)))


def bundle(logs: DataFrame, key: str, body: str, room: int) -> DataFrame:
    """(key, n, taken): what logs take of a bundle in the order of their names. One that is longer than what is left stays out but counts, so at most room logs of a character or more are ordered."""
    n = F.length(body)
    first = logs.select(key, n.cast("long").alias("n")).orderBy(key).limit(room)
    left = F.lit(room) - F.coalesce(F.sum("n").over(W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("taken", F.col("n") <= left)
