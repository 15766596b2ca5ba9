"""Documents made of rows: reports of any length whose lines are put in order without ever meeting in one place, and bounded prompts.

A document is a union of sections, rows with a place and a line. Places are dealt out in ranges, ranges are counted, and a line's
number is what stands before its range plus its rank inside. Writing deals the numbers out in ranges again: part files follow
each other as the document does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels, paths, text
from ..sources.tables import cut
from . import diff as d
from . import lines
from .report import STATUS_LABELS, cell, status_label

# How much of a difference a digest shows.
BLOCKS, SIDE, CHARS = 120, 40, 120
# Words and headings of the report.
CHANGE = {"MODIFIED": "修改", "ADDED": "新增", "DELETED": "删除"}
TITLE, STATS, TYPES, TREE = "# 差异分析报告（Java 端口 / 真实包比对）", "## 一、差异统计", "### 按文件类型分布", "## 二、差异文件树（全量清单）"
CLASSES, TEXTS, JARS = "## 三、反编译源码级差异（Top-{k} 修改/新增/删除 Java 类）", "## 四、文本类文件内容差异（Top-{k} 修改/新增/删除 配置文件/JSP/JS/HTML/CSS）", "## 五、差异依赖 JAR 内部源码对比（Top-{k} 内部 class 反编译源码级 diff）"
BREAKING, AUDIT = "## 六、破坏性变更清单（删除类/删除前端资源）", "## 七、审计摘要（基础）"
NO_TEXTS, NO_JARS, NO_DELETED, NO_DIFF = "- 无文本类文件（配置文件/JSP/前端源码）变动。", "- 无差异依赖 JAR（本次比对未检出 JAR 级依赖变动）。", "- 无删除类。", "(无内容级差异行)"
# What a prompt holds at most: files in its overview, lines and characters of each, characters in all, the least that is still worth giving, files read closely and their characters.
OVERVIEW, SAMPLE, FILE_CHARS, ALL_CHARS, LEAST, CLOSELY, CLOSE_CHARS = 30, 80, 8_000, 60_000, 500, 15, 60_000
KINDS = {"JS": "JavaScript", "HTML": "HTML 模板", "CSS": "CSS 样式", "JSP": "JSP 页面", "CONFIG": "配置文件"}


def numbered(rows: DataFrame, order: list[str], name: str = "line_no") -> DataFrame:
    """rows with their number from 1 in an order that is total."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    starts = sizes.select(F.col("_part").alias("_of"), before.alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_inside", inside).join(starts, F.col("_part") == F.col("_of")).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_of", "_n", "_before", "_inside")


def assembled(sections: list[DataFrame]) -> DataFrame:
    """(line_no, line) of sections (a, b, c, line), one after the other, each in the order of a number, a text and a number."""
    every = [s.select(F.lit(i).alias("section"), F.col("a").cast("long"), F.col("b").cast("string"), F.col("c").cast("long"), "line") for i, s in enumerate(sections)]
    return numbered(reduce(DataFrame.unionByName, every), ["section", "a", "b", "c"]).select("line_no", "line")


def write(document: DataFrame, path: str) -> None:
    """The lines as text files that follow each other by name."""
    document.repartitionByRange("line_no").sortWithinPartitions("line_no").select("line").write.text(path)


def read(spark: SparkSession, path: str) -> list[str]:
    """The lines of a written document that is small enough to be looked at."""
    files = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())
    return [line for f in files for line in spark.read.text(f, wholetext=True).first()[0].split("\n")[:-1]]


def fixed(spark: SparkSession, rows: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, "", 0, x) for i, x in enumerate(rows)], "a int, b string, c int, line string")


def of_row(row: DataFrame, *parts: Column) -> DataFrame:
    """Lines made of a single row."""
    return row.select(F.posexplode(F.array(*parts)).alias("a", "line")).select("a", F.lit("").alias("b"), F.lit(0).alias("c"), "line")


def _span(start: str, end: str) -> Column:
    return F.when(F.col(start) == F.col(end), F.concat(F.lit("L"), start)).otherwise(F.concat(F.lit("L"), start, F.lit("-"), end))


def digest_lines(blocks: DataFrame, key: str) -> DataFrame:
    """(key, change_no, line_no, line): change_blocks as a digest shows them."""
    shown = lines.capped_blocks(blocks, key, BLOCKS, SIDE, CHARS)
    old, new, kind = _span("old_start", "old_end"), _span("new_start", "new_end"), F.col("type")
    where = F.when(kind == "MODIFIED", F.concat(F.lit("老 "), old, F.lit(" → 新 "), new)).when(kind == "ADDED", F.concat(F.lit("新 "), new)).otherwise(F.concat(F.lit("老 "), old))
    label = F.when(kind == "ADDED", CHANGE["ADDED"]).when(kind == "DELETED", CHANGE["DELETED"]).otherwise(CHANGE["MODIFIED"])
    head = F.concat(F.lit("- ["), label, F.lit("] "), where, F.lit("："))
    side = lambda c, mark: F.transform(c, lambda x: F.concat(F.lit(mark), x))
    rest = lambda c, word: F.when(F.col(c) > 0, F.array(F.concat(F.lit(f"    … {word}侧其余 "), c, F.lit(" 行省略")))).otherwise(F.array().cast("array<string>"))
    own = F.concat(F.array(head), side("old_lines", "-   "), rest("old_omitted", "老"), side("new_lines", "+   "), rest("new_omitted", "新"), F.array(F.lit("")))
    rows = shown.select(key, "change_no", F.posexplode(own).alias("line_no", "line"))
    more = blocks.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > BLOCKS)
    return rows.unionByName(more.select(key, F.lit(BLOCKS + 1).alias("change_no"), F.lit(0).alias("line_no"), F.concat(F.lit("... (变更块过多，已省略：共 "), "n", F.lit(f" 块，仅显示前 {BLOCKS} 块)")).alias("line")))


def digests(units: DataFrame, key: str = "key") -> DataFrame:
    """(key, digest) of units (key, old_lines, new_lines): a text of at most BLOCKS blocks each."""
    blocks = lines.change_blocks(lines.lcs_diff(units, key, "old_lines", "new_lines"), key)
    rows = digest_lines(blocks, key).groupBy(key).agg(F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("change_no", "line_no", "line"))), lambda x: x["line"]), "\n"), F.lit(" \n\t")).alias("digest"))
    return units.select(key).join(rows, key, "left").select(key, F.coalesce("digest", F.lit(NO_DIFF)).alias("digest"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows (key, status) with a and b: the order of a report."""
    return rows.withColumns({"a": labels.status_rank(F.col("status")), "b": F.col("key")})


def _units(units: DataFrame, k: int, engine: str, failed: str) -> DataFrame:
    """Sections of the first k units (key, status, engine, error, old_lines, new_lines) that could be read, and a line for those before them that couldn't."""
    order = ranked(units).orderBy("a", "b")
    good = cut(order.where("error IS NULL").limit(k))
    last = good.agg(F.max(F.struct("a", "b")).alias("last"), F.count("*").alias("n"))
    shown = good.join(digests(good.select("key", "old_lines", "new_lines")), "key")
    body = F.concat(F.array(F.concat(F.lit("### "), "key"), F.concat(F.lit(f"- {engine}："), "engine"), F.lit("```diff")), F.split("digest", "\n"), F.array(F.lit("```"), F.lit("")))
    bad = order.where("error IS NOT NULL").join(F.broadcast(last), (F.struct("a", "b") < F.col("last")) | (F.col("n") < k) | F.col("last").isNull())  # one row
    broken = F.array(F.concat(F.lit("### "), "key"), F.concat(F.lit(f"- {failed}："), "error"), F.lit(""))
    return shown.select("a", "b", F.posexplode(body).alias("c", "line")).unionByName(bad.select("a", "b", F.posexplode(broken).alias("c", "line")))


def report(diff: DataFrame, texts: DataFrame, classes: DataFrame, libraries: DataFrame, old_name: str, new_name: str, time: str, k: int = 12) -> DataFrame:
    """(line_no, line) of the report of a comparison.

    diff: (key, status, file_class, ...). texts, classes: changed entries (key, status, engine, error, old_lines, new_lines).
    libraries: classes of changed libraries (jar, jar_status, inner, status). Versions are unknown here ("N/A").
    """
    spark = diff.sparkSession
    # Columns are joined as text; the report's rows are as many as the changes.
    changed = cut(diff.where("status <> 'UNCHANGED'").select("key", "status", "file_class"))
    stats = cut(d.stats(diff))
    n = F.col
    heading = fixed(spark, [TITLE, "", f"- 老包：`{old_name}`（版本 N/A）", f"- 新包：`{new_name}`（版本 N/A）", ""])
    counts = of_row(stats, F.lit(STATS), F.concat(F.lit("- 新增 **"), n("added"), F.lit("** · 删除 **"), n("deleted"), F.lit("** · 修改 **"), n("modified"), F.lit("** · 未变 "), n("unchanged")),
                    F.concat(F.lit("- 业务/类级变更(非jar)："), n("biz_changed"), F.lit(" · jar 级变更："), n("jar_changed")), F.lit(""))
    rows = d.type_breakdown(changed).where("total > 0").select("category", F.concat(F.lit("| "), cell(n("category")), *[x for c in ("added", "deleted", "modified") for x in (F.lit(" | "), n(c))], F.lit(" |")).alias("line"), "added", "deleted", "modified")
    whole = of_row(stats, F.concat(F.lit("| **合计** | **"), n("added"), F.lit("** | **"), n("deleted"), F.lit("** | **"), n("modified"), F.lit("** |")), F.lit(""))
    types = [fixed(spark, [TYPES, "| 文件类型 | 新增 | 删除 | 修改 |", "|---|---|---|---|"]), rows.where("category IS NOT NULL").select(F.lit(0).alias("a"), F.col("category").alias("b"), F.lit(0).alias("c"), "line"), whole]
    tree = [fixed(spark, [TREE]), ranked(changed).select("a", "b", F.lit(0).alias("c"), F.concat(F.lit("- `"), status_label(F.col("status")), F.lit("` "), "key").alias("line")), fixed(spark, [""])]

    def told(units: DataFrame, heading: str, none: str | None, some, engine: str, failed: str, rest: str) -> list[DataFrame]:
        size = units.agg(F.count("*").alias("n"))
        head = of_row(size, F.lit(heading.format(k=k)), *([F.when(n("n") > 0, some(n("n"))).otherwise(none), F.lit("")] if none else [some(n("n")), F.lit("")]))
        return [head, _units(units, k, engine, failed), of_row(size.where(n("n") > k), F.concat(F.lit("> 另有 "), n("n") - k, F.lit(f" 个{rest}未展开（Top-K 限制）。")), F.lit(""))]

    classed = told(classes, CLASSES, None, lambda m: F.concat(F.lit("> 共 "), m, F.lit(" 个类已反编译（本处仅展示前 Top-K 条，且每条仅列变更行）。")), "反编译引擎", "反编译失败", "修改类")
    texted = told(texts, TEXTS, NO_TEXTS, lambda m: F.concat(F.lit("> 共 "), m, F.lit(" 个文本类文件已做内容级逐行 diff（本处仅展示前 Top-K 条，且每条仅列变更行）。")), "处理引擎", "读取/美化失败", "文本类文件")
    one = cut(libraries.groupBy("jar").agg(F.first("jar_status").alias("jar_status"), *[d.count_status(s).alias(s.lower()) for s in STATUS_LABELS]))
    all_ = one.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(s.lower()), F.lit(0)).alias(s.lower()) for s in STATUS_LABELS], *[F.count_if(n("jar_status") == s).alias(f"jars_{s.lower()}") for s in CHANGE])
    jar_head = of_row(all_, F.lit(JARS.format(k=k)), F.when(n("n") == 0, NO_JARS).otherwise(F.concat(
        F.lit("> 共 "), n("n"), F.lit(" 个差异 JAR（新增 "), n("jars_added"), F.lit(" / 修改 "), n("jars_modified"), F.lit(" / 删除 "), n("jars_deleted"), F.lit("）；其内部 class 合计：新增 "), n("added"), F.lit(" · 删除 "), n("deleted"),
        F.lit(" · 修改 "), n("modified"), F.lit(" · 未变 "), n("unchanged"), F.lit("。"))), F.lit(""))
    beyond = n("added") + n("deleted") + n("modified")
    parts = F.array_compact(F.array(F.when(beyond > 0, F.concat(beyond, F.lit(" 个超出全局 Top-K 未展开源码"))), F.when(n("unchanged") > 0, F.concat(n("unchanged"), F.lit(" 个未变更（已折叠，无需反编译）")))))
    jar = F.array(F.concat(F.lit("### "), "jar", F.lit("  ["), status_label(n("jar_status")), F.lit("]")), F.concat(F.lit("- 内部 class：新增 **"), n("added"), F.lit("** · 删除 **"), n("deleted"), F.lit("** · 修改 **"), n("modified"), F.lit("** · 未变 "), n("unchanged")), F.lit(""),
                  F.concat(F.lit("> 另有 "), F.array_join(parts, " · "), F.lit("；可在 GUI 双击该 JAR 查看全部内部 class 的逐项反编译对比。")), F.lit(""))
    jars = [jar_head, one.select(F.lit(0).alias("a"), F.col("jar").alias("b"), F.posexplode(jar).alias("c", "line"))]
    gone = changed.where("status = 'DELETED'")
    broken = [fixed(spark, [BREAKING]), of_row(stats.where("deleted = 0"), F.lit(NO_DELETED)), gone.select(F.lit(0).alias("a"), F.col("key").alias("b"), F.lit(0).alias("c"), F.concat(F.lit("- `"), "key", F.lit("`（潜在对外 API / 行为移除，需重点回归）")).alias("line")), fixed(spark, [""])]
    foot = [fixed(spark, [AUDIT, f"- 比对时间：{time}", "- 老包标识：N/A", "- 新包标识：N/A", "- AI 分析：未接入，本报告不含 AI 章节。"])]
    return assembled([heading, counts, *types, *tree, *classed, *texted, *jars, *broken, *foot])


# -- prompts: everything that goes into one is bounded before it meets


def file_label(key: Column) -> Column:
    """What kind of text a key is, for a prompt; null for classes and what has none."""
    cls = paths.file_class(key)
    out = None
    for name, label in KINDS.items():
        out = F.when(cls == name, label) if out is None else out.when(cls == name, label)
    return out.when(cls == "OFFICE", "文本资源")


def _summary(row, room: int) -> str:
    """What a prompt says of one file, in what room is left."""
    head = f"\n### {row.key} ({CHANGE[row.status]}{'，' + row.label if isinstance(row.label, str) else ''})\n"
    if not isinstance(row.body, str):
        return f"{head}(无源码/未纳入 Top-K)\n"
    body = row.body + "\n" + (f"... (截断，共 {int(row.total)} 行)\n" if row.total > SAMPLE else "")
    if len(body) > FILE_CHARS:
        body = f"{body[:FILE_CHARS]}\n... (单文件摘要超长已截断：上限 {FILE_CHARS} 字符)\n"
    if len(body) > room:
        body = f"{body[:room]}\n... (已达阶段A 总字符上限)\n"
    return head + body


def overview(files: list, total: int, groups: dict[str, tuple[int, int, int, int]] | None = None, order: list[str] = (), n_groups: int = 0) -> str:
    """The files' part of a prompt. Few files come one after the other while room is left; of many each folder has its counts and, of what is left, an equal share of room and places."""
    out, room = "", ALL_CHARS
    if total <= OVERVIEW:
        for i, row in enumerate(files):
            if room < LEAST:
                return f"{out}\n... (阶段A 概览已达字符上限 {ALL_CHARS}，另有 {total - i} 个变更文件未纳入)\n"
            more = _summary(row, room)
            out, room = out + more, room - len(more)
        return out
    places, left = OVERVIEW, n_groups
    for folder in order:
        if room < LEAST or places <= 0:
            break
        share, seats = max(LEAST, room // left), max(1, -(-places // left))
        n, added, modified, deleted = groups[folder]
        more = f"\n### [目录] {folder or '/'}（共 {n} 个变更：新增{added}/修改{modified}/删除{deleted}）\n"
        shown = 0
        for row in [r for r in files if r.folder == folder][:seats]:
            if share < LEAST:
                break
            own = _summary(row, share)
            more, share, shown = more + own, share - len(own), shown + 1
        if shown < n:
            more += f"\n... (该组另有 {n - shown} 个变更文件未列出)\n"
        out, room, places, left = out + more, room - len(more), places - seats, left - 1
    if left and (room < LEAST or places <= 0):
        out += "\n... (阶段A 概览已达上限，剩余目录的代表文件未列出)\n"
    return out


def overview_prompt(diff: DataFrame, ops: DataFrame, context: str = "", local: bool = False) -> DataFrame:
    """One row (prompt): counts and what the first files say of the change, for an answer in JSON. ops: line differences (key, pos, op, text).

    Of many changes only the first OVERVIEW folders can have room, and OVERVIEW files of each; these are picked, and only their
    first SAMPLE lines are read, before anything comes together.
    """
    changed = ranked(diff.where("status <> 'UNCHANGED'").select("key", "status")).withColumn("folder", F.when(F.contains("key", F.lit("/")), F.regexp_extract("key", "(?s)^(.*)/", 1)).otherwise("/"))
    changed = cut(changed)
    groups = changed.groupBy("folder").agg(F.min(F.struct("a", "b")).alias("first"), F.count("*").alias("n"), *[d.count_status(s).alias(s.lower()) for s in ("ADDED", "MODIFIED", "DELETED")])
    size = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("folders"))
    heads = cut(groups.orderBy("first").limit(OVERVIEW))
    many = size.first()
    picked = changed.join(heads.select("folder"), "folder") if many.total > OVERVIEW else changed
    picked = cut(picked.withColumn("seat", F.row_number().over(W.partitionBy("folder").orderBy("a", "b"))).where(F.col("seat") <= OVERVIEW))
    said = ops.join(picked.select("key"), "key", "left_semi")
    mark = F.when(F.col("op") == "del", "- ").when(F.col("op") == "add", "+ ").otherwise("  ")
    bodies = said.groupBy("key").agg(F.count("*").alias("total"), F.sort_array(F.collect_list(F.when(F.col("pos") < SAMPLE, F.struct("pos", F.concat(mark, "text").alias("t"))))).alias("l"))
    rows = picked.join(bodies, "key", "left").select("key", "status", "folder", "a", "b", file_label(F.col("key")).alias("label"), F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("body"), "total")
    files = rows.toPandas().sort_values(["a", "b"])  # OVERVIEW * OVERVIEW rows at most
    found = heads.orderBy("first").collect()
    counts = d.stats(diff).first()
    head = ("对比两个构建包的差异，以 JSON 返回：`overallRisk`(LOW/MEDIUM/HIGH)、`impactScope`、`testThemes`(数组)、"
            + ("`fileRisks`(空数组)" if many.total > OVERVIEW else "`fileRisks`(数组：`key`、`risk`、`oneLineReason`)") + (f"、`contextInfluence`\n\n{context}\n" if context else "\n\n"))
    head += f"## 差异统计\n新增={counts.added} 删除={counts.deleted} 修改={counts.modified} 未变={counts.unchanged}\n\n## 改动文件与 diff 摘要（截断，最多 {OVERVIEW} 个）\n"
    said = head + overview(list(files.itertuples(index=False)), many.total, {r.folder: (r.n, r.added, r.modified, r.deleted) for r in found}, [r.folder for r in found], many.folders)
    one = diff.sparkSession.createDataFrame([(said,)], "prompt string")
    return one if local else one.select(text.redact_prompt(F.col("prompt")).alias("prompt"))


def close_prompts(units: DataFrame, context: str = "", local: bool = False) -> DataFrame:
    """(key, prompt) of the first CLOSELY units (key, status, old_lines, new_lines) that could be read: what changed, line by line, for an answer in JSON."""
    first = cut(ranked(units.where("error IS NULL")).orderBy("a", "b").limit(CLOSELY))
    cls, label = paths.file_class(F.col("key")), file_label(F.col("key"))
    about = F.when(paths.is_frontend_text(cls), "页面/交互/接口").when(cls == "JSP", "页面渲染/请求处理/标签逻辑").when(cls == "CONFIG", "配置项语义/模块行为/启动加载").otherwise("调用方（对外 API 变更时给出迁移建议）")
    rows = first.join(digests(first.select("key", "old_lines", "new_lines")), "key")
    size = F.length("digest")
    shown = F.when(size > CLOSE_CHARS, F.concat(F.substring("digest", 1, CLOSE_CHARS), F.lit("\n... (差异摘要过长已截断：共 "), size, F.lit(" 字符)\n"))).otherwise(F.col("digest"))
    prompt = F.concat(F.lit(f"## 项目级上下文（简要）\n{context}\n\n" if context else ""), F.lit("深读以下改动，以 JSON 返回：intent、risk(LOW/MEDIUM/HIGH)、impact（含对"), about, F.lit("的影响）、testPoints(数组)、contextInfluence。\n\n### "), "key",
                      F.coalesce(F.concat(F.lit(" （"), label, F.lit("）")), F.lit("")), F.lit("\n```diff\n"), shown, F.lit("\n```\n"))
    return rows.select("key", (prompt if local else text.redact_prompt(prompt)).alias("prompt"))


# Fixed value: tokens from which the cost of a call has to be confirmed.
WARN_TOKENS = 8_000


def costs(overview: DataFrame, close: DataFrame, warn: float = WARN_TOKENS) -> DataFrame:
    """(mode, key, tokens, over) of what calls would send: report and analyze the overview and the close prompts, classify the close ones, single one file's."""
    tokens = lambda rows: F.coalesce(F.sum(text.token_estimate(F.col("prompt"))), F.lit(0.0)).alias("tokens")
    closely = close.agg(tokens(close)).withColumnRenamed("tokens", "close")
    both = overview.agg(tokens(overview)).join(F.broadcast(closely))  # one row each
    modes = both.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(None).cast("string").alias("key"), v.alias("tokens")) for m, v in (("report", F.col("tokens") + F.col("close")), ("analyze", F.col("tokens") + F.col("close")), ("classify", F.col("close")))])).alias("m")).select("m.*")
    single = close.select(F.lit("single").alias("mode"), "key", text.token_estimate(F.col("prompt")).alias("tokens"))
    return modes.unionByName(single).withColumn("over", F.col("tokens") > warn)
