import random
import re
from collections import namedtuple

from pyspark.sql import functions as F

from driftline.operators import document as doc
from driftline.operators import lines

Row = namedtuple("Row", "key status folder label body total")


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(4), rng.choice("abc"), i) for i in range(3000)]
    rng.shuffle(rows)
    got = doc.numbered(spark.createDataFrame(rows, "a int, b string, c int").repartition(7), ["a", "b", "c"]).collect()
    assert [(r.a, r.b, r.c) for r in sorted(got, key=lambda r: r.line_no)] == sorted(rows) and sorted(r.line_no for r in got) == list(range(1, 3001))
    assert doc.numbered(spark.createDataFrame([], "a int, b string, c int"), ["a", "b", "c"]).count() == 0


def test_written_parts_follow_each_other(spark, tmp_path):
    document = doc.assembled([doc.fixed(spark, ["head", ""]), spark.range(500).select(F.col("id").alias("a"), F.lit("").alias("b"), F.lit(0).alias("c"), F.concat(F.lit("row "), "id").alias("line")), doc.fixed(spark, ["end"])])
    doc.write(document, f"{tmp_path}/doc")
    assert doc.read(spark, f"{tmp_path}/doc") == ["head", "", *(f"row {i}" for i in range(500)), "end"]


def test_digest(spark):
    units = spark.createDataFrame([("a", ["1", "2", "3"], ["1", "x" * 130, "3", "4"]), ("same", ["1"], ["1"]), ("long", [], [str(i) for i in range(50)]), ("gone", ["p", "q"], [])], "key string, old_lines array<string>, new_lines array<string>")
    got = {r.key: r.digest.split("\n") for r in doc.digests(units).collect()}
    assert got["a"] == ["- [修改] 老 L2 → 新 L2：", "-   2", "+   " + "x" * 120 + "…", "", "- [新增] 新 L4：", "+   4"]
    assert got["same"] == [doc.NO_DIFF] and got["gone"] == ["- [删除] 老 L1-2：", "-   p", "-   q"]
    assert got["long"][0] == "- [新增] 新 L1-50：" and got["long"][41:] == ["    … 新侧其余 10 行省略"] and len(got["long"]) == 42


def test_many_blocks(spark):
    old, new = [], []
    for i in range(150):
        old += [f"keep {i}", "a"]
        new += [f"keep {i}", "b"]
    got = doc.digests(spark.createDataFrame([("k", old, new)], "key string, old_lines array<string>, new_lines array<string>")).first().digest
    assert got.count("- [修改]") == 120 and got.endswith("... (变更块过多，已省略：共 150 块，仅显示前 120 块)")


def diff_of(spark, rows):
    return spark.createDataFrame([(k, s, c) for k, s, c in rows], "key string, status string, file_class string")


def test_report(spark):
    diff = diff_of(spark, [("conf/a.xml", "MODIFIED", "CONFIG"), ("conf/b|c.xml", "ADDED", "CONFIG"), ("x/lib/p.jar", "MODIFIED", "JAR"), ("A.class", "DELETED", "CLASS"), ("same.txt", "UNCHANGED", "CONFIG")])
    units = "key string, status string, engine string, error string, old_lines array<string>, new_lines array<string>"
    texts = spark.createDataFrame([("conf/a.xml", "MODIFIED", "text-normalize", None, ["1"], ["2"]), ("conf/b|c.xml", "ADDED", None, "BadZipFile", [], [])], units)
    classes = spark.createDataFrame([("A.class", "DELETED", None, "not decompiled", [], [])], units)
    jars = spark.createDataFrame([("x/lib/p.jar", "MODIFIED", "P.class", "MODIFIED"), ("x/lib/p.jar", "MODIFIED", "Q.class", "UNCHANGED")], "jar string, jar_status string, inner string, status string")
    got = [r.line for r in doc.report(diff, texts, classes, jars, "old.war", "new.war", "T").orderBy("line_no").collect()]
    text = "\n".join(got)
    assert got[:5] == [doc.TITLE, "", "- 老包：`old.war`（版本 N/A）", "- 新包：`new.war`（版本 N/A）", ""]
    assert "- 新增 **1** · 删除 **1** · 修改 **2** · 未变 1\n- 业务/类级变更(非jar)：3 · jar 级变更：1\n" in text
    assert "|---|---|---|---|\n| Java 类 | 0 | 1 | 0 |\n| 依赖 JAR | 0 | 0 | 1 |\n| 配置文件(XML/Properties) | 1 | 0 | 1 |\n| **合计** | **1** | **1** | **2** |\n" in text
    assert "## 二、差异文件树（全量清单）\n- `修改 ~` conf/a.xml\n- `修改 ~` x/lib/p.jar\n- `新增 +` conf/b|c.xml\n- `删除 -` A.class\n\n## 三" in text
    assert "### A.class\n- 反编译失败：not decompiled\n\n" in text and "### conf/a.xml\n- 处理引擎：text-normalize\n```diff\n- [修改] 老 L1 → 新 L1：\n-   1\n+   2\n```\n\n### conf/b|c.xml\n- 读取/美化失败：BadZipFile\n" in text
    assert "> 共 1 个差异 JAR（新增 0 / 修改 1 / 删除 0）；其内部 class 合计：新增 0 · 删除 0 · 修改 1 · 未变 1。" in text and "- `A.class`（潜在对外 API / 行为移除，需重点回归）" in text
    sections = [x for x in got if x.startswith("## ")]
    assert [x[3] for x in sections] == list("一二三四五六七")


def test_report_of_nothing(spark):
    units = "key string, status string, engine string, error string, old_lines array<string>, new_lines array<string>"
    none = spark.createDataFrame([], units)
    got = [r.line for r in doc.report(diff_of(spark, []), none, none, spark.createDataFrame([], "jar string, jar_status string, inner string, status string"), "a", "b", "T").orderBy("line_no").collect()]
    assert doc.NO_TEXTS in got and doc.NO_JARS in got and doc.NO_DELETED in got and "- 新增 **0** · 删除 **0** · 修改 **0** · 未变 0" in got


def test_overview_of_few_files():
    rows = [Row(f"k{i}.js", "MODIFIED", "", "JavaScript", "x" * n, t) for i, (n, t) in enumerate([(10, 5), (9_000, 200), (7_000, 80), *[(8_000, 80)] * 8])]
    got = doc.overview(rows, len(rows))
    assert got.startswith("\n### k0.js (修改，JavaScript)\nxxxxxxxxxx\n\n### k1.js") and "上限 8000 字符" in got and "总字符上限" in got
    assert re.search(r"概览已达字符上限 60000，另有 \d+ 个变更文件未纳入", got) and len(got) < 61_000
    assert doc.overview([Row("A.class", "DELETED", "", None, None, None)], 1) == "\n### A.class (删除)\n(无源码/未纳入 Top-K)\n"


def test_overview_of_many_folders():
    folders = [f"d{i:03}" for i in range(50)]
    rows = [Row(f"{f}/k{j}.js", "ADDED", f, "JavaScript", "x" * 3000, 10) for f in folders[:30] for j in range(5)]
    got = doc.overview(rows, 250, {f: (5, 5, 0, 0) for f in folders[:30]}, folders[:30], 50)
    assert got.count("### [目录]") == 30 and got.count("JavaScript") == 30 and got.count("该组另有 4 个变更文件未列出") == 30 and got.endswith("剩余目录的代表文件未列出)\n") and len(got) <= 62_000
    one = doc.overview([r for r in rows if r.folder == "d000"] * 8, 40, {"d000": (40, 40, 0, 0)}, ["d000"], 1)
    assert one.count("JavaScript") == 20 and "该组另有 20 个变更文件未列出" in one


def test_prompts(spark):
    keys = [f"web/p{i % 3}/f{i}.js" for i in range(40)]
    diff = diff_of(spark, [(k, "MODIFIED", "JS") for k in keys] + [("conf/app.xml", "ADDED", "CONFIG")])
    units = spark.createDataFrame([(k, "MODIFIED", None, ["a"], ["密钥AK_SECRET_abc1234", "13800138000"]) for k in [*keys, "conf/app.xml"]], "key string, status string, error string, old_lines array<string>, new_lines array<string>")
    ops = lines.lcs_diff(units, "key", "old_lines", "new_lines")
    got = doc.overview_prompt(diff, ops).first().prompt
    assert "新增=1 删除=0 修改=40 未变=0" in got and got.count("### [目录]") == 4 and "`fileRisks`(空数组)" in got and "***PHONE***" in got and "abc1234" not in got
    assert "13800138000" in doc.overview_prompt(diff, ops, local=True).first().prompt
    few = doc.overview_prompt(diff.limit(2), ops, "背景").first().prompt
    assert "oneLineReason" in few and "背景" in few and few.count("\n### ") == 2
    close = {r.key: r.prompt for r in doc.close_prompts(units).collect()}
    assert len(close) == 15 and all("```diff\n- [修改] 老 L1 → 新 L1-2：\n-   a\n" in p and "***SECRET***" in p for p in close.values())
