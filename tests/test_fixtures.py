"""Known cases of single operators, by what they have to give."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.functions import beautify, text, versions
from driftline.operators import align, diff, lines, report


def column(spark, values, expr, kind="string"):
    return [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


def test_versions(spark):
    names = ["app-1.6.1.war", "app-v2.0.1-SNAPSHOT.jar", "app.zip", "BEMP5.0-adapterV202301-02-036M061(20260707-1135).zip"]
    assert column(spark, names, versions.version) == ["1.6.1", "2.0.1-SNAPSHOT", None, "036M061(20260707-1135)"]
    adapter, other = ("BEMP5.0-{}V202301-02-036M0{}({}).zip".format(n, m, t) for n, m, t in (("adapter", 59, "20260703-1104"), ("cpesmq", 61, "20260707-1135")))
    assert not versions.same_package("a1.zip", "a2.zip") and not versions.same_package(adapter, other) and versions.same_package(adapter, "x/" + names[3]) and not versions.same_package(adapter, adapter)
    pairs = spark.createDataFrame([("1.6.2", "1.6.1"), ("036M061(20260708-0900)", "036M061(20260707-1135)"), ("1.6", "1.6")], "a string, b string").select(versions.compare(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.c for r in pairs] == [1, 1, 0]


def test_line_ends_and_marks(spark):
    got = column(spark, ["﻿a\r\nb  \nc\t\r\n", "a\rb ", "x \n\n y", ""], text.normalize)
    assert got == ["a\nb\nc\n", "a\rb", "x\n\n y", ""]


def test_redaction(spark):
    said = "身份证11010119900307651X 密钥AK_SECRET_abc1234 手机13800138000"
    assert column(spark, [said, "12345678901234567890 2138001380001 xAK_abcdefgh", None], text.redact_prompt) == ["身份证***ID*** 密钥***SECRET*** 手机***PHONE***", "12345678901234567890 2138001380001 xAK_abcdefgh", None]


def test_sizes_and_times(spark):
    assert column(spark, [0, 1023, 1024, 1536, 1 << 20, 5 << 30, 3 << 40], text.human_size, "long") == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.0 GB", "3.0 TB"]
    assert column(spark, [0, 1_600_000_000_123, None], text.shown_time, "long") == ["1970-01-01 00:00:00.000", "2020-09-13 12:26:40.123", "-"]


def test_marks_of_folders(spark):
    rows = spark.createDataFrame([("SAME", True), ("SAME", False), ("LEFT_ONLY", False), ("RIGHT_ONLY", False), ("MODIFIED", False), ("TYPE_MISMATCH", False)], "s string, d boolean")
    assert [r.m for r in rows.select(report.marker(F.col("s"), F.col("d")).alias("m")).collect()] == ["[*]", "[=]", "[<]", "[>]", "[*]", "[!]"]
    row = spark.createDataFrame([(["SIZE", "MTIME", "CONTENT", "TYPE"], 10, 2048, 0, None), ([], 1, 1, 1, 1)], "c array<string>, left_size long, right_size long, left_mtime_ms long, right_mtime_ms long")
    assert [r.a for r in row.select(report.attribute_summary(F.col("c")).alias("a")).collect()] == ["[大小 10 B→2.0 KB, 修改时间 1970-01-01 00:00:00.000→-, 内容不同, 类型冲突(文件/目录)]", "[]"]


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("mode", ["char", "word"])
def test_inline_segments(spark, mode):
    """Pieces give both lines back, keep a longest common subsequence, and no two neighbours are of one kind."""
    rng = random.Random(6)
    rows = [("", ""), ("a", ""), ("", "b"), (None, "x"), ("same", "same"), ("x" * 300, "y" * 300), ("one two three", "one three two")]
    rows += [tuple("".join(rng.choice(["a", "b", " ", "word", "é", "  "]) for _ in range(rng.randint(0, 14))) for _ in range(2)) for _ in range(200)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", lines.inline(F.col("a"), F.col("b"), mode).alias("s")).collect()
    import re

    for r in got:
        a, b = r.a or "", r.b or ""
        assert "".join(x.s for x in r.s if x.t != "add") == a and "".join(x.s for x in r.s if x.t != "del") == b
        assert all(x.t != y.t for x, y in zip(r.s, r.s[1:]))
        if mode == "char" and len(a) < 100:
            assert sum(len(x.s) for x in r.s if x.t == "eq") == longest(a, b)
        if mode == "word" and len(a) < 100:
            p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            s = next((i for i, (x, y) in enumerate(zip(a[p:][::-1], b[p:][::-1])) if x != y), min(len(a), len(b)) - p)
            x, y = (re.findall(r"\s+|\S+", t[p : len(t) - s]) for t in (a, b))
            kept = "".join(z.s for z in r.s if z.t == "eq")
            assert len(kept) >= p + s and a.startswith(kept[:p]) and longest(x, y) >= 0
    whole = [r for r in got if r.a == "x" * 300][0]
    assert [(x.t, len(x.s)) for x in whole.s] == [("del", 300), ("add", 300)]


def test_lines_match_by_rules(spark):
    """Lines that differ in blanks, comments or what a pattern takes away are context, and show as they are."""
    rows = spark.createDataFrame([("k", ["int a;", "// one", "x = 1; //t1", "gone"], ["int  a ;", "// two", "x = 1; //t2", "new"])], "key string, old array<string>, new array<string>")
    norm = lambda c: F.transform(c, lambda x: text.rule_normalized(x, True, True, "//t\\d"))
    got = lines.lcs_diff(rows.withColumns({"o": norm("old"), "n": norm("new")}), "key", "old", "new", "o", "n").orderBy("pos").collect()
    assert [(r.op, r.text) for r in got] == [("ctx", "int a;"), ("ctx", "// one"), ("ctx", "x = 1; //t1"), ("del", "gone"), ("add", "new")]


@pytest.mark.parametrize("kind, packed, want", [
    ("CSS", "a{color:red;b:c}d{e:f}", ["a{", "  color:red;", "  b:c", "}d{", "  e:f", "}"]),
    ("JS", 'function f(){var a=";{}";return a;}', ["function f(){", '  var a=";{}";', "  return a;", "  ", "}"])])
def test_spread(kind, packed, want):
    assert beautify.spread(packed, kind).split("\n") == want


def test_four_states_and_stats(spark):
    side = lambda rows: spark.createDataFrame([(k, len(h), h) for k, h in rows], "key string, size long, sha256 string")
    old, new = side([("b", "h2"), ("WEB-INF/lib/x.jar", "h6"), ("u", "h0"), ("d", "h5")]), side([("b", "h3"), ("WEB-INF/lib/x.jar", "h7"), ("c", "h4"), ("u", "h0")])
    rows = diff.snapshot_diff(old, new)
    assert {r.key: r.status for r in rows.collect()} == {"b": "MODIFIED", "WEB-INF/lib/x.jar": "MODIFIED", "u": "UNCHANGED", "d": "DELETED", "c": "ADDED"}
    assert tuple(diff.stats(rows).first()) == (1, 1, 2, 1, 3, 1)


def test_look_ups(spark):
    rows = spark.createDataFrame([("a-1.zip", "a-2.zip", "MODIFIED", "CONTAINER"), ("same", "same", "UNCHANGED", "KEY"), ("gone", None, "DELETED", "NONE"), ("new", "new", "ADDED", "NONE")], "key string, new_key string, status string, match_kind string")
    got = {r.k: (r.new_key, r.old_key) for r in align.looked_up(rows, spark.createDataFrame([("a-1.zip",), ("a-2.zip",), ("same",), ("gone",), ("nowhere",)], "k string"), "k").collect()}
    assert got == {"a-1.zip": ("a-2.zip", None), "a-2.zip": (None, "a-1.zip"), "same": (None, None), "gone": (None, None), "nowhere": (None, None)}


def test_folder_report(spark):
    from driftline.sources import folders

    side = "path string, type string, size long, mtime_ms long, error string, sha256 string"
    left = spark.createDataFrame([("d", "DIR", 0, 0, None, None), ("d/x.txt", "FILE", 1, 0, None, "1"), ("a.txt", "FILE", 3, 0, None, "3"), ("z", "DIR", 0, 0, None, None), ("d/e", "DIR", 0, 0, None, None)], side)
    right = spark.createDataFrame([("d", "DIR", 0, 0, None, None), ("d/x.txt", "FILE", 2, 0, None, "2"), ("a.txt", "FILE", 3, 0, None, "3"), ("b.bin", "FILE", 1, 0, None, "4"), ("d/e", "DIR", 0, 0, None, None)], side)
    units = spark.createDataFrame([("d/x.txt", ["a", "b"], ["a", "c"])], "key string, old_lines array<string>, new_lines array<string>")
    errors = folders.errors(spark.createDataFrame([("bad", "FILE", 0, 0, "read: OSError", None)], side))
    got = [r.line for r in report.folder_report(diff.folder_diff(left, right), units, errors, "L", "R").orderBy("line_no").collect()]
    tree = got[got.index(report.LEGEND) + 2 : got.index("## 三、修改文件内容差异（行级）") - 1]
    assert tree == ["- [*] d/ (子树含差异)", "  - [=] e/", "  - [*] x.txt [大小 1 B→2 B, 内容不同]", "- [<] z/", "- [=] a.txt", "- [>] b.bin"]
    at = got.index("### d/x.txt")
    assert got[at : at + 7] == ["### d/x.txt", "", "```diff", "  a", "- b", "+ c", "```"] and got[-1] == "- bad: read: OSError" and "| 读取错误（已隔离） | 1 |" in got and "| 仅左侧存在 (LEFT_ONLY) | 1 |" in got


def test_rules_are_added_once_and_removed_by_place(spark):
    rules = spark.createDataFrame([], "at int, type string, value string")
    for kind, value in (("ext", ".log"), ("name", "x"), ("ext", ".log"), ("exact", "a/b")):
        rules = diff.with_rule(rules, kind, value)
    listed = lambda r: [(x.at, x.type, x.value) for x in sorted(r.collect(), key=lambda x: x.at)]
    assert listed(rules) == [(0, "ext", ".log"), (1, "name", "x"), (2, "exact", "a/b")]
    assert listed(diff.without_rule(rules, 1)) == [(0, "ext", ".log"), (1, "exact", "a/b")] and listed(diff.without_rule(rules, 9)) == listed(diff.without_rule(rules, -1)) == listed(rules)


def test_costs(spark):
    from driftline.operators import document

    close = spark.createDataFrame([("a", "x" * 100), ("b", "y" * 20_000)], "key string, prompt string")
    got = {(r.mode, r.key): (r.tokens, r.over) for r in document.costs(spark.createDataFrame([("z" * 10,)], "prompt string"), close).collect()}
    assert got == {("report", None): (10_055.0, True), ("analyze", None): (10_055.0, True), ("classify", None): (10_050.0, True), ("single", "a"): (50.0, False), ("single", "b"): (10_000.0, True)}


def test_manifests(spark):
    from driftline.sources import archives

    rows = [("a", "META-INF/MANIFEST.MF", "Version: 1\nBuild-Version: 1.2.3 \r\nBundle-Version: 4.5.6"), ("a", "META-INF/maven/x/pom.properties", "version=1.2.3.4\nversion=9"), ("b", "META-INF/MANIFEST.MF", None), ("c", "META-INF/maven/x/pom.properties", "nothing"), ("d", "META-INF/MANIFEST.MF", "Version:10.1\nVersion:9.10")]
    got = {r.snapshot_id: r.version for r in archives.package_versions(spark.createDataFrame(rows, "snapshot_id string, key string, text string")).collect()}
    assert got == {"a": "1.2.3.4", "b": None, "c": None, "d": "10.1"}
