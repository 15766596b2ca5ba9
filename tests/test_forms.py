import zlib

from driftline.functions import beautify, text
from driftline.operators import diff, tree
from driftline.plans import forms
from pyspark.sql import functions as F


def test_crc_text(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: "--------" if r.text is None else f"{zlib.crc32(r.text.encode()):08x}" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.crc for r in forms.crc_text(spark, sf).collect()} == want


def test_version_assignments_and_noise(spark):
    rows = ["a=1.036M061(20260707-1135)x\nTimestamp: x\n#Tue Mar 03 10:11:12 CET 2020\n # Wed Apr 01 2021\nplain 036M1.20230101.2 end\nk: v 12M3 t\r\n# note\n", "", "﻿x  "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(text.noise_normalized(F.col("t"))).collect()]
    mark = "\x00V\x00"
    assert got == [f"a={mark}\nplain {mark} end\nk:{mark}\n# note\n\n", "\n", "x\n"]


def test_search_patterns_are_those_of_the_engine(spark):
    df = spark.createDataFrame([("a/b.xml",), ("c.js",)], "key string")
    hits = lambda p: sorted(r.key for r in df.where(diff.matches(p, F.col("key"), True)).collect())
    assert hits("B\\.XML$") == ["a/b.xml"]
    assert hits("(?P<n>a)") == hits("a(?#x)b") == hits("(") == ["a/b.xml", "c.js"]  # not patterns to the engine: all pass
    assert hits("\\p{Lower}\\.js") == ["c.js"]  # a pattern to the engine only
    assert text.valid_pattern("[") is None and text.valid_pattern("\\p{Lower}") and text.valid_pattern("(?P<n>a)") is None


def test_risk_filter_is_inert_without_risks(spark):
    rows = spark.createDataFrame([("a", "ADDED"), ("b", "MODIFIED")], "key string, status string")
    none = spark.createDataFrame([], "key string, risk string")
    assert tree.with_risk(rows, none, ("HIGH",)).count() == 2
    some = spark.createDataFrame([("a", "HIGH")], "key string, risk string")
    assert tree.with_risk(rows, some, ()).count() == 2
    assert [r.key for r in tree.with_risk(rows, some, ("HIGH",)).collect()] == ["a"]


def test_tree_order(spark):
    rows = spark.createDataFrame([("b.txt", "FILE"), ("z", "DIR"), ("z/a.txt", "FILE"), ("a.txt", "FILE"), ("z/y", "DIR"), ("z/y/q", "FILE")], "key string, kind string")
    got = tree.page(rows, tree.in_tree(), 10).orderBy("pos").collect()
    assert [r.key for r in got] == ["z", "z/y", "z/y/q", "z/a.txt", "a.txt", "b.txt"]


def test_spread():
    assert beautify.spread("a{b:'}';c}", "CSS") == "a{\n  b:'}';\n  c\n}"
    assert beautify.spread('f(){x="a\\";{";/* { */y}//;}\nz', "JS") == 'f(){\n  x="a\\";{";\n  /* { *\ny\n}//;}\nz'
    assert beautify.spread("/*/a;", "CSS") == "/*\na;\n" and beautify.spread("/* open {", "JS") == "/* open {" and beautify.spread("'open {", "JS") == "'open {"
    assert beautify.spread("}}{", "JS").count("\n") == 3 and beautify.spread("{" * 70, "JS").split("\n")[-1] == "  " * 64


def test_only_minified_texts_are_spread(spark):
    rows = [("JS", "a;b;"), ("JS", "a;b;" * 200), ("CSS", None), ("HTML", "<a><b>"), ("CONFIG", "a{" * 300)]
    got = [r.f for r in spark.createDataFrame(rows, "cls string, t string").coalesce(1).select(beautify.beautified(F.col("t"), F.col("cls")).alias("f")).collect()]
    assert got == ["a;b;", "a;\nb;\n" * 200, None, "<a>\n<b>", "a{" * 300]


def test_forms_made_in_tasks(spark):
    """A spread form made where a text is read is the one that an expression makes."""
    texts = ["", "a", "x;" * 250, "x{y;}" * 100, "x;" * 250 + "\n" * 4, "x;" * 250 + "\n" * 5, "é;" * 201, "y" * 400, "y" * 401 + "\r\n" * 2, "\n".join(["z;" * 210] * 9), "\n".join(["z;" * 210] + ["q"] * 9), "<a></a>" * 90]
    rows = [(c, t) for t in texts for c in ("JS", "CSS", "HTML", "JSP", "CONFIG", "OTHER")]
    cls, text = F.col("cls"), F.col("t")
    made = spark.createDataFrame([(c, t, beautify.spread_form(t, c)) for c, t in rows], "cls string, t string, s string")
    got = made.coalesce(1).select(beautify.form(text, cls, F.col("s")).alias("f"), beautify.beautified(text, cls).alias("g")).collect()
    assert [r.f for r in got] == [r.g for r in got] and any(r[2] for r in made.collect())
