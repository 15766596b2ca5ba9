from collections import Counter

from pyspark.sql import functions as F

from driftline.llm import quality_rules as qr


def repeated(text):
    ws = text.split()
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    often = Counter(grams)
    return len({p for i, g in enumerate(grams) if often[g] > 1 for p in (i, i + 1, i + 2)})


def prose(i, n=80):
    return " ".join(f"w{(i * 7919 + k * k * 31 + k) % 997}" for k in range(n))


def test_counts(spark):
    texts = ["", "   ", None, "a b", "a b c a b c", "a a a a", "x y z q x y z", "a b c d a b c d a b", "l #1\nl #1\n\nl #1\n &", "é ü\x0bñ", " ".join(["p q r"] * 4000), prose(1) + " " + prose(1)]
    df = spark.createDataFrame([(i, t, "en", "s", "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words string")
    for r in qr.measure(df).collect():
        t, c = r.text or "", r.rule_counts
        assert c.n_words == len(t.split()) and c.n_repeat_words == repeated(t), repr(t[:60])
        assert c.word_chars == sum(map(len, t.split())) and c.n_symbols == sum(x in "#*$%&|<>" for x in t)
        lines = [x for x in t.split("\n") if x.strip()]
        assert c.n_dup_lines == len(lines) - len(set(lines))


def test_keeps_clean_and_rejects_outliers(spark):
    rows = [(i, prose(i), "en" if i % 2 else None, "s" if i % 3 else "t", "x") for i in range(600)]
    rows += [(1000, " ".join(f"| w{k}" for k in range(80)), "en", "s", "x"), (1001, " ".join(f"LOUD{chr(65 + k % 26)}{chr(65 + k // 26)}" for k in range(80)), "en", "s", "x"), (1002, "too short", "en", "s", "x"), (1003, None, None, None, "x"), (1004, " ".join(["a b c"] * 30), "en", "new", "x"), (1, prose(1), "en", "s", "x"), (None, prose(3), "en", "s", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fence_length string")
    out = qr.keep_good(df)
    assert out.columns == df.columns
    kept = Counter(r.doc_id for r in out.collect())
    assert kept[None] == 1 and kept[1] == 2 and all(kept[i] for i in range(600))
    assert not any(kept[i] for i in (1000, 1001, 1002, 1003, 1004))
    assert qr.keep_good(df.limit(0)).count() == 0


def test_sketches_merge(spark):
    rows = [(i, prose(i, 60 + i % 50), "en", f"s{i % 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    half = [qr.sketch(qr.measure(df.where(F.col("doc_id") % 2 == k))) for k in (0, 1)]
    merged = half[0].union(half[1]).groupBy("lang", "source", "rule", "bin").agg(F.sum("n").alias("n"))
    whole = qr.sketch(qr.measure(df))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


def test_few_repeated_lines_are_no_reason(spark):
    """Clean documents of a few lines, one or two of which repeat, stay; many repeated lines go."""
    rows = [(i, prose(i), "en", "s") for i in range(600)]
    line = "and so it says here once again"
    rows += [(700, f"{prose(9, 60)}\n{line}\n{line}", "en", "s"), (701, f"{prose(8, 40)}\n{line}\n{prose(7, 40)}\n{line}\n{prose(6, 30)}\n{line}", "en", "s")]
    rows += [(702, "\n".join(f"{line} {k // 2} {prose(k // 2, 6)}" for k in range(60)), "en", "s")]
    kept = {r.doc_id for r in qr.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {*range(600), 700, 701} <= kept and 702 not in kept


def test_columns_with_names_of_ours(spark):
    names = ["rule_counts", "fence_lang", "fence_source", "fence_symbols", "kept", "base_failed", "row", "rule", "bin"]
    rows = [(i, prose(i), "en", None, *"abcdefghi") for i in range(5)] + [(9, None, None, None, *"abcdefghi")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    out = qr.judge(qr.measure(df))
    assert out.columns == [*df.columns, "_rule_counts", "_base_failed", "_kept"]
    assert all(tuple(r)[4:13] == tuple("abcdefghi") for r in out.collect())
    assert {r.doc_id: (r._base_failed, r._kept) for r in out.collect()} == {**{i: (False, True) for i in range(5)}, 9: (True, False)}
    assert qr.judge(qr.measure(df.limit(0))).count() == 0


def test_labelled_documents(spark):
    """Of the given tables every document labelled good that passes the fixed floor stays, and none labelled poor does."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = qr.query(spark, sf).join(labels, "doc_id").groupBy("quality", "base_failed", "kept").count().collect()
    n = {(r.quality, r.base_failed, r.kept): r["count"] for r in rows}
    assert n[1, False, True] > 3000 and (1, False, False) not in n and n[0, False, False] > 200 and not any(kept for q, _, kept in n if q == 0)
