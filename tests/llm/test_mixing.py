import pytest
from pyspark.sql import functions as F

from driftline.llm import common, mixing
from driftline.llm.common import materialize


def reshared(sizes):
    """Targets by the stated rule, step by step."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while free:
        w = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / w > 3 * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / w for s in free}
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= above
    return target


def test_against_the_rule(spark):
    docs = [(i, "w " * (i * 37 % 90 + 1), ["a", "b", None, "Z", "é"][0 if i % 3 else i % 5], "x") for i in range(2000)]
    docs += [(None, None, "a", "x"), (5, "", "b", "x"), (7, "one two", "tiny", "x"), (7, "one two", "tiny", "x"), (8, "  ", "empty", "x"), (9, "long " * 20_000, "a", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, taken string")
    keyed = materialize(mixing.with_keys(df.select("doc_id", "text", "source")), "t")
    rows = mixing.mix(keyed).collect()
    assert len(rows) == len(docs)
    sizes = {}
    for _, t, s, _ in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = reshared(sizes)
    for s in sizes:
        of = [r for r in rows if r.mix_source == s]
        assert {r.source_size for r in of} == {sizes[s]}
        assert of[0].target == pytest.approx(targets[s])
        assert sum(r.taken for r in of) == pytest.approx(targets[s], abs=0.51)
        assert all(0 <= r.taken <= 3 * r.mix_size for r in of)
        base = targets[s] // sizes[s] if sizes[s] else 0
        assert all(r.taken >= base * r.mix_size for r in of), "whole epochs come first"
        part = [r for r in of if base * r.mix_size < r.taken < (base + 1) * r.mix_size]
        assert len(part) <= 1
        full = [r.mix_key for r in of if r.taken >= (base + 1) * r.mix_size and r.mix_size]
        none = [r.mix_key for r in of if r.taken == base * r.mix_size and r.mix_size]
        assert not full or not none or max(full) <= min(none)
    assert sorted(map(str, mixing.mix(keyed).collect())) == sorted(map(str, rows))


def test_mixed_documents(spark):
    df = spark.createDataFrame([(i, f"a b c {i}", "s" if i < 90 else "t", "x") for i in range(100)], "doc_id long, text string, source string, mix_size string")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    by = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert by["t"] == 30 and abs(by["s"] - 70) <= 1


def test_equal_rows_and_null_ids_go_their_own_ways(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 5)
    monkeypatch.setattr(mixing, "RUN", 4)
    monkeypatch.setattr(common, "STEP", 50)
    docs = [(None, "a b", "s")] * 400 + [(None, f"c d {i}", "s") for i in range(200)] + [(i, "x y z", "t") for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(materialize(mixing.with_keys(df), "t")).collect()
    assert len(rows) == len(docs) and len({r.mix_key for r in rows}) == len(docs)
    equal = [r.taken for r in rows if r.mix_id is None and r.mix_size == 2]
    assert 0 < sum(t > 0 for t in equal) <= len(equal)
    for s, target in reshared({"s": 1400, "t": 150}).items():
        assert sum(r.taken for r in rows if r.mix_source == s) == pytest.approx(target, abs=0.51)
    out = mixing.mixed_documents(df)
    n = {r.text: r["count"] for r in out.groupBy("text").count().collect()}
    assert n["a b"] > 100 and sorted(map(str, out.collect())) == sorted(map(str, mixing.mixed_documents(df).collect()))


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed_documents(df).count() == 0


def test_ranges_stay_even_for_any_weights(spark):
    """Weights from 0.001 to 50, alike or mixed, keep the largest range under ten times the mean."""
    n = 40_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"), F.col("id"))
    mixed = F.when(F.col("id") % 3 == 0, 0.001).when(F.col("id") % 3 == 1, 1.0).otherwise(50.0)
    for weight in (F.lit(0.001), F.lit(0.05), F.lit(1.0), F.lit(50.0), mixed):
        placed = mixing.ranged(mixing.with_keys(docs, weight=weight))
        sizes = placed.groupBy("mix_range").agg(F.count("*").alias("n"), F.min("mix_key").alias("low"), F.max("mix_key").alias("high")).orderBy("mix_range").collect()
        assert sum(r.n for r in sizes) == n and max(r.n for r in sizes) <= 2 * mixing.RANGE
        assert all(a.high < b.low for a, b in zip(sizes, sizes[1:]))
