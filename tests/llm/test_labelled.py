from pyspark.sql import functions as F

from driftline.llm import labelled

DOCS = "doc_id long, text string, label string, draw string"


def test_a_huge_text_costs_no_class(spark):
    """Whichever text is drawn first, one that doesn't fit leaves room for the others."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    for huge in range(12):
        docs = spark.createDataFrame([(i, "x" * 5000 if i == huge else f"text {i}", "a", "b") for i in range(12)], DOCS)
        found = labelled.sample(docs, labels, "quality", F.lit(True), 100, 1000)
        assert sorted(found["label"]) == sorted(i % 2 for i in range(12) if i != huge)


def test_bytes_are_bounded_and_order_is_fixed(spark):
    docs = spark.createDataFrame([(i, "é" * (5 + i % 7), None, None) for i in range(200)] + [(3, "a smaller one", "x", "y")], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    a, b = (labelled.sample(docs.repartition(n), labels.repartition(n), "quality", F.lit(True), 40, 500) for n in (1, 5))
    assert a.equals(b)
    for c in (0, 1):
        own = a[a["label"] == c]["text"]
        assert 0 < len(own) <= 40 and sum(len(t.encode()) for t in own) <= 500


def test_nothing_to_draw(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert len(labelled.sample(docs, labels, "quality", F.lit(True), 10)) == 0
