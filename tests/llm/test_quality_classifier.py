import zlib
import random

import pytest
from pyspark.sql import functions as F

from driftline.llm import quality_classifier as qc
from driftline.llm.common import id_fold

GOOD, BAD = ["river", "stone", "walking", "under", "evening", "quiet"], ["BUY!!", "###now", "$$$free", "|", "CLICK!!"]


def rows(n=160):
    rng = random.Random(1)
    return [(i, " ".join(rng.choices(GOOD if i % 3 else BAD, k=rng.randint(20, 60))), "x", int(i % 3 > 0)) for i in range(n)]


def test_held_out_accuracy(spark):
    made = rows()
    docs = spark.createDataFrame([(i, t, s) for i, t, s, _ in made] + [(None, "river stone", "x"), (1000, None, "x"), (1001, "", "x"), (1002, "river " * 50_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in made] + [(0, 0), (None, 1), (77_777, 1), (5, None)], "doc_id long, quality int")
    model = qc.fit(docs, labels, id_fold(F.col("doc_id"), 4) != 2)
    got = qc.score(docs, model, ["doc_id"], name="p").collect()
    assert len(got) == len(made) + 4 and all(0 <= r.p <= 1 for r in got)
    truth = {i: y for i, _, _, y in made}
    assert all((r.p >= 0.7) == bool(truth[r.doc_id]) for r in got if r.doc_id in truth)
    empty = {r.doc_id: r.p for r in got}
    assert empty[1000] == empty[1001]


def test_linear_form_is_the_average():
    model = qc.train([t for _, t, _, _ in rows(40)], [y for *_, y in rows(40)], epochs=2)
    text = "river BUY!! river\nriver BUY!! river"
    at = [b for w in qc.tokens(text) for b in qc.features(w)]
    z = sum(model[0][b] for b in at) / len(at) + model[1]
    assert qc.Scorer(model)([text])[0] == pytest.approx(1 / (1 + 2.718281828459045 ** -z))


def test_one_class_and_no_rows(spark):
    assert qc.Scorer(qc.train(["a b"], [1]))(["a b", ""]).tolist() == [0.5, 0.5]
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert qc.score(docs, qc.fit(docs, labels, F.lit(True)), ["doc_id"]).count() == 0


def test_held_out_fold_of_the_tables(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    got = qc.query(spark, "/root/testdata/sf0.1").join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.98 * len(held)


def test_markers():
    assert qc.tokens("a a b\nc d\nc d\n\n\na a b").count(qc.REPEAT) == 2
    assert qc.tokens("a a b\nc d\nc d\n\n\na a b").count(qc.LINE) == 5
