import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftline.llm import toxicity as tx
from driftline.llm.common import id_fold
from driftline.llm.labelled import sample

CALM, RUDE = ["river", "stone", "walking", "under", "evening", "quiet", "the", "of", "garden"], ["vilegrub", "vilegrubs", "vilegrubben"]


def rows(n=240):
    rng = random.Random(2)
    made = []
    for i in range(n):
        ws = rng.choices(CALM, k=rng.randint(20, 200))
        if i % 4 == 0:
            ws.insert(rng.randrange(len(ws)), rng.choice(RUDE))
        made.append((i, " ".join(ws), int(i % 4 == 0)))
    return made


def test_held_out_accuracy(spark):
    made = rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in made] + [(None, "river", "x"), (1000, None, "x"), (1001, "", "x"), (1002, "river " * 50_000 + "vilegrubbig", "x"), (3, made[3][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made] + [(None, 1), (9999, 1)], "doc_id long, toxic int")
    model = tx.fit(docs, labels, id_fold(F.col("doc_id"), 5) != 0)
    got = tx.score(docs, model, ["doc_id"], name="p").collect()
    assert len(got) == len(made) + 5
    truth = {i: y for i, _, y in made}
    assert sum((r.p >= 0.5) == bool(truth[r.doc_id]) for r in got if r.doc_id in truth) >= 239
    by = {r.doc_id: r.p for r in got}
    assert by[1000] == by[1001] < 0.5 < by[1002]


def direct(texts, word):
    """Kneser-Ney probabilities of a word by class, straight from the definition."""
    alphabet = {ch for docs in texts for t in docs for w in t for ch in f"{w}>"}
    edged = [[f"<{w}>" for t in docs for w in t] for docs in texts]

    def shared(gram):
        if not gram:
            return 1 / (len(alphabet) + 1)
        left = {}
        for s in edged[0] + edged[1]:
            for i in range(1, len(s)):
                g = s[max(0, i - len(gram) + 1) : i + 1]
                if len(g) == len(gram):
                    left.setdefault(g, set()).add(s[i - len(g)] if i >= len(g) else "")
        own = {g: len(x) for g, x in left.items() if g[:-1] == gram[:-1]}
        return shared(gram[1:]) if not own else (max(own.get(gram, 0) - 1, 0) + len(own) * shared(gram[1:])) / sum(own.values())

    out = []
    for docs, words in zip(texts, edged):
        p = 1.0
        for i in range(1, len(word) + 2):
            gram = f"<{word}>"[max(0, i - tx.ORDER + 1) : i + 1]
            own = Counter(s[max(0, j - tx.ORDER + 1) : j + 1] for s in words for j in range(1, len(s)))
            own = {g: n for g, n in own.items() if g[:-1] == gram[:-1]}
            p *= shared(gram[1:]) if not own else (max(own.get(gram, 0) - 1, 0) + len(own) * shared(gram[1:])) / sum(own.values())
        left = {pair for t in docs for pair in zip(["", *t], t)}
        mine = Counter(w for _, w in left)
        out.append((max(mine[word] - 1, 0) + len(mine) * p) / len(left))
    return out


def test_against_the_definition(monkeypatch):
    monkeypatch.setattr(tx, "ORDER", 4)
    texts = [[t.split() for _, t, y in rows(16) if y == c] for c in (0, 1)]
    models = tx.Models(texts)
    for word in ("river", "vilegrub", "vilegrubby", "rivers", "the", "zzz", "e"):
        for have, want in zip(models.words(word), direct(texts, word)):
            assert math.exp(have) == pytest.approx(want, rel=1e-9)
        ordinary, toxic = direct(texts, word)
        assert tx.Ratios(models).word(word) == pytest.approx(math.log(toxic / ordinary), abs=1e-9)


def test_the_query_names_its_folds(spark):
    got = tx.query(spark, "/root/testdata/sf0.001").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)


def test_held_out_recall_by_language(spark):
    rows_, labels = tx.query(spark, "/root/testdata/sf0.1").where("held_out"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang")
    got = rows_.join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").join(docs, "doc_id").collect()
    for langs in (("en",), ("de", "fr", "es")):
        toxic = [r for r in got if r.toxic and r.lang in langs]
        assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    calm = [r for r in got if not r.toxic]
    assert sum(r.predicted for r in calm) <= 0.01 * len(calm)


def test_an_id_repeated_often_is_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = sample(docs, labels, "toxic", F.lit(True), 10)
    assert sorted(zip(got["text"], got["label"])) == [("", 0), ("other", 0), ("text 0", 1)]
    assert len(sample(docs, labels, "toxic", F.lit(True), 10, most_bytes=6)) == 3 - 1


def test_lacking_class_and_no_rows(spark):
    assert tx.train(["a", "b"], [0, 0]) is None
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in tx.score(docs, tx.fit(docs, none, F.lit(True)), ["doc_id"]).collect()] == [0.0]
    assert tx.score(docs.limit(0), (None, 0.0), ["doc_id"]).count() == 0
