import random
import sys

import pytest

sys.path.insert(0, ".")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxic_score double, doc string, text_ string, shard string"
CALM = ["river", "stone", "walking", "under", "evening", "quiet", "the", "of", "garden", "hill", "slow", "bread"]


def made():
    rng = random.Random(9)
    rows = []
    for i in range(160):
        ws = [rng.choice(CALM) + str(rng.randrange(60)) for _ in range(rng.randint(60, 140))]
        if i % 4 == 0:
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(["vilegrub", "vilegrubs"]))
        rows.append([i, " ".join(ws), "en", f"s{i % 3}"])
    rows += [[200, rows[1][1], "en", "s1"], [201, rows[2][1] + " more", "en", None], [None, rows[5][1] + " yet more", None, "s0"], [202, None, "en", "s1"], [203, "", None, None],
             [204, "spam ### " * 80, "en", "s2"], [2**53 + 1, " ".join(rows[7][1].split()[::-1]), "en", "s2"], list(rows[9]), list(rows[9])]
    return [(*r, len(r[1] or ""), 0.5, "d", "t", "sh") for r in rows]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(made(), SCHEMA).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


def test_stages_one_by_one(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages, seen = dict(corpus_pipeline.STAGES), {}
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, tables)
        assert out.columns == docs.columns, name
        path = f"{tables}/after-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = [r.doc_id for r in docs.collect()]
    assert not {202, 203, 204} & set(seen["quality_rules"]) and {1, 5, 200} <= set(seen["quality_rules"])
    left = [i for i in seen["toxicity"] if i is not None and i < 160]
    assert sum(i % 4 == 0 for i in left) <= 2 and sum(i % 4 != 0 for i in left) >= 110
    kept = seen["ngram_jaccard_join"]
    assert 1 in kept and 200 not in kept and kept.count(9) == 1 and (2**53 + 1) in kept
    assert (2 in kept) != (201 in kept) and (5 in kept) != (None in kept)
    assert set(seen["mixing"]) <= set(kept)
    tokens = stages["byte_bpe"](spark, docs, tables).collect()
    assert sorted(map(str, (r.doc_id for r in tokens))) == sorted(map(str, seen["mixing"])) and all(r.n_tokens > 0 for r in tokens)
    assert sorted(map(str, corpus_pipeline.run(spark, tables).collect())) == sorted(map(str, tokens))


def test_no_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0, name
