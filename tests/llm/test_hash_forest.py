import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from driftline.llm import hash_forest as hf


def brute(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            other = ids != i
            s = x[other] @ np.array(v)
            out[i] = [(int(ids[other][j]), s[j]) for j in np.lexsort((ids[other], -s))[:k]]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(found[q] & {i for i, _ in best}) / len(best) for q, best in want.items()])


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64)) + rng.standard_normal((10, 64))[rng.integers(0, 10, 3000)] * 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scaled:
        x *= rng.uniform(0.2, 3, (3000, 1))
    rows = [(i, [float(y) for y in np.float32(v)]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    want = brute(rows, 20)
    got = hf.search(hf.usable(df), F.col("vec_id") % 20 == 0, shard=700).collect()
    assert len(got) == 20 * len(want)
    assert recall(got, want) >= 0.9
    vectors = dict(rows)
    for r in got:
        assert r.score == pytest.approx(float(np.dot(vectors[r.query_id], vectors[r.vec_id])), abs=1e-9)
    for q in want:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id))


def test_odd_vectors_and_ties(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [1.0, 0.0, 0.0]), (20, [1.0, 0.0]), (8, [0.5, 0.5]), (8, [0.5, 0.5])]
    rows += [(100 + 7 * i, [1.0, 0.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hf.search(hf.usable(df), F.col("vec_id") % 20 == 0, k=5).collect()
    of = lambda q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
    assert of(0) == [(20, 1.0), (100, 1.0), (107, 1.0), (114, 1.0), (121, 1.0)]
    assert of(20)[0] == (0, 1.0) and of(240)[0] == (0, 1.0)
    few = hf.search(hf.usable(df.where("vec_id < 30")), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, 8), (0, 20), (20, 0), (20, 8)]
    assert hf.search(hf.usable(df.limit(0)), F.lit(True)).count() == 0


@pytest.mark.parametrize("lengths", [None, (0.8, 1.25), (0.2, 3)])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_given_tables(spark, sf, lengths):
    given = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet", columns=["vec_id", "embedding"])
    x = np.array(given["embedding"].to_pylist(), float)
    if lengths:
        x *= np.random.default_rng(5).uniform(*lengths, (len(x), 1))
    rows = list(zip(given["vec_id"].to_pylist(), x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = hf.search(hf.usable(df), F.col("vec_id") % 20 == 0).collect(), brute(rows, 20)
    assert len(got) == 20 * len(want)
    found = recall(got, want)
    print(sf, lengths, round(found, 4))
    assert found >= 0.9


def test_a_forest_is_built_once_a_shard(spark, tmp_path):
    """However many blocks its queries come in."""
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((900, 8)))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = hf.search(hf.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), F.lit(True), k=5, share=1.0, shard=400).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    ids, x = np.arange(900), np.array([v for _, v in rows])
    scores = x @ x.T
    for r in got:
        own = np.where(ids == r.query_id, -np.inf, scores[r.query_id])
        assert r.vec_id == np.argsort(-own, kind="stable")[r.rank - 1]
    assert len(got) == 4500


def test_bands():
    lengths = np.array([1.0, 0.85, 4.0, 3.9, 1.0, 0.1])
    assert [b.tolist() for b in hf.bands(lengths, 1)] == [[2, 3], [0, 4, 1], [5]]
    assert [b.tolist() for b in hf.bands(lengths, 4)] == [[2, 3, 0, 4], [1, 5]]
    assert hf.bands(lengths[:0], 4) == []
