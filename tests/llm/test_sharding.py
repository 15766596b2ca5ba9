from collections import defaultdict

from driftline.llm import common
from driftline.llm import sharding as sh
from driftline.llm.common import materialize


def brute(rows, limit):
    """Split by bits, bucket by bucket."""
    done = {}

    def split(bucket, depth):
        if sum(r.n_bytes for r in bucket) <= limit or len(bucket) <= 1 or depth == sh.BITS:
            for r in bucket:
                done[r.h] = format(r.h >> (sh.BITS - depth), f"0{depth}b") if depth else ""
            return
        halves = defaultdict(list)
        for r in bucket:
            halves[(r.h >> (sh.BITS - depth - 1)) & 1].append(r)
        for half in halves.values():
            split(half, depth + 1)

    split(rows, 0)
    return done


def test_against_splitting(spark):
    docs = [(i, "x" * (i * 53 % 400), "c") for i in range(700)] + [(1, "same", "c")] * 300 + [(None, None, "c")] * 50 + [(7, "y" * 30_000, "c"), (None, "", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, shard string")
    rows = materialize(sh.hashed(df), "t")
    assert rows.count() == len(docs) and rows.select("h").distinct().count() == len(docs)
    for limit in (1 << 30, 20_000, 900, 100, 1):
        got = sh.assign(rows, limit).collect()
        assert len(got) == len(docs)
        assert {r.h: r.shard for r in got} == brute(got, limit)
        size, n = defaultdict(int), defaultdict(int)
        for r in got:
            size[r.shard] += r.n_bytes
            n[r.shard] += 1
        assert all(size[s] <= limit or n[s] == 1 for s in size)
        assert all(r.shard_bytes == size[r.shard] for r in got)


def test_whole_documents(spark):
    df = spark.createDataFrame([(i % 90, "t" * (i % 90), "c") for i in range(300)], "doc_id long, text string, depth string")
    out = sh.shard_documents(df, 500)
    assert out.columns == [*df.columns, "shard"]
    assert sorted(map(tuple, out.drop("shard").collect())) == sorted(map(tuple, df.collect()))
    path = f"{spark.conf.get('spark.checkpoint.dir')}/shards"
    sh.write_shards(df, path, 500)
    assert spark.read.parquet(path).count() == 300


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a", 5, "s"), (1, "a", 5, "s"), (2, "b", 6, "t")], "doc_id long, text string, _copies int, shard string")
    out = sh.shard_documents(df, 1)
    assert out.columns == [*df.columns, "_shard"]
    assert sorted(map(tuple, out.drop("_shard").collect())) == sorted(map(tuple, df.collect()))
    assert out.select("_shard").distinct().count() == 3


def test_runs_of_equal_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "STEP", 100)
    df = spark.createDataFrame([(1, "same")] * 1050 + [(None, None)] * 77, "doc_id long, text string")
    rows = sh.hashed(df).collect()
    assert sorted(r.ordinal for r in rows if r.doc_id == 1) == list(range(1, 1051)) and len(rows) == 1127
    assert len({r.h for r in rows}) == 1127


def test_no_rows(spark):
    assert sh.assign(materialize(sh.hashed(spark.createDataFrame([], "doc_id long, text string")), "t")).count() == 0
