import json
import random
import uuid
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from driftline.llm import token_store as ts
from driftline.llm.common import shared_dir

VOCAB = P.path("word_bpe_49k.json")


def texts():
    rng = random.Random(3)
    vocab = ["hello", "WORLD", "it's", "über", "ΣΑΣ", "日本", "12", "!?", "a\x1cb", "é", "x y", "<|endoftext|>", "<|startoftext|>z", "🙂", "\x85"]
    many = [rng.choice([" ", "\n", "\t ", "\x0b"]).join(rng.choices(vocab, k=rng.randint(1, 300))) for _ in range(40)]
    long = " ".join(rng.choices(vocab[:9], k=30_000))
    return [None, "", "  ", *many, many[0], many[0], long, "again " * 12_000]


def test_store(spark):
    t = Tokenizer.from_file(VOCAB)
    rows = [(i * 7 % 50 - 3, x, "clash") for i, x in enumerate(texts())] + [(None, "no id", "y")] * 3
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    ts.write(spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(5), path, VOCAB)
    got = sorted(ts.checksums(spark, path).collect(), key=lambda r: r.start)
    whole = {(r.start): np.frombuffer(r.ids, "<u4").tolist() for r in ts.documents(spark, path).collect()}
    want = {}
    for i, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want.setdefault(i, []).append(ids)
    ids_in_order = [r.doc_id for r in got]
    assert ids_in_order == sorted(ids_in_order, key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r.start == at and whole[r.start] in want[r.doc_id]
        assert r.n_tokens == len(whole[r.start]) and r.ids_crc32 == zlib.crc32(np.array(whole[r.start], "<u4").tobytes())
        want[r.doc_id].remove(whole[r.start])
        at += r.n_tokens
    assert not any(want.values())
    assert ts.broken_parts(spark, path).count() == 0 and ts.store_root(spark, path).first().n_tokens == at
    kept = ts.chunks(spark, path)
    assert kept.count() == kept.select("digest").distinct().count()


def test_swapped_chunks_raise(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60 * i + 1))) for i in range(20)]
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    ts.write(spark.createDataFrame(rows, "doc_id long, text string"), path, VOCAB)
    kept = ts.recipes(spark, path).collect()
    spoiled = [r.asDict() for r in kept]
    many = next(r for r in spoiled if len(r["digests"]) >= 32 and r["digests"][:16] != r["digests"][16:32])
    many["digests"] = many["digests"][16:32] + many["digests"][:16] + many["digests"][32:]
    spark.createDataFrame([tuple(r.values()) for r in spoiled], ts.RECIPES).write.mode("overwrite").parquet(f"{path}/recipes")
    assert ts.broken_parts(spark, path).count() == 1
    with pytest.raises(Exception, match="root in the manifest"):
        ts.checksums(spark, path).collect()
    with pytest.raises(Exception, match="root in the manifest"):
        ts.documents(spark, path).collect()


def test_a_file_with_other_settings_goes_through_the_library(tmp_path):
    whole = json.load(open(VOCAB))
    whole["normalizer"] = None
    other = str(tmp_path / "other.json")
    json.dump(whole, open(other, "w"))
    encoder, own = ts.WordEncoder(other), Tokenizer.from_file(other)
    for x in ("Hello WORLD", "", "it's  12 é"):
        assert np.frombuffer(encoder.encode([x.encode()])[0], "<u4").tolist() == own.encode(x, add_special_tokens=False).ids
    assert isinstance(ts.WordEncoder(VOCAB).words, ts._Words)


def test_shared_passages_share_chunks(spark):
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 40_000, 20_000, dtype=np.uint32)
    a, b = (np.concatenate([rng.integers(0, 40_000, n, dtype=np.uint32), passage]) for n in (100, 333))
    cut = [set(x[s:e].tobytes() for s, e in zip([0, *ends], ends)) for x in (a, b) for ends in [ts.chunk_ends(x, np.array([len(x)])).tolist()]]
    assert len(cut[0] & cut[1]) > 0.8 * len(cut[0])
    same = np.zeros(50_000, np.uint32)
    assert np.diff(ts.chunk_ends(same, np.array([50_000])), prepend=0).max() <= ts.LONGEST


def test_a_task_of_few_ids(spark):
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    ts.write(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").repartition(2, "doc_id"), path, VOCAB)
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in ts.checksums(spark, path).collect()) == [(1, 0, 3), (2, 3, 1)]


def test_no_rows(spark):
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    ts.write(spark.createDataFrame([], "doc_id long, text string"), path, VOCAB)
    assert ts.checksums(spark, path).count() == 0
