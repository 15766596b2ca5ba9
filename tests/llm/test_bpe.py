import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from driftline.llm import bpe

VOCAB = P.path("byte_bpe_multi_50k.tiktoken")


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    parts = ["hello", " world", "'s", "  ", "\n\n", "123", "über", "日本", " !?", "\x1c", "\x85", "\xa0", "é", "🙂", "\t", " ", "Σας", " ٣٤", "'ll", "<|endoftext|>"]
    made = ["".join(rng.choices(parts, k=rng.randint(1, 400))) for _ in range(60)]
    return ["", None, " ", "\n", "a" * 900, " " * 700, "1" * 333, "a" * 100 + " " * 300 + "b" * 50, *made, made[0], made[0]]


@pytest.mark.parametrize(("stride", "overlap"), [(40, 24), (200, 60), (16384, 1024)])
def test_as_the_library(spark, stride, overlap):
    rows = list(enumerate(texts()))
    own = encoding()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode(docs, VOCAB, P.PATTERN, stride=stride, overlap=overlap).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = own.encode_ordinary(t or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want, repr(t)
        assert got[i].n_tokens == len(want)
        assert got[i].decoded == (t or "")


def test_digests_and_decode(spark):
    docs = spark.createDataFrame([(1, "some text"), (None, "x"), (1, "some text"), (2, None)], "doc_id long, text string")
    rows = sorted(bpe.digests(docs).collect(), key=str)
    assert len(rows) == 4 and {r.doc_id for r in rows} == {1, 2, None}
    own = encoding()
    r = next(r for r in rows if r.doc_id == 1)
    assert r.ids_sha256 == hashlib.sha256(np.array(own.encode_ordinary("some text"), "<u4").tobytes()).hexdigest()
    assert r.decoded_sha256 == hashlib.sha256(b"some text").hexdigest()
    again = bpe.decode(bpe.encode(docs, VOCAB, P.PATTERN), VOCAB, P.PATTERN)
    assert {bytes(r.bytes) for r in again.collect()} == {b"some text", b"x", b""}


def test_long_ids_beside_nulls(spark):
    rows = [(2**53 + 1, "a"), (None, "b"), (2**53 + 3, "c " * 20_000), (-(2**63), None)]
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}


def test_no_rows(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
