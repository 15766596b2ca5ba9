import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from driftline.llm import language_model as lm


def words(text):
    return [w.decode() for w in lm.tokenize(text or "")] + ["<end>"]


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10


def made():
    rng = random.Random(4)
    chain = {w: rng.sample(range(40), 3) for w in range(40)}
    rows = []
    for i in range(400):
        w, out = rng.randrange(40), []
        for _ in range(rng.randint(1, 60)):
            out.append(f"W{w}é")
            w = rng.choice(chain[w])
        rows.append((i, " ".join(out), "x"))
    return [*rows, (500, None, "x"), (501, "", "x"), (None, "W1é unseen", "x"), (502, "zzz " * 30_000, "x"), (7, rows[7][1], "x"), (10, "ÀB ab", "x")]


def brute(rows):
    """Trigram scores with weights by plain expectation-maximisation over single tokens."""
    train = [words(t) for i, t, _ in rows if fold(i) != 0]
    tune = [words(t) for i, t, _ in rows if fold(i) == 1]

    def count(docs):
        grams = [Counter(), Counter(), Counter()]
        for d in docs:
            padded = ["<end>", "<end>", *d]
            for k in range(3):
                grams[k].update(tuple(padded[i - k : i + 1]) for i in range(2, len(padded)))
        return grams

    whole, held = count(train), count(tune)
    n, v = sum(whole[0].values()), len(whole[0])

    def facts(d, grams, total):
        padded = ["<end>", "<end>", *d]
        ends = grams[0]["<end>",]
        for i in range(2, len(padded)):
            u, x, w = padded[i - 2 : i + 1]
            c3, c2 = (ends if x == "<end>" else grams[1][u, x]), grams[0][x,]
            yield (int(2 * math.log2(c3 + 1)), int(2 * math.log2(c2 + 1)), grams[2][u, x, w] / max(c3, 1), grams[1][x, w] / max(c2, 1), grams[0][w,] / total)

    def p(weights, f):
        a, b, g = weights
        p1 = g * f[4] + (1 - g) / (v + 1)
        p2 = b[f[1]] * f[3] + (1 - b[f[1]]) * p1
        return p1, p2, a[f[0]] * f[2] + (1 - a[f[0]]) * p2

    rest = [x - y for x, y in zip(whole, held)]
    seen = [f for d in tune for f in facts(d, rest, n - sum(held[0].values()))]
    weights = [0.3 * (i > 0) for i in range(lm.BUCKETS)], [0.3 * (i > 0) for i in range(lm.BUCKETS)], 0.9
    for _ in range(lm.ROUNDS):
        hits, asks = Counter(), Counter()
        for f in seen:
            p1, p2, p3 = p(weights, f)
            r3 = weights[0][f[0]] * f[2] / p3
            r2 = (1 - r3) * weights[1][f[1]] * f[3] / p2
            for key, hit, ask in ((("a", f[0]), r3, 1), (("b", f[1]), r2, 1 - r3), ("g", (1 - r3 - r2) * weights[2] * f[4] / p1, 1 - r3 - r2)):
                hits[key] += hit
                asks[key] += ask
        new = []
        for name in "ab":
            last, own = 0.3, [0.0]
            for i in range(1, lm.BUCKETS):
                if asks[name, i] > 0:
                    last = min(max(hits[name, i] / asks[name, i], 1e-4), 1 - 1e-4)
                own.append(last)
            new.append(own)
        weights = (*new, min(max(hits["g"] / asks["g"], 1e-4), 1 - 1e-4))
    out = Counter()
    for i, t, _ in rows:
        d = words(t)
        base = sum(math.log10((whole[0][w,] + 0.1) / (n + 0.1 * (v + 1))) for w in d)
        score = sum(math.log10(p(weights, f)[2]) for f in facts(d, whole, n))
        out[i, fold(i) == 0, len(d), sum(whole[0][w,] > 0 for w in d), n, round(base, 5), round(score, 5)] += 1
    return out


@pytest.mark.parametrize(("block", "part", "bits"), [(300, 64, 2), (900, 256, 3), (2_000_000, 8 << 20, 8)])
def test_against_brute_force(spark, monkeypatch, block, part, bits):
    for name, value in (("BLOCK", block), ("PART_BYTES", part * 64 if block < 1000 else part), ("LEVEL_BITS", bits), ("ROUNDS", 4)):
        monkeypatch.setattr(lm, name, value)
    rows = made()
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)).collect()
    have = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got)
    assert have == brute(rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_long_ids_beside_nulls(spark):
    rows = [(2**53 + 1, "a b"), (None, "c"), (2**53 + 3, "d " * 50)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}


@pytest.mark.parametrize("n", [1, 6, 7, 8, 20, 21])
def test_slices_of_tokens_are_the_whole(monkeypatch, n):
    from types import SimpleNamespace

    tokens = np.array([1 + i % 3 if i % 5 else 0 for i in range(1, n)] + [0], np.uint32)
    ends = np.flatnonzero(tokens == 0) + 1
    row = SimpleNamespace(tokens=lm._planes(tokens, 4), lengths=np.diff(ends, prepend=0).astype("<u4").tobytes(), held=bytes(len(ends)), vocab=np.arange(10, 14, dtype=np.uint64).tobytes())
    block = lm.Block(row)
    whole = [np.concatenate(x) for x in zip(*(seen for _, seen in block.seen(block.counts())))]
    monkeypatch.setattr(lm, "SLICE", 7)
    cut = [np.concatenate(x) for x in zip(*(seen for _, seen in block.seen(block.counts())))]
    assert all((a == b).all() for a, b in zip(whole, cut)) and len(whole[0]) == n


def test_counts_over_32_bits():
    x = np.array([0, 1, 2**40, 2**33 + 5], np.int64)
    assert lm._numbers(lm._planes(x)).tolist() == x.tolist()
    keys = np.array([5, 9, 2**63, 2**64 - 1], np.uint64)
    assert lm._unpacked(lm._packed(keys)).tolist() == keys.tolist() and lm._unpacked(lm._packed(keys[3:])).tolist() == [2**64 - 1]


def test_no_rows_and_nothing_to_learn_from(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = [i for i in range(200) if fold(i) == 0][:3]
    rows = lm.score(spark.createDataFrame([(i, "a b") for i in out], "doc_id long, text string")).collect()
    assert [(r.train_tokens, r.n_known, r.score, r.base_score) for r in rows] == [(0, 0, 0.0, 0.0)] * 3
