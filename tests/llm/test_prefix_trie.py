import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from driftline.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, base int, members string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in rebuilt(rows).items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        own = len(node[-1][1]) if node else 0
        saved[node] = (len(members[node]) - 1) * own + sum(saved[k] for k in kids[node])
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in pt.trie(df).collect())


def conversations(seed, ids, most=9, texts=("a", "bb", "ccc", "", None, "é😀")):
    rng = random.Random(seed)
    rows = []
    for c in ids:
        for t in range(rng.randrange(most + 1)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


CASES = {
    "families": conversations(1, [*range(0, 12), *range(100, 130), 205, 250, 300, 399, 100_000, 100_001]),
    "negative ids": conversations(2, [-205, -200, -150, -100, -99, -1, 0, 1, 99, 100]),
    "few texts, many nodes shared": conversations(3, range(0, 2500, 7), texts=("a",)),
    "repeated rows and null ids": conversations(4, [3, 3, 3, None, None, 100, 104]) * 3,
    "one conversation": [(7, 0, "user", "hello")],
    "turnless": [(c, 0, "user", "x") for c in range(101, 160)],
}


@pytest.mark.parametrize("name", CASES)
def test_against_brute_force(spark, name):
    assert found(spark, CASES[name]) == brute(CASES[name])


def test_deep_conversations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 5)
    monkeypatch.setattr(pt, "RUN", 100)
    rows = conversations(5, [0, 1, 2, 3, 100, 101, 250], most=14, texts=("a", "b")) + [(c, t, "user", "same") for c in (40, 140, 300, 301, 44) for t in range(20)]
    assert found(spark, rows) == brute(rows)


def test_ends_of_many_runs(spark, monkeypatch):
    monkeypatch.setattr(pt, "RUN", 100)
    rows = [(c, t, "user", f"t{t}") for c in range(0, 1500, 3) for t in range(7)]
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []
