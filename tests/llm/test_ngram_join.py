import random
from collections import Counter

import pytest

from driftline.llm import ngram_join as nj
from driftline.llm.components import components


def grams(text):
    ws = (text or "").split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute(rows):
    g = [grams(t) for _, t, *_ in rows]
    near = [[j for j in range(len(rows)) if j != i and g[i] and 5 * len(g[i] & g[j]) >= 4 * len(g[i] | g[j])] for i in range(len(rows))]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        label[i] = min(ids) if ids else None
    return Counter((rows[i][0], label[i], len(near[i])) for i in range(len(rows)))


def made():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for i in range(150):
        rows.append([word() for _ in range(rng.randint(1, 200))])
    base = [word() for _ in range(120)]
    for _ in range(90):  # a large group of near copies
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        rows.append(w)
    for k in range(40):  # a chain: each near the next, ends far apart
        rows.append(base[2 * k :] + [f"tail{j}" for j in range(2 * k)])
    for i in range(60):
        w = list(rows[i])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        rows.append(w)
    texts = [" ".join(w) for w in rows] + ["", None, "  \n", "one two", "one  two", "a b c d e", "long " * 20_000] + [" ".join(rows[3])] * 40
    out = [(1000 - i, t, "x") for i, t in enumerate(texts)]
    return [*out, (None, " ".join(rows[5]), "x"), (None, "nobody else has this text", "x"), out[0], out[0]]


@pytest.mark.parametrize("split", [16, 256])
def test_against_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(nj, "SPLIT", split)
    monkeypatch.setattr(nj, "PACK", 20)
    rows = made()
    got = nj.links(spark.createDataFrame(rows, "doc_id long, text string, root string"))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == brute(rows)


def test_keep_one(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    out = nj.keep_one(df)
    assert out.columns == df.columns
    assert out.count() == len({c for _, c, _ in brute(rows)})


def test_a_chain_of_unlike_texts_is_compared_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(nj, "SPLIT", 8)
    seen = []
    monkeypatch.setattr(nj, "verify", lambda members, t, real=nj.verify: seen.append(members.groupBy("band").count().collect()) or real(members, t))
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base, rows = [word() for _ in range(60)], []
    for i in range(240):  # each near the few before it, the ends unlike
        base = [*base[2:], word(), word()]
        rows.append((i, " ".join(base)))
    got = nj.links(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == brute(rows)
    assert any(r.band >= 0 for r in seen[0])


def test_long_ids_beside_nulls(spark):
    rows = [(2**53 + 1, "one text of its own here", 1), (None, "another text that is quite unlike", 2), (2**53 + 3, "a third with nothing in common at all", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int").coalesce(1)
    assert {tuple(r) for r in nj.keep_one(df).collect()} == set(rows)
    assert {r.doc_id for r in nj.links(df).collect()} == {i for i, *_ in rows}


def test_the_row_that_stays_does_not_depend_on_order(spark):
    rows = [(7, "one text that is here more than once", x) for x in range(20)]
    kept = [nj.keep_one(spark.createDataFrame(r, "doc_id long, text string, x int")).collect() for r in (rows, rows[::-1])]
    assert kept[0] == kept[1] and len(kept[0]) == 1


def test_bands():
    for t in (0.5, 0.8, 0.9):
        b, r = nj.choose_bands(t)
        assert b * r <= nj.MOST_HASHES and 1 - (1 - t**r) ** b >= nj.RECALL or (b, r) == (nj.MOST_HASHES, 1)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 + rng.randrange(100), 5000 + rng.randrange(100)) for _ in range(120)] + [(9, 9), (-5, 7000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_rows(spark):
    assert nj.links(spark.createDataFrame([], "doc_id long, text string")).count() == 0
