import random
import time

import pytest

from driftline import catalog
from driftline.operators import lines
from pyspark.sql import functions as F


def longest(a, b):
    """Ops by the plain recurrence over all cells."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append(("ctx", i, j))
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[i + 1][j] >= best[i][j + 1]):
            out.append(("del", i, None))
            i += 1
        else:
            out.append(("add", None, j))
            j += 1
    return out


def ends_only(a, b):
    h = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    x, y = a[h:], b[h:]
    t = next((i for i, (p, q) in enumerate(zip(x[::-1], y[::-1])) if p != q), min(len(x), len(y)))
    return ([("ctx", i, i) for i in range(h)] + [("del", i, None) for i in range(h, len(a) - t)] + [("add", None, j) for j in range(h, len(b) - t)]
            + [("ctx", len(a) - t + i, len(b) - t + i) for i in range(t)])


def runs(ops):
    out = []
    for op in ops:
        if op[0] == "ctx" or not out or out[-1][0][0] == "ctx":
            out.append([])
        out[-1].append(op)
    return out


def best_total(old, new):
    """The largest total similarity of pairs in order, over all choices."""
    if not old or not new:
        return 0.0
    s = lines.similarity(old[0], new[0])
    return max(best_total(old[1:], new), best_total(old, new[1:]), s + best_total(old[1:], new[1:]) if s >= 0.5 else 0.0)


def fixture(seed):
    rng, out = random.Random(seed), []
    for k in range(40):
        old = [rng.choice(["", "alpha beta", "gamma delta", "x", f"line {rng.randrange(5)} of text"]) for _ in range(rng.randrange(9))]
        new = []
        for x in old:
            new += rng.choice([[x], [x], [x], [x.replace("a", "e")], [], [x, "more"], [x + "!"]])
        out.append((k, old, new or [""]))
    same = [f"kept {i}" for i in range(100)]
    out.append((40, [y for x in same for y in (x, f"{x} tail a")], [y for x in same for y in (x, f"{x} tail e")]))
    return out


@pytest.mark.parametrize("cells", [lines.ALIGN_CELLS, 12])
def test_aligned(spark, cells):
    data = fixture(3)
    got = {}
    for r in sorted(lines.aligned(spark.createDataFrame(data, "k long, old array<string>, new array<string>"), "k", "old", "new", cells).collect(), key=lambda r: (r.k, r.pos)):
        got.setdefault(r.k, []).append((r.type, r.change_no, r.left, r.right))
    for k, old, new in data:
        rows, no = list(got.get(k, [])), 0
        assert [x for t, _, x, _ in rows if t != "add"] == old and len([y for t, _, _, y in rows if t != "del"]) == len(new)
        for run in runs((longest if len(old) * len(new) <= cells else ends_only)(old, new)):
            if run[0][0] == "ctx":
                assert rows.pop(0) == ("ctx", None, old[run[0][1]], new[run[0][2]])
                continue
            no += 1
            dels, adds = [old[i] for op, i, _ in run if op == "del"], [new[j] for op, _, j in run if op == "add"]
            mine = [rows.pop(0) for _ in range(len([r for r in rows if r[1] == no]))]
            assert {r[1] for r in mine} == {no} and [x for t, _, x, _ in mine if t != "add"] == dels
            assert sorted(y for t, _, _, y in mine if t != "del") == sorted(adds)
            if len(dels) + len(adds) <= 16:
                assert sum(lines.similarity(x, y) for t, _, x, y in mine if t == "rep") == pytest.approx(best_total(dels, adds))
        assert not rows
    if cells > 12:
        assert [t for t, *_ in got[40]] == ["ctx", "rep"] * 100


def test_blocks_and_folds_of_longest_subsequence(spark):
    data = fixture(4)
    ops = lines.lcs_diff(spark.createDataFrame(data, "k long, old array<string>, new array<string>"), "k", "old", "new")
    got = {(r.k, r.change_no): (r.type, r.old_start, r.old_end, r.new_start, r.new_end, r.old_lines, r.new_lines) for r in lines.change_blocks(ops, "k").collect()}
    shown = {}
    for r in lines.fold_context(ops, "k").collect():
        shown[r.k] = shown.get(r.k, 0) + r["count"]
    want = {}
    for k, old, new in data:
        mine = longest(old, new)
        assert shown.get(k, 0) == len(mine)
        for no, run in enumerate([r for r in runs(mine) if r[0][0] != "ctx"], 1):
            i, j = [i for op, i, _ in run if op == "del"], [j for op, _, j in run if op == "add"]
            of = lambda x: (x[0] + 1, x[-1] + 1) if x else (0, 0)
            want[k, no] = ("MODIFIED" if i and j else "DELETED" if i else "ADDED", *of(i), *of(j), [old[x] for x in i], [new[x] for x in j])
    assert got == want
    assert len([1 for k, _ in want if k == 40]) == 100


def test_queries_keep_unchanged_lines_inside_changes(spark):
    """Documents with replaced letters hold unchanged lines between changes: several runs, and context on both sides of them."""
    rows = catalog.QUERIES["aligned_pairs"](spark, "/root/testdata/sf0.001").where("doc_id % 4 = 3").collect()
    own = {}
    for r in rows:
        own.setdefault(r.doc_id, set()).add(r.change_no)
        assert (r.type == "ctx") == (r.change_no is None) and (r.left == r.right) == (r.type == "ctx")
    assert any(len(x - {None}) > 1 for x in own.values())
    blocks = catalog.QUERIES["lcs_change_blocks"](spark, "/root/testdata/sf0.001").where("doc_id % 4 = 3").collect()
    assert {(r.doc_id, r.change_no) for r in blocks} == {(k, n) for k, x in own.items() for n in x if n}


def test_duplicate_passages(spark):
    """All links between places, against windows compared one by one."""
    rng = random.Random(7)
    parts = [[f"part {p} line {i}" for i in range(n)] for p, n in enumerate((12, 15, 11, 4))] + [["same same"] * 13]
    texts = {k: [y for _ in range(rng.randrange(1, 4)) for y in [*rng.choice(parts), *rng.choice([[], ["}"], [f"own {rng.random()}"]])]] for k in range(30)}
    data = [(k, i, x) for k, t in texts.items() for i, x in enumerate(t, 1)]
    df = spark.createDataFrame(data, "doc_id long, line_no int, text string")
    windows = {}
    for k, t in texts.items():
        valid = [(i, x) for i, x in enumerate(t, 1) if x != "}"]
        before = None
        for s in range(len(valid) - 9):
            norm = tuple(x.replace(".", " . ") for _, x in valid[s : s + 10])
            if norm == before:
                windows[norm][-1][2] += 1
                windows[norm][-1][3] = valid[s + 9][0]
            else:
                windows.setdefault(norm, []).append([k, valid[s][0], 10, valid[s + 9][0]])
            before = norm
    rows = lines.duplicate_windows(df, "doc_id").collect()
    of = {}
    for r in rows:
        of.setdefault(r.passage, []).append(r)
    assert all(len(x) == x[0].places > 1 for x in of.values())
    covered = lambda r, place: r.doc_id == place[0] and r["first"] <= place[1] and place[3] <= r["last"]
    shared = [x for x in windows.values() if len(x) > 1]
    assert shared
    for places in shared:
        assert any(len(x) == len(places) and all(any(covered(r, place) for r in x) for place in places) for x in of.values())
    assert sum(len(x) for x in shared) >= len(rows)
    pairs = [min(a[2], b[2]) for x in shared for i, a in enumerate(x) for b in x[i + 1 :]]
    assert lines.duplicate_total(df, "doc_id").first() == (len(pairs), sum(pairs))


def test_rows_of_bits_take_the_same_way(monkeypatch):
    """Rows of bits have the operations that whole rows of lengths have, ties too, in a small part of the time."""
    rng = random.Random(9)
    pairs = [tuple("".join(rng.choices("abcd"[: rng.randint(1, 4)], k=rng.randint(0, 70))) for _ in range(2)) for _ in range(300)] + [tuple("".join(rng.choices("abcdefgh", k=200)) for _ in range(2)) for _ in range(20)]
    took = {}
    found = {}
    for bits in (0, lines.BITS):
        monkeypatch.setattr(lines, "BITS", bits)
        began = time.process_time()
        found[bits] = [lines._lcs(list(a), list(b), None) for a, b in pairs]
        took[bits] = time.process_time() - began
    first, second = found.values()
    assert first == second
    slow, fast = took.values()
    assert fast < slow / 2, took


def test_counts_are_those_of_the_lines(spark):
    """Lines counted in tasks are as many as lcs_diff has, by keys of any type, beyond the cells too; no lines, no row."""
    sides = [([], []), (None, None), (["a"], None), ([], ["b", "c"]), (["a", "b", "c", "a"], ["b", "a", "c", "c"]), ([str(i % 3) for i in range(50)], [str(i % 4) for i in range(45)])]
    df = spark.createDataFrame([((f"k{i}", i), o, n) for i, (o, n) in enumerate(sides)], "key struct<name:string,no:int>, o array<string>, n array<string>")
    for cells in (lines.CELLS, 100):
        ops = lines.lcs_diff(df, "key", "o", "n", cells=cells).groupBy("key").agg(*[F.count_if(F.col("op") == op).alias(c) for op, c in (("ctx", "same"), ("del", "deleted"), ("add", "added"))])
        got = sorted(map(tuple, lines.lcs_counts(df, "key", "o", "n", cells=cells).collect()))
        assert got == sorted(map(tuple, ops.collect())) and len(got) == 4


def as_runs(ops):
    out = []
    for op, i, j in ops:
        t, k = {"ctx": ("eq", i), "del": ("del", i), "add": ("add", j)}[op]
        if out and out[-1][0] == t:
            k, out = out[-1][1], out[:-1]
        out.append((t, k, (j if t == "add" else i) + 1))
    return out


@pytest.mark.parametrize("mode", ["char", "word"])
def test_long_lines_are_compared_as_short_ones(spark, mode):
    """Pieces are those of the plain recurrence, however long the lines; one changed letter in many places stays that."""
    rng = random.Random(11)
    some = lambda n: rng.choices(["a", "b", "c", "d"] if mode == "char" else ["one", "two", "three", "f"], k=n)
    join = ("" if mode == "char" else " ").join
    kept = some(500)
    pairs = [(some(260), some(330)), (some(480), some(470)), (kept, ["e" if x in ("a", "one") else x for x in kept]), (kept, [x for x in kept if x not in ("b", "two")])]
    rows = [(k, *(join([mark, *side, mark]) for mark, side in zip("xy", pair))) for k, pair in enumerate(pairs)]
    got = spark.createDataFrame(rows, "k long, a string, b string").select("k", lines.inline(F.col("a"), F.col("b"), mode).alias("s")).collect()
    for r in got:
        _, a, b = rows[r.k]
        a, b = (list(t) if mode == "char" else [y for x in t.split(" ") for y in (x, " ")][:-1] for t in (a, b))
        want = [(t, "".join((b if t == "add" else a)[lo:hi])) for t, lo, hi in as_runs(longest(a, b))]
        assert [(x.t, x.s) for x in r.s] == want
        assert len(want) > 50


def test_runs_by_count_take_the_same_way():
    """Where numbers of elements decide, they have the operations of the recurrence; replaced and left out letters are decided by them."""
    rng, decided = random.Random(12), 0
    for k in range(600):
        a = "".join(rng.choices("abcdef"[: rng.randint(1, 6)], k=rng.randint(0, 40)))
        b = [a.replace("a", "e"), a.replace("b", ""), "".join(rng.choices("abcdef"[: rng.randint(1, 6)], k=rng.randint(0, 40)))][k % 3]
        for x, y in ((a, b), (list(a), list(b))):
            runs = lines._runs_by_count(x, y)
            assert runs is None and k % 3 == 2 or runs == as_runs(longest(x, y))
        decided += k % 3 == 2 and runs is not None
    assert 0 < decided < 200


def test_rows_of_bits_made_again(monkeypatch):
    """Rows that are not held are made again, with the same operations."""
    rng = random.Random(13)
    pairs = [tuple("".join(rng.choices("abcdefgh"[: rng.randint(1, 8)], k=rng.randint(1, 90))) for _ in range(2)) for _ in range(200)]
    want = [lines._lcs_bits(list(a), list(b)) for a, b in pairs]
    for held in (1, 500):
        monkeypatch.setattr(lines, "HELD", held)
        assert [lines._lcs_bits(list(a), list(b)) for a, b in pairs] == want
    assert want == [[(op, i, -1 if j is None else j) if op == "del" else (op, -1 if i is None else i, j) for op, i, j in longest(a, b)] for a, b in pairs]
