"""Line differences and what is shown of them."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CELLS, ALIGN_CELLS = 5_000_000, 6_000_000
#: Least similarity of paired lines, and the most lines of a run that is paired.
SIMILAR, RUN = 0.5, 80


def common_ends(old: Column, new: Column) -> Column:
    """A struct (head, tail): how many first and last elements two arrays share; the tail doesn't overlap the head."""
    n = F.least(F.size(old), F.size(new))

    def first_unlike(a: Column, b: Column, most: Column) -> Column:
        unlike = F.filter(F.sequence(F.lit(0), F.greatest(most - 1, F.lit(0))), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
        return F.when(most <= 0, 0).otherwise(F.coalesce(F.array_min(unlike), most))

    head = first_unlike(old, new, n)
    with_head = F.transform(F.array(head), lambda h: F.struct(h.alias("head"), first_unlike(F.reverse(old), F.reverse(new), n - h).alias("tail")))
    return F.element_at(with_head, 1)


def linear_diff(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, pos, op, old_no, new_no, text): the common head, all other old lines, all other new lines, the common tail. old and new are arrays of lines."""
    ends = df.select(key, old, new, common_ends(F.col(old), F.col(new)).alias("e"))
    n, m = F.size(old), F.size(new)
    head, tail = F.col("e.head"), F.col("e.tail")

    def part(lo: Column, count: Column, op: str, side: str, old_no, new_no) -> Column:
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.struct(
            F.lit(op).alias("op"), (old_no(lo + i) if old_no else F.lit(None)).cast("int").alias("old_no"), (new_no(lo + i) if new_no else F.lit(None)).cast("int").alias("new_no"), F.get(F.col(side), lo + i).alias("text")))).otherwise(F.array())

    rows = F.concat(
        part(F.lit(0), head, "ctx", old, lambda i: i + 1, lambda i: i + 1), part(head, n - tail - head, "del", old, lambda i: i + 1, None),
        part(head, m - tail - head, "add", new, None, lambda i: i + 1), part(n - tail, tail, "ctx", old, lambda i: i + 1, lambda i: i + 1 + m - n))
    return ends.select(key, F.posexplode(rows).alias("pos", "r")).select(key, "pos", "r.*")


#: Elements of the new side up to which a row of the comparison is one integer, and bits of rows that are held at a time.
BITS, HELD = 4096, 1 << 26


def _lcs_bits(a: list, b: list) -> list[tuple[str, int, int]]:
    """What _lcs has without a common head, from rows of bits: row i has a bit for each place from b's end at which the longest common subsequence of a[i:] and that much of b grows. Where all rows are too many to hold, some are, and those between them are made again."""
    n, m = len(a), len(b)
    number: dict = {}
    x, y = ([number.setdefault(v, len(number)) for v in side] for side in (a, b))
    back = np.array(y[::-1], np.int64)
    places = lambda v: int.from_bytes(np.packbits(back == v, bitorder="little").tobytes(), "little")
    if len(seen := set(x)) * m <= HELD:
        places = {v: places(v) for v in seen}.__getitem__
    every = (1 << m) - 1
    step = n if n * m <= HELD else math.isqrt(n)
    marks, flat = {n: every}, every
    if step < n:
        for i in range(n - 1, 0, -1):
            met = flat & places(x[i])
            flat = ((flat + met) | (flat - met)) & every
            if i % step == 0:
                marks[i] = flat
    out, i, j, length = [], 0, 0, None
    for low in range(0, n, step):
        high = min(low + step, n)
        rows = [flat := marks.pop(high)]
        for k in range(high - 1, low - 1, -1):
            met = flat & places(x[k])
            flat = ((flat + met) | (flat - met)) & every
            rows.append(flat)
        if length is None:
            length = (flat ^ every).bit_count()
        while i < high and j < m:
            if x[i] != y[j]:
                left = (1 << (m - j)) - 1
                if (~rows[high - i - 1] & left).bit_count() == length:  # as long without this one
                    out.append(("del", i, -1))
                    i += 1
                    continue
                at = y.index(x[i], j)  # no later place in b makes it needless
                out += [("add", -1, k) for k in range(j, at)]
                j = at
            out.append(("ctx", i, j))
            i, j, length = i + 1, j + 1, length - 1
    return out + [("del", k, -1) for k in range(i, n)] + [("add", -1, k) for k in range(j, m)]


def _lcs(a: list, b: list, cells: int | None) -> list[tuple[str, int, int]]:
    """(op, i, j) of a longest common subsequence, deletions first where both ways are as long; beyond `cells`, head and tail only."""
    n, m = len(a), len(b)
    if cells is not None and (n + 1) * (m + 1) > cells:
        h = 0
        while h < min(n, m) and a[h] == b[h]:
            h += 1
        t = 0
        while t < min(n, m) - h and a[n - 1 - t] == b[m - 1 - t]:
            t += 1
        return [("ctx", i, i) for i in range(h)] + [("del", i, -1) for i in range(h, n - t)] + [("add", -1, j) for j in range(h, m - t)] + [("ctx", n - t + k, m - t + k) for k in range(t)]
    h = 0  # a common head is always context, whatever follows
    while h < min(n, m) and a[h] == b[h]:
        h += 1
    head, a, b, n, m = [("ctx", i, i) for i in range(h)], a[h:], b[h:], n - h, m - h
    if not n or not m:
        return head + [("del", h + i, -1) for i in range(n)] + [("add", -1, h + j) for j in range(m)]
    if m <= BITS or n * m > ALIGN_CELLS:
        return head + [(op, h + i if i >= 0 else -1, h + j if j >= 0 else -1) for op, i, j in _lcs_bits(a, b)]
    number: dict = {}
    x = np.array([number.setdefault(v, len(number)) for v in a], np.int64)
    y = np.array([number.setdefault(v, len(number)) for v in b], np.int64)
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):  # right to left, a row's values never fall
        row = np.maximum(best[i + 1, :m], np.where(y == x[i], best[i + 1, 1:] + 1, 0))
        best[i, :m] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            out.append(("ctx", h + i, h + j))
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[i + 1, j] >= best[i, j + 1]):
            out.append(("del", h + i, -1))
            i += 1
        else:
            out.append(("add", -1, h + j))
            j += 1
    return head + out


#: Rows of lines that a task hands on at a time.
ROWS = 50_000


def _numbers(values: list[int]) -> pa.Array:
    """Line numbers from 1; null where there is none."""
    v = np.array(values, np.int32)
    return pa.array(v + 1, mask=v < 0)


def lcs_diff(df: DataFrame, key: str, old: str, new: str, old_norm: str | None = None, new_norm: str | None = None, cells: int = CELLS) -> DataFrame:
    """(key, pos, op, old_no, new_no, text) by longest common subsequence. Lines match by old_norm and new_norm (arrays like old and new), and show as they are."""
    normal = [F.col(old_norm or old).alias("old_norm"), F.col(new_norm or new).alias("new_norm")] if old_norm or new_norm else []
    own = df.select(F.col(key).alias("key"), F.col(old).alias("old"), F.col(new).alias("new"), *normal)
    out = ["pos", "op", "old_no", "new_no", "text"]

    def diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ops, texts, pos = [], [], [], []

            def sent() -> pa.RecordBatch:
                columns = [batch.column("key").take(pa.array(at, pa.int32())), pa.array(pos, pa.int32()), pa.array([o for o, _, _ in ops], pa.string()), _numbers([i for _, i, _ in ops]), _numbers([j for _, _, j in ops]), pa.array(texts, pa.string())]
                for x in (at, ops, texts, pos):
                    x.clear()
                return pa.RecordBatch.from_arrays(columns, names=[key, *out])

            for k in range(batch.num_rows):
                a, b, *norms = (batch.column(c)[k].as_py() or [] for c in range(1, batch.num_columns))
                own = _lcs(*(norms or (a, b)), cells)
                at += [k] * len(own)
                ops += own
                pos += range(len(own))
                texts += [a[i] if i >= 0 else b[j] for _, i, j in own]
                if len(ops) >= ROWS:
                    yield sent()
            if ops:
                yield sent()

    return own.mapInArrow(diff, f"`{key}` {df.schema[key].dataType.simpleString()}, pos int, op string, old_no int, new_no int, text string")


def lcs_counts(df: DataFrame, key: str, old: str, new: str, cells: int = CELLS) -> DataFrame:
    """(key, same, deleted, added): how many lines of each kind lcs_diff has, counted where they are compared, so that no line leaves its task. Keys without lines have no row."""
    own = df.select(F.col(key).alias("key"), F.col(old).alias("old"), F.col(new).alias("new"))
    out = {"same": "ctx", "deleted": "del", "added": "add"}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, counts = [], []
            for k in range(batch.num_rows):
                found = Counter(op for op, _, _ in _lcs(batch.column("old")[k].as_py() or [], batch.column("new")[k].as_py() or [], cells))
                if found:
                    at.append(k)
                    counts.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int32())), *(pa.array([x[op] for x in counts], pa.int64()) for op in out.values())], names=[key, *out])

    return own.mapInArrow(count, f"`{key}` {df.schema[key].dataType.simpleString()}, same long, deleted long, added long")


def number(lines: DataFrame, key: str) -> DataFrame:
    """Line numbers of both sides from ops in order."""
    upto = W.partitionBy(key).orderBy("pos")
    old, new = F.sum(F.col("op").isin("ctx", "del").cast("int")).over(upto), F.sum(F.col("op").isin("ctx", "add").cast("int")).over(upto)
    return lines.withColumns({"old_no": F.when(F.col("op") != "add", old).cast("int"), "new_no": F.when(F.col("op") != "del", new).cast("int")})


def change_blocks(lines: DataFrame, key: str) -> DataFrame:
    """(key, change_no, type, old_start, old_end, new_start, new_end, old_lines, new_lines): runs of lines between context."""
    order = W.partitionBy(key).orderBy("pos")
    island = lines.withColumn("island", F.sum((F.col("op") == "ctx").cast("int")).over(order)).where("op <> 'ctx'")
    ends = lambda c: [F.coalesce(F.min(c), F.lit(0)), F.coalesce(F.max(c), F.lit(0))]
    old, new = ends("old_no"), ends("new_no")

    def texts(op: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(F.col("op") == op, F.struct("pos", "text")))), lambda x: x["text"])

    blocks = island.groupBy(key, "island").agg(
        old[0].alias("old_start"), old[1].alias("old_end"), new[0].alias("new_start"), new[1].alias("new_end"), texts("del").alias("old_lines"), texts("add").alias("new_lines"))
    kind = F.when((F.col("old_end") > 0) & (F.col("new_end") > 0), "MODIFIED").when(F.col("old_end") > 0, "DELETED").otherwise("ADDED")
    return blocks.withColumn("type", kind).withColumn("change_no", F.row_number().over(W.partitionBy(key).orderBy("island"))).drop("island")


def capped_blocks(blocks: DataFrame, key: str, most: int = 120, lines: int = 40, chars: int = 120) -> DataFrame:
    """Blocks as a digest shows them: the first of a key, the first lines of each side, lines cut with an ellipsis."""
    def cut(c: str) -> Column:
        return F.transform(F.slice(c, 1, lines), lambda x: F.when(F.length(x) > chars, F.concat(F.substring(x, 1, chars), F.lit("…"))).otherwise(x))

    return blocks.where(F.col("change_no") <= most).withColumns({
        "old_omitted": F.greatest(F.size("old_lines") - lines, F.lit(0)), "new_omitted": F.greatest(F.size("new_lines") - lines, F.lit(0)), "old_lines": cut("old_lines"), "new_lines": cut("new_lines")})


def fold_context(lines: DataFrame, key: str, window: int = 3) -> DataFrame:
    """Lines with context far from changes folded: (key, pos, op, count, change_index). Once a line of a run is far, the rest of its run folds with it."""
    order = W.partitionBy(key).orderBy("pos")
    change = (F.col("op") != "ctx").cast("int")
    near = F.max(change).over(order.rowsBetween(-window, window)) == 1
    run = F.sum(change).over(order)
    marked = lines.select(key, "pos", "op", near.alias("near"), run.alias("run"))
    cut = F.min(F.when((F.col("op") == "ctx") & ~F.col("near"), F.col("pos"))).over(W.partitionBy(key, "run"))
    folded = marked.withColumn("folded", (F.col("op") == "ctx") & F.coalesce(F.col("pos") >= cut, F.lit(False)))
    shown = folded.where(~F.col("folded")).select(key, "pos", "op", F.lit(1).cast("long").alias("count"))
    folds = folded.where("folded").groupBy(key, "run").agg(F.min("pos").alias("pos"), F.count("*").alias("count")).select(key, "pos", F.lit("fold").alias("op"), "count")
    index = F.sum(F.when(~F.col("op").isin("ctx", "fold"), 1).otherwise(0)).over(order) - 1
    return shown.unionByName(folds).withColumn("change_index", F.when(F.col("op").isin("ctx", "fold"), -1).otherwise(index).cast("long"))


def search_lines(lines: DataFrame, query: str) -> DataFrame:
    """Lines that contain a text (any case), with the sides they are on."""
    sides = F.when(F.col("op") == "ctx", F.array(F.lit("left"), F.lit("right"))).when(F.col("op") == "del", F.array(F.lit("left"))).otherwise(F.array(F.lit("right")))
    return lines.where(F.contains(F.lower("text"), F.lit(query.lower()))).withColumn("sides", sides)


def similarity(a: str, b: str) -> float:
    """Shared first and last characters against the longer length."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    n, p = min(len(a), len(b)), 0
    while p < n and a[p] == b[p]:
        p += 1
    s = 0
    while s < n - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return (p + s) / max(len(a), len(b))


def pair_lines(old: list[str], new: list[str]) -> dict[int, int]:
    """Pairs of similar lines in order, of the largest total similarity; earliest where totals are equal."""
    n, m = len(old), len(new)
    if not n or not m or max(n, m) > RUN:
        return {}
    score = np.array([[similarity(a, b) for b in new] for a in old])
    score[score < SIMILAR] = 0
    best = np.zeros((n + 1, m + 1))
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i, j] = max(best[i + 1, j + 1] + score[i, j], best[i + 1, j], best[i, j + 1])
    pairs, i, j = {}, 0, 0
    while i < n and j < m:
        if score[i, j] > 0 and best[i, j] == best[i + 1, j + 1] + score[i, j]:
            pairs[i] = j
            i, j = i + 1, j + 1
        elif best[i, j] == best[i + 1, j]:
            i += 1
        else:
            j += 1
    return pairs


def align_lines(old: list[str], new: list[str], cells: int = ALIGN_CELLS) -> list[tuple[str, int | None, str, str]]:
    """(ctx, rep, del or add, change_no, left, right): two texts side by side, similar lines of a run of changes as replacements; context has no change_no."""
    ops = _lcs(old, new, None if len(old) * len(new) <= cells else 0)
    out, at, no = [], 0, 0
    while at < len(ops):
        if ops[at][0] == "ctx":
            out.append(("ctx", None, old[ops[at][1]], new[ops[at][2]]))
            at += 1
            continue
        end, no = at, no + 1
        while end < len(ops) and ops[end][0] != "ctx":
            end += 1
        run = ops[at:end]
        dels, adds = [i for op, i, _ in run if op == "del"], [j for op, _, j in run if op == "add"]
        pairs = {dels[i]: adds[j] for i, j in pair_lines([old[i] for i in dels], [new[j] for j in adds]).items()}
        used = set(pairs.values())
        for op, i, j in run:
            if op == "del":
                out.append(("rep", no, old[i], new[pairs[i]]) if i in pairs else ("del", no, old[i], ""))
            elif j not in used:
                out.append(("add", no, "", new[j]))
        at = end
    return out


def aligned(df: DataFrame, key: str, old: str, new: str, cells: int = ALIGN_CELLS) -> DataFrame:
    """(key, pos, change_no, type, left, right): align_lines of two columns, arrays of lines."""
    own = df.select(F.col(key).alias("key"), F.col(old).alias("old"), F.col(new).alias("new"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, pos = [], [], []

            def sent() -> pa.RecordBatch:
                columns = [batch.column("key").take(pa.array(at, pa.int32())), pa.array(pos, pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.string()) for c in (0, 2, 3))]
                for x in (at, rows, pos):
                    x.clear()
                return pa.RecordBatch.from_arrays(columns, names=[key, "pos", "change_no", "type", "left", "right"])

            for k in range(batch.num_rows):
                own = align_lines(*(batch.column(c)[k].as_py() or [] for c in ("old", "new")), cells)
                at += [k] * len(own)
                rows += own
                pos += range(len(own))
                if len(rows) >= ROWS:
                    yield sent()
            if rows:
                yield sent()

    return own.mapInArrow(align, f"`{key}` {df.schema[key].dataType.simpleString()}, pos int, change_no int, type string, left string, right string")


class _Made(dict):
    """A dictionary that makes what it doesn't have yet."""

    def __init__(self, of: Callable):
        self.of = of

    def __missing__(self, key):
        self[key] = made = self.of(key)
        return made


def _runs_by_count(a: Sequence, b: Sequence) -> list[tuple[str, int, int]] | None:
    """(eq, del or add, start, end): the runs of what _lcs has, where the numbers of equal elements decide every step; None where they don't.

    No way keeps more of an element than the side with fewer has, and a way that never deletes and adds the same element keeps as many of each, so it is a longest one. On it, an element of which there are no more left than on the other side can't be spared, and one that the other side has no longer can."""
    n, m = len(a), len(b)
    if isinstance(a, str):  # few characters are asked for
        more, last = _Made(lambda v: a.count(v) - b.count(v)), _Made(b.rfind)
    else:
        more, last = Counter(a), _Made(lambda v: -1)
        more.subtract(b)
        last.update((v, j) for j, v in enumerate(b))
    out, i, j = [], 0, 0
    while i < n and j < m:
        v, d, k = a[i], b[j], i
        while v == d:
            i += 1
            j += 1
            if i == n or j == m:
                return out + [("eq", k, i)] + [("del", i, n)] * (i < n) + [("add", j, m)] * (j < m)
            v, d = a[i], b[j]
        if i > k:
            out.append(("eq", k, i))
            k = i
        while v != d:
            if last[v] >= j:
                if more[v] <= 0:
                    break
                if more[d] < 0:  # either can be spared
                    return None
            more[v] -= 1
            i += 1
            if i == n:
                break
            v = a[i]
        if i > k:
            out.append(("del", k, i))
        if i < n and v != d:
            k, j = j, b.index(v, j)
            for d in b[k:j]:
                if more[d] >= 0:
                    return None
                more[d] += 1
            out.append(("add", k, j))
    return out + [("del", i, n)] * (i < n) + [("add", j, m)] * (j < m)


def inline_segments(old: str, new: str, mode: str = "char") -> list[tuple[str, str]]:
    """(eq, del or add, text) pieces that turn one line into another, by a longest common subsequence of what stands between their common ends, however long it is."""
    old, new = old or "", new or ""
    if old == new:
        return [("eq", old)]
    n, p = min(len(old), len(new)), 0
    while p < n and old[p] == new[p]:
        p += 1
    s = 0
    while s < n - p and old[-1 - s] == new[-1 - s]:
        s += 1
    a, b = old[p : len(old) - s], new[p : len(new) - s]
    xs, ys = (re.findall(r"\s+|\S+", t) for t in (a, b)) if mode == "word" else (a, b)
    runs = _runs_by_count(xs, ys)
    if runs is None:
        runs = []
        for op, i, j in _lcs(list(xs), list(ys), None):
            t, k = ("eq", i) if op == "ctx" else ("del", i) if op == "del" else ("add", j)
            if runs and runs[-1][0] == t:
                runs[-1] = (t, runs[-1][1], k + 1)
            else:
                runs.append((t, k, k + 1))
    out = [(t, (ys if t == "add" else xs)[lo:hi]) for t, lo, hi in runs]
    if mode == "word":
        out = [(t, "".join(x)) for t, x in out]
    # The ends of what stands between are unlike, so no run there is equal.
    return [("eq", old[:p])] * (p > 0) + out + [("eq", old[len(old) - s :])] * (s > 0)


def inline(old: Column, new: Column, mode: str = "char") -> Column:
    """inline_segments of two columns."""

    @F.arrow_udf("array<struct<t:string,s:string>>")
    def segments(a: pa.Array, b: pa.Array) -> pa.Array:  # one pair at a time is a Python object
        ends, kinds, texts, parts = [0], [], [], []

        def part() -> pa.Array:
            made = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (kinds, texts)], names=["t", "s"])
            kinds.clear()
            texts.clear()
            return made

        for x, y in zip(a, b):
            own = inline_segments(x.as_py(), y.as_py(), mode)
            ends.append(ends[-1] + len(own))
            kinds += [t for t, _ in own]
            texts += [s for _, s in own]
            if len(kinds) >= ROWS:
                parts.append(part())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([*parts, part()]))

    return segments(old, new)


def _spots(lines: DataFrame, key: str, window: int) -> DataFrame:
    """(key, h, n, first, last, size, before, after): where each window of token-normalised lines stands, with the windows before and after it. A window that repeats line by line is one place."""
    # Fixed value: tokens are runs of word characters and single others.
    tokens = F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_$]+|\S)"), 1)
    valid = lines.withColumn("norm", F.array_join(tokens, " ")).where((F.size(tokens) > 1) | F.col("norm").rlike("^[A-Za-z0-9_$]"))
    order = W.partitionBy(key).orderBy("line_no")
    rows = valid.select(key, "line_no", F.row_number().over(order).alias("n"), "norm")
    frame = order.rowsBetween(0, window - 1)
    hashed = rows.select(key, "n", "line_no", F.md5(F.array_join(F.collect_list("norm").over(frame), "\n")).alias("h"), F.max("line_no").over(frame).alias("end"), F.count("*").over(frame).alias("k")).where(F.col("k") == window)
    order = W.partitionBy(key).orderBy("n")
    starts = F.coalesce(F.col("h") != F.lag("h").over(order), F.lit(True)).cast("int")
    runs = hashed.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order)).groupBy(key, "run", "h").agg(
        F.min("n").alias("n"), F.min("line_no").alias("first"), F.max("end").alias("last"), (F.max("n") - F.min("n") + window).cast("long").alias("size"))
    order = W.partitionBy(key).orderBy("run")
    return runs.withColumns({"before": F.lag("h").over(order), "after": F.lead("h").over(order)}).drop("run")


def duplicate_windows(lines: DataFrame, key: str, window: int = 10) -> DataFrame:
    """(passage, key, first, last, size, places): passages of token-normalised lines that stand in two places or more, a row for each place. lines are (key, line_no, text).

    Windows that follow each other wherever either stands are one passage, named by the hash of its first window: all places of a passage have the same passage and no pairs are made. Where the sets of places differ, passages overlap."""
    spots = _spots(lines, key, window)
    only = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    kinds = spots.groupBy("h").agg(F.count("*").alias("places"), only("before").alias("before"), only("after").alias("after")).where("places > 1")
    ahead = kinds.select(F.col("h").alias("before"), F.col("after").alias("h"), F.lit(False).alias("starts")).where("h IS NOT NULL")
    kinds = kinds.select("h", "places", "before").join(ahead, ["before", "h"], "left").select("h", "places", F.coalesce("starts", F.lit(True)).alias("starts"))
    own = spots.select(key, "h", "n", "first", "last", "size").join(kinds, "h")
    island = F.sum(F.col("starts").cast("int")).over(W.partitionBy(key).orderBy("n"))
    return own.withColumn("island", island).groupBy(key, "island").agg(
        F.min_by("h", "n").alias("passage"), F.min("first").alias("first"), F.max("last").alias("last"), (F.max(F.col("n") + F.col("size")) - F.min("n")).cast("long").alias("size"), F.max("places").alias("places")).drop("island")


def duplicate_total(lines: DataFrame, key: str, window: int = 10) -> DataFrame:
    """(blocks, total): pairs of places of equal windows, and the lines of the shorter of each, added up from counts by size."""
    sizes = _spots(lines, key, window).groupBy("h", "size").agg(F.count("*").alias("c"))
    longer = F.coalesce(F.sum("c").over(W.partitionBy("h").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pairs = F.col("c") * F.col("longer") + F.expr("c * (c - 1) div 2")
    return sizes.withColumn("longer", longer).agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("blocks"), F.coalesce(F.sum(pairs * F.col("size")), F.lit(0)).alias("total"))
