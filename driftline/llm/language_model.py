"""Language-model scores by deleted interpolation of trigram, bigram, unigram and uniform estimates.

P(w | u v) = a * c(u v w) / c(u v) + (1 - a) * (b * c(v w) / c(v) + (1 - b) * (g * c(w) / N + (1 - g) / (V + 1)))
a depends on the bucket of c(u v), b on that of c(v): half octaves of frequency. The weights are learned by expectation-maximisation
on counts held out: one tenth of the training documents (TUNE_FOLD) is tuned on with the counts of the rest; then all training
documents count. Unknown words share one place, the + 1. A document begins after two ends.

All n-grams of all documents are counted, in steps that grow with the input:
  1. Tasks cut documents into blocks of about BLOCK tokens, numbered within the block (written to the shared folder).
  2. A block sends its distinct n-gram hashes, sorted and cut by their first bits, a row for each part; rows of a part meet, add up,
     and go back as counts in the order that each block knows. A block is never cut into more than 2^LEVEL_BITS parts: where the
     input calls for more, parts of 2^LEVEL_BITS blocks are merged and cut again, level by level, and the counts come back the same
     way. So rows are at most 2^LEVEL_BITS a block and level, and levels grow with the logarithm of the input.
  3. Blocks and returned counts meet by block: the tuning blocks give the estimates of their tokens, over which each round of
     expectation-maximisation is a job that brings back two numbers a bucket; then all blocks give their documents' scores.
Words and bigrams are known by 64-bit hashes, trigrams by the first 56 bits of one, at every size (of 10^13 different trigrams one in
7 000 shares its key); all are counted in 8 bytes. Sorted keys go as their steps, and keys and counts as compressed byte planes.

Defined results: null and empty texts have one token, the end; null ids count as the empty text in the folds; equal rows are scored
alike and counted as often as they occur; without training documents every probability is 1 / (V + 1) = 1; an empty table gives no
rows; other columns are not read. Ids pass Python as text, so that longs beside nulls stay what they are.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_fold, materialize, shared_dir, table

BLOCK = 1_600_000
PART_BYTES = 8 << 20
LEVEL_BITS = 8
TUNE_FOLD = 1
ROUNDS = 20
BUCKETS = 128
#: Tokens that arithmetic takes at a time.
SLICE = 1 << 17
_END = xxhash.xxh64_intdigest(b"")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokenize(text: str) -> list[bytes]:
    """Words with A-Z lower-cased: bytes' own lower() and split() know ASCII only."""
    return text.encode().lower().split()


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents: tuned on (role 1), or counted or held out (role 0). Token 0 is the end."""
    fold = id_fold(F.col(id_col), 10)
    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (fold == 0).alias("held"), (fold == TUNE_FOLD).cast("int").alias("role"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, serial = TaskContext.get().partitionId() << 24, count()

        def fresh():
            vocab = defaultdict(count(1).__next__)
            return {"vocab": vocab, "ids": [], "held": [], "lengths": [], "tokens": [], "n": 0}

        open_ = {r: fresh() for r in (0, 1)}

        def row(r: int, b: dict) -> pd.DataFrame:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, b["vocab"]), np.uint64, len(b["vocab"]))
            return pd.DataFrame({"block": [base + next(serial)], "n_tokens": [b["n"]], "doc_ids": [b["ids"]], "held": [np.array(b["held"], bool).tobytes()], "lengths": [np.array(b["lengths"], "<u4").tobytes()],
                                 "tokens": [_planes(np.concatenate(b["tokens"]), 4)], "vocab": [np.concatenate([np.array([_END], np.uint64), hashes]).tobytes()], "role": [r]})

        for batch in batches:
            for doc, text, held, r in zip(batch["doc_id"], batch["text"], batch["held"].tolist(), batch["role"].tolist()):
                ws, b = tokenize(text), open_[r]
                tokens = np.zeros(len(ws) + 1, np.uint32)
                tokens[:-1] = np.fromiter(map(b["vocab"].__getitem__, ws), np.uint32, len(ws))
                for name, value in (("ids", doc), ("held", held), ("lengths", len(tokens)), ("tokens", tokens)):
                    b[name].append(value)
                b["n"] += len(tokens)
                if b["n"] >= BLOCK:
                    yield row(r, b)
                    open_[r] = fresh()
        for r, b in open_.items():
            if b["ids"]:
                yield row(r, b)

    return own.mapInPandas(cut, "block long, n_tokens long, doc_ids array<string>, held binary, lengths binary, tokens binary, vocab binary, role int")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Block:
    """A block's tokens and, for each order, its distinct n-grams in the order of their hashes and each token's place among them."""

    def __init__(self, row):
        tokens = _numbers(row.tokens, 4).astype(np.int64)
        self.lengths = np.frombuffer(row.lengths, "<u4").astype(np.int64)
        self.held = np.frombuffer(row.held, bool)
        hashes = np.frombuffer(row.vocab, np.uint64)
        before = np.concatenate([np.zeros(1, np.int64), tokens[:-1]])  # documents follow ends, and so does the first
        self.first = before == 0
        order = np.argsort(hashes)
        place = np.empty(len(hashes), np.int64)
        place[order] = np.arange(len(hashes))
        self.end = int(place[0])
        self.keys, self.at = [hashes[order]], [place[tokens].astype(np.int32)]
        self.before = place[before].astype(np.int32)
        own = hashes[tokens]
        pairs = _mix(hashes[before] * _ODD + own)
        context = np.concatenate([np.zeros(1, np.uint64), pairs[:-1]])
        context[self.first] = 0
        triples = _mix(context * _ODD + own + np.uint64(1)) & ~np.uint64(0xFF)
        del own, context, before, tokens
        for grams in (pairs, triples):
            order = np.argsort(grams)
            sorted_ = grams[order]
            new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
            keys, at = sorted_[new], np.empty(len(grams), np.int32)
            del sorted_
            at[order] = np.cumsum(new, dtype=np.int32) - 1
            del order, new
            self.keys.append(keys)
            self.at.append(at)

    def counts(self) -> list[np.ndarray]:
        """How often each n-gram of an order occurs in documents that are not held out."""
        learned = np.repeat(~self.held, self.lengths)
        return [np.bincount(at[learned], minlength=len(keys)) for keys, at in zip(self.keys, self.at)]

    def seen(self, counts: list[np.ndarray]) -> Iterator[tuple[slice, tuple[np.ndarray, ...]]]:
        """(c(u v w), c(u v), c(v w), c(v), c(w)) of tokens, from the counts of the n-grams of each order, a slice of tokens at a time."""
        uni, bi, tri = counts
        pairs, n = self.at[1], len(self.first)
        for lo in range(0, n, SLICE):
            hi = min(lo + SLICE, n)
            part = slice(lo, hi)
            earlier = pairs[lo - 1 : hi - 1] if lo else np.concatenate([pairs[:1], pairs[: hi - 1]])
            context = np.where(self.first[part], uni[self.end], bi[earlier])
            yield part, (tri[self.at[2][part]], context, bi[pairs[part]], uni[self.before[part]], uni[self.at[0][part]])


def _planes(numbers: np.ndarray, size: int = 8) -> bytes:
    """Numbers of `size` bytes, compressed a byte plane at a time: high planes are nearly constant."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes())


def _numbers(raw: bytes, size: int = 8) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.view("<u8").ravel()


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the byte planes of their steps; planes above the largest step are left out."""
    steps = np.diff(keys, prepend=np.uint64(0))
    first, steps = int(keys[0]), steps[1:]
    size = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([size]) + first.to_bytes(8, "little") + (_planes(steps, size) if len(steps) else b"")  # planes of zeros cost nothing


def _unpacked(raw: bytes) -> np.ndarray:
    first = np.array([int.from_bytes(raw[1:9], "little")], np.uint64)
    return np.cumsum(np.concatenate([first, _numbers(raw[9:], raw[0])]), dtype=np.uint64) if len(raw) > 9 else first


def _parts(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(prefix, begin, end) of sorted keys by their first bits, those that have any."""
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist()
    for prefix, (lo, hi) in enumerate(zip([0, *edges], [*edges, len(keys)])):
        if hi > lo:
            yield prefix, lo, hi


SENT = "order int, prefix long, child long, role int, keys binary, total binary, tune binary"
BACK = "order int, prefix long, child long, total binary, tune binary, n long, v long, n_tune long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _sum(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(keys of each row, all keys, their totals, their counts in tuning documents)."""
    keys = [_unpacked(k) for k in rows["keys"]]
    union, spot = np.unique(np.concatenate(keys), return_inverse=True)
    total, tune = (np.zeros(len(union), np.int64) for _ in "ab")
    for out, column in ((total, "total"), (tune, "tune")):
        np.add.at(out, spot, np.concatenate([_numbers(x).astype(np.int64) for x in rows[column]]))
    return keys, union, total, tune


def _returned(rows: pd.DataFrame, keys: list[np.ndarray], union: np.ndarray, total: np.ndarray, tune: np.ndarray) -> pd.DataFrame:
    """The counts of each row's keys; counts in tuning documents only for those that need them."""
    out = []
    for r, own in zip(rows.itertuples(), keys):
        at = np.searchsorted(union, own)
        out.append((r.order, r.prefix, r.child, _planes(total[at]), _planes(tune[at]) if r.role else b"", 0, 0, 0))
    return pd.DataFrame(out, columns=_names(BACK))


def _merge(bits: int):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        _, union, total, tune = _sum(rows)
        order, group = rows["order"].iloc[0], rows["parent"].iloc[0]
        out = [(order, prefix, group, 1, _packed(union[lo:hi]), _planes(total[lo:hi]), _planes(tune[lo:hi])) for prefix, lo, hi in _parts(union, bits)]
        return pd.DataFrame(out, columns=_names(SENT))

    return merge


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    keys, union, total, tune = _sum(rows)
    back = _returned(rows, keys, union, total, tune)
    back.loc[len(back)] = (rows["order"].iloc[0], rows["prefix"].iloc[0], -1, b"", b"", int(total.sum()), int((total > 0).sum()), int(tune.sum()))
    return back


def _deal(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """What came back for a merged part, dealt to the rows that went into it."""
    if not len(rows):
        return pd.DataFrame(columns=_names(BACK))
    keys = [_unpacked(k) for k in rows["keys"]]
    found = found.sort_values("prefix")
    total, tune = (np.concatenate([_numbers(x).astype(np.int64) for x in found[c]]) for c in ("total", "tune"))
    return _returned(rows, keys, np.unique(np.concatenate(keys)), total, tune)


def counted(cut: DataFrame, n_blocks: int, n_bytes: int) -> DataFrame:
    """The counts each block asks for: (order, prefix, block, total, tune), and rows of block -1 with a part's sums (n, v, n_tune)."""
    bits = max(4, (max(1, -(-n_bytes // PART_BYTES)) - 1).bit_length())
    steps = [*range(LEVEL_BITS, bits, LEVEL_BITS), bits]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples():
                own = Block(b)
                nothing = b.role == 0
                rows = []
                for order, (keys, n) in enumerate(zip(own.keys, own.counts()), 1):
                    for prefix, lo, hi in _parts(keys, steps[0]):
                        rows.append((order, prefix, b.block, b.role, _packed(keys[lo:hi]), _planes(n[lo:hi]), _planes(n[lo:hi] * (not nothing))))
                yield pd.DataFrame(rows, columns=_names(SENT))

    sent = cut.select("block", "role", "held", "lengths", "tokens", "vocab").mapInPandas(send, SENT)
    levels = []
    for level, more in enumerate(steps[1:], 1):
        groups = -(-n_blocks // (1 << LEVEL_BITS * level))
        sent = materialize(sent.withColumn("parent", F.pmod(F.xxhash64("child"), F.lit(groups))), "lm-level")
        levels.append((sent, more - steps[level - 1]))
        sent = sent.groupBy("order", "prefix", "parent").applyInPandas(_merge(more), SENT)
    back = sent.groupBy("order", "prefix").applyInPandas(_meet, BACK)
    for asked, more in reversed(levels):
        back = materialize(back, "lm-back")
        own = back.where("child >= 0").withColumn("above", F.shiftright("prefix", more))
        back = (asked.groupBy("order", "prefix", "parent").cogroup(own.groupBy("order", "above", "child")).applyInPandas(_deal, BACK)
                .unionByName(back.where("child < 0")))
    return back.withColumnRenamed("child", "block")


def _with_counts(block: pd.DataFrame, counts: pd.DataFrame) -> tuple:
    """(block row, Block, totals by order, counts in tuning documents by order), counts in the block's order."""
    b = next(block.itertuples())
    own, total, tune = Block(b), [], []
    for order, keys in enumerate(own.keys, 1):
        rows = counts[counts["order"] == order].sort_values("prefix")
        for out, column in ((total, "total"), (tune, "tune")) if b.role else ((total, "total"),):
            out.append(np.concatenate([np.zeros(0, np.int64), *(_numbers(x).astype(np.int64) for x in rows[column])]))
        if len(total[-1]) != len(keys):
            raise ValueError("a block's counts didn't all come back")
    return b, own, total, tune


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(2 * np.log2(context + 1.0)), BUCKETS - 1).astype(np.int64)


def estimates(seen: tuple[np.ndarray, ...], n: int) -> tuple[np.ndarray, ...]:
    """(trigram bucket, bigram bucket, estimates by trigram, bigram and unigram) of tokens' counts."""
    c3, context3, c2, context2, c1 = seen
    return bucket_of(context3), bucket_of(context2), c3 / np.maximum(context3, 1), c2 / np.maximum(context2, 1), c1 / max(n, 1)


def probabilities(weights: tuple, found: tuple[np.ndarray, ...], floor: float) -> tuple[np.ndarray, ...]:
    """(P, its parts) of tokens with estimates."""
    a, b, g = weights
    b3, b2, e3, e2, e1 = found
    q1, q2, q3 = g * e1, b[b2] * e2, a[b3] * e3
    p1 = q1 + (1 - g) * floor
    p2 = q2 + (1 - b[b2]) * p1
    return q3 + (1 - a[b3]) * p2, q3, p2, q2, p1, q1


def expected(weights: tuple, found: tuple[np.ndarray, ...], times: np.ndarray, floor: float) -> np.ndarray:
    """(3, BUCKETS, 2): how many tokens each weight explains and is asked about, by order and bucket."""
    p, q3, p2, q2, p1, q1 = probabilities(weights, found, floor)
    r3 = q3 / p
    r2 = (1 - r3) * q2 / p2
    rest = 1 - r3 - r2
    out = np.zeros((3, BUCKETS, 2))
    for k, (bucket, explained, asked) in enumerate(((found[0], r3, np.ones(len(p))), (found[1], r2, 1 - r3), (np.zeros(len(p), np.int64), rest * q1 / p1, rest))):
        for j, x in enumerate((explained, asked)):
            out[k, :, j] = np.bincount(bucket, x * times, BUCKETS)
    return out


def maximised(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The weights of the next round; a bucket that nothing fell into takes those below it, and unseen contexts have none."""
    out = []
    for k in (0, 1):
        weights, last = np.zeros(BUCKETS), 0.3
        for i in range(1, BUCKETS):
            if sums[k, i, 1] > 0:
                last = min(max(sums[k, i, 0] / sums[k, i, 1], 1e-4), 1 - 1e-4)
            weights[i] = last
        out.append(weights)
    g = sums[2, 0, 0] / sums[2, 0, 1] if sums[2, 0, 1] > 0 else 0.9
    return out[0], out[1], min(max(g, 1e-4), 1 - 1e-4)


def learned(cut: DataFrame, counts: DataFrame, n: int, v: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights by expectation-maximisation over the tuning blocks; n and v are of the counts without them, and of all."""
    names, kinds = ["b3", "b2", "e3", "e2", "e1", "times"], ["u1", "u1", "<f4", "<f4", "<f4", "<u4"]

    def each(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame(columns=names)
        _, own, total, tune = _with_counts(block, found)
        out = []
        for _, seen in own.seen([a - b for a, b in zip(total, tune)]):
            key = np.zeros(len(seen[0]), np.uint64)
            for x in seen:
                key = _mix(key * _ODD + x.astype(np.uint64))
            _, at, times = np.unique(key, return_index=True, return_counts=True)
            got = estimates(tuple(x[at] for x in seen), n)
            out.append([x.astype(kind).tobytes() for x, kind in zip((*got, times), kinds)])
        return pd.DataFrame(out, columns=names)

    rows = cut.where("role = 1").groupBy("block").cogroup(counts.where("block >= 0").groupBy("block"))
    tokens = materialize(rows.applyInPandas(each, ", ".join(f"{c} binary" for c in names)), "lm-tuning")
    floor = 1 / (v + 1)
    weights = maximised(np.zeros((3, BUCKETS, 2)))
    for _ in range(ROUNDS):

        def round_(batches: Iterator[pd.DataFrame], weights=weights) -> Iterator[pd.DataFrame]:
            sums = np.zeros((3, BUCKETS, 2))
            for batch in batches:
                for r in batch.itertuples():
                    *found, times = (np.frombuffer(getattr(r, c), kind) for c, kind in zip(names, kinds))
                    sums += expected(weights, (found[0].astype(np.int64), found[1].astype(np.int64), *(x.astype(np.float64) for x in found[2:])), times, floor)
            at = np.nonzero(sums)
            yield pd.DataFrame({"at": np.ravel_multi_index(at, sums.shape), "x": sums[at]})

        sums = np.zeros(3 * BUCKETS * 2)
        for r in tokens.mapInPandas(round_, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            sums[r["at"]] = r["x"]
        weights = maximised(sums.reshape(3, BUCKETS, 2))
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    cut = _written(blocks(docs, id_col, text_col))
    total, n_blocks = cut.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    counts = materialize(counted(cut, n_blocks, 10 * total), "lm-counts")
    sums = counts.where((F.col("block") == -1) & (F.col("order") == 1)).agg(F.sum("n"), F.sum("v"), F.sum("n_tune")).first()
    n, v, n_tune = (int(x or 0) for x in sums)
    weights = learned(cut, counts, n - n_tune, v)

    def each(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        b, own, total, _ = _with_counts(block, found)
        known, base, own_score = (np.empty(len(own.first)) for _ in "abc")
        for part, seen in own.seen(total):
            known[part], base[part] = seen[4] > 0, np.log10((seen[4] + 0.1) / (n + 0.1 * (v + 1)))
            own_score[part] = np.log10(probabilities(weights, estimates(seen, n), 1 / (v + 1))[0]) if n else 0.0
        starts = np.cumsum(own.lengths) - own.lengths
        return pd.DataFrame({
            "doc_id": list(b.doc_ids), "held_out": own.held, "n_tokens": own.lengths, "n_known": np.add.reduceat(known, starts).astype(np.int64), "train_tokens": n,
            "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(own_score, starts)})

    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    found = counts.where("block >= 0").select("order", "prefix", "block", "total")
    rows = cut.drop("n_tokens").withColumn("role", F.lit(0)).groupBy("block").cogroup(found.groupBy("block"))
    return rows.applyInPandas(lambda b, c: each(b, c) if len(b) else pd.DataFrame(columns=_names(schema)), schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def _written(cut: DataFrame) -> DataFrame:
    """Like materialize, a folder by role, so that tuning reads its own blocks only."""
    path = f"{shared_dir(cut.sparkSession)}/lm-blocks-{uuid.uuid4().hex}"
    cut.write.option("compression", "zstd").partitionBy("role").parquet(path)
    return cut.sparkSession.read.schema(cut.schema).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
