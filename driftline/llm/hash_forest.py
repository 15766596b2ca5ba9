"""Approximate nearest neighbours by a hash-prefix forest.

A tree gives each vector a string of BITS sign bits of random projections and keeps the strings sorted. A query descends in every
tree to the longest prefix it shares with any of them, a range of the sorted array; then all trees ascend together, a bit at a
time, and their ranges widen, until these hold SHARE of the vectors. The candidates are scored on the original vectors. For
largest inner products vectors get one more component, sqrt(longest² - length²), which makes the nearest angle the largest
product.

Rows are dealt to shards of about SHARD vectors, each with a forest that is built once. A shard's vectors and the queries it is asked
are sorted to one task, vectors first, so queries stream past a forest that is there; a query's best of all shards are merged. No
query can skip a shard: where neighbours are hardly nearer than the rest, any routing loses recall in proportion (README). Directions are drawn from a fixed seed, nothing is fitted but lengths. Close neighbours need few
candidates; SHARE is for vectors whose neighbours are hardly nearer than the rest (products of 0.4 of 64 components). Beside a
much longer vector all others would seem at right angles to every query, so a shard's vectors are cut by length into bands, each
a forest with a longest length of its own: a band reaches down to BAND of its longest, or further while it is so small that all
of it is scored.

Defined results: vectors that are null, empty, zero or have null or non-finite components, and null ids, take no part; repeated
rows (equal id and vector) count once, rows that share an id but not the vector are one query with one best list; only vectors
of equal length meet; ties go to the smaller id; a query with fewer candidates than k has all of them; products beyond the range of doubles are infinite and go by id; no rows give no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, table

TREES = 48
BITS = 32
SHARE = 0.65
BAND = 0.8
SHARD = 8192
#: Queries whose descents a task holds at a time.
QUERIES = 512
SEED = 11


class Forest:
    def __init__(self, vectors: np.ndarray, longest: float, trees: int = TREES, seed: int = SEED):
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, trees * BITS))
        self.trees, self.vectors = trees, vectors
        rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
        strings = self.strings(vectors, rest)
        self.order = np.argsort(strings, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(strings, self.order.T, axis=0).T.copy()

    def strings(self, vectors: np.ndarray, rest: np.ndarray | float) -> np.ndarray:
        """The hash strings of vectors by tree, as numbers of BITS bits."""
        extended = np.concatenate([vectors, np.broadcast_to(rest, (len(vectors),))[:, None]], axis=1)
        out = np.empty((len(vectors), self.trees), np.uint64)
        for lo in range(0, len(vectors), 1024):
            bits = (extended[lo : lo + 1024] @ self.directions > 0).reshape(-1, self.trees, BITS)
            out[lo : lo + 1024] = np.packbits(bits, axis=2).view(">u4").reshape(-1, self.trees)
        return out

    def ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each query's range, by (level, query, tree); level x keeps x bits."""
        lows, highs = (np.empty((BITS + 1, *codes.shape), np.int32) for _ in "lh")
        for x in range(BITS + 1):
            shift = np.uint64(BITS - x)
            low = (codes >> shift) << shift
            high = low + (np.uint64(1) << shift)
            for t in range(self.trees):
                lows[x, :, t] = np.searchsorted(self.sorted[t], low[:, t])
                highs[x, :, t] = np.searchsorted(self.sorted[t], high[:, t])
        return lows, highs

    def candidates(self, queries: np.ndarray, least: int):
        """For each query, the rows of the forest that its ascent reaches."""
        lows, highs = self.ranges(self.strings(queries, 0.0))
        held = (highs - lows).sum(axis=2)  # with repeats: as few levels up as may hold enough
        for q in range(len(queries)):
            level = int(np.flatnonzero(held[:, q] >= min(least, len(self.vectors)))[-1])
            while True:
                mask = np.zeros(len(self.vectors), bool)
                for order, lo, hi in zip(self.order, lows[level, q].tolist(), highs[level, q].tolist()):
                    mask[order[lo:hi]] = True
                found = np.flatnonzero(mask)
                if len(found) >= least or level == 0:
                    break
                level -= 1
            yield found


def bands(lengths: np.ndarray, least: int) -> list[np.ndarray]:
    """Positions of vectors by bands of length, the longest first; a band is within BAND of its longest or has `least` vectors."""
    order = np.argsort(-lengths, kind="stable")
    falling, out, lo = -lengths[order], [], 0
    while lo < len(order):
        hi = max(lo + least, int(np.searchsorted(falling, falling[lo] * BAND, side="right")))
        out.append(order[lo:hi])
        lo = hi
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, n): the vectors that take part, as doubles."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own.where(~bad & F.exists("v", lambda x: x != 0)).withColumn("n", F.size("v")).distinct()


def _answers(ids: np.ndarray, x: np.ndarray, share: float, k: int, trees: int):
    """A function of (query ids, queries) that yields (query id, ids, scores) of each query's best k among the vectors x."""
    lengths, forests = np.sqrt((x**2).sum(axis=1)), []
    for at in bands(lengths, 4 * k):
        forests.append((at, Forest(x[at], lengths[at[0]], trees), min(len(at), max(int(share * len(at)), 4 * k))))

    def answer(own_ids: np.ndarray, q: np.ndarray):
        parts = [[at[found] for found in forest.candidates(q, least)] for at, forest, least in forests]
        for own, vector, *found in zip(own_ids.tolist(), q, *parts):
            found = np.concatenate(found)
            found = found[ids[found] != own]
            scores = x[found] @ vector
            at = best(ids[found], scores, k)
            yield own, ids[found][at], scores[at]

    return answer


def search(vectors: DataFrame, is_query: Column, k: int = 20, share: float = SHARE, shard: int = SHARD, trees: int = TREES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (see usable) where is_query, its k largest inner products with rows of other ids."""
    vectors = materialize(vectors, "forest-vectors")
    shards = max(1, -(-vectors.count() // shard))
    index = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")).withColumn("asks", F.lit(False))
    asked = vectors.where(is_query).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asks", F.lit(True))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held, answer = None, [], None
        for batch in batches:
            change = (batch[["n", "shard", "asks"]] != batch[["n", "shard", "asks"]].shift()).any(axis=1).cumsum()
            for _, rows in batch.groupby(change, sort=False):
                if group != (key := (rows["n"].iloc[0], rows["shard"].iloc[0])):
                    group, held, answer = key, [], None
                if not rows["asks"].iloc[0]:
                    held.append((rows["vec_id"].to_numpy(), np.stack(rows["v"].tolist())))
                    continue
                if answer is None:
                    if not held:
                        continue
                    answer, held = _answers(*map(np.concatenate, zip(*held)), share, k, trees), []
                for lo in range(0, len(rows), QUERIES):
                    some = rows.iloc[lo : lo + QUERIES]
                    for own, ids, scores in answer(some["vec_id"].to_numpy(), np.stack(some["v"].tolist())):
                        yield pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores})

    keys = ["n", "shard"]
    near = index.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "asks").mapInPandas(find, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(usable(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)
