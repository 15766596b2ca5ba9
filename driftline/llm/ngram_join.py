"""Near duplicates by an n-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

  1. A document's set is that of its hashed N-word shingles (fewer words: one shingle of them all). Documents of equal sets are
     one class from here on, found by a 128-bit digest of the set and numbered.
  2. Sets have BANDS * ROWS MinHash values; choose_bands() takes the most selective rows whose recall at the threshold reaches
     RECALL. Sets shuffle on band hashes; sets that share one are in a bucket. A pair at the threshold shares a band.
  3. Every pair that shares a band is verified on full sets. Buckets that overlap form a component. A component is compared as a
     whole where that moves fewer sets than going bucket by bucket: so a group of near copies, in nearly the same bucket in every
     band, is compared once. Where unlike texts are chained by common passages, its buckets are compared one by one, and a pair
     counts in the first band that it shares. Either way work goes in units of at most two blocks of about SPLIT sets: large
     groups are dealt over many units, small ones are packed together. A unit returns how many links each set has and a spanning
     forest of the links, never the pairs themselves, so a group of thousands gives thousands of rows.
  4. Components of the forests are the near-duplicate classes.
Links count documents: all others of the same set, and those of linked sets. Texts of candidate sets are fetched once each: a
bitmap of the wanted rows (at most BITMAP rows are broadcast, whatever the input) keeps most others out of the shuffle, and rows
that share id and text are one before it.

Words are runs of other than ASCII white space, compared as they are. Defined results: null, empty and blank texts have no set and
are in no pair (class_id is their own id, no links); null ids take part, class_id is the smallest id that is not null; repeated
rows are documents of their own; an empty table gives no rows; other columns are not read by links() and kept by keep_one(). Ids
pass Python as text, so that longs beside nulls stay what they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components

N = 5
THRESHOLD = (4, 5)
RECALL = 0.9999
MOST_HASHES = 128
SPLIT = 256
PACK = 400
#: Shingles that count as one set when units are sized, so that very long texts share a unit with fewer others.
WEIGHT = 4096
#: Rows of 64 bits in the bitmap of wanted rows.
BITMAP = 1 << 18
MEMO = 150_000


def choose_bands(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which some number of bands within `most` hashes finds pairs at the threshold with this probability."""
    for rows in range(most, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold**rows > 1e-12 else most + 1
        if bands * rows <= most:
            return bands, rows
    return most, 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_words = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str, n: int = N) -> np.ndarray:
    """The distinct hashed n-word shingles of a text, sorted."""
    ws = text.encode().split()
    w = np.fromiter(map(_words.__getitem__, ws), np.uint64, len(ws))
    if not len(w):
        return w
    span = min(n, len(w))
    s = np.full(len(w) - span + 1, span, np.uint64)
    for k in range(span):
        s = s * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - span + 1 + k]
    return np.unique(_mix(s))


class Signer:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1 << 62, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(1 << 63, size=bands * rows, dtype=np.uint64)
        self.powers = np.array([pow(0x100000001B3, k, 1 << 64) for k in range(rows)], np.uint64)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """The band hashes of a set."""
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), 2048):
            low = np.minimum(low, (self.a[:, None] * s[None, at : at + 2048] + self.b[:, None]).min(axis=1))
        each = _mix(low >> np.uint64(16)).reshape(self.bands, self.rows)
        return _mix((each * self.powers).sum(axis=1, dtype=np.uint64) * np.uint64(2 * self.bands + 1) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def _fingerprint(text: str):
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, f, digest, n_grams, bands) by document; digest and bands are null for texts without words."""
    bands, rows = choose_bands(threshold[0] / threshold[1])

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(bands, rows)
        for batch in batches:
            own = [shingles(text, n) for text in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "f": batch["f"], "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in own],
                "n_grams": [len(s) for s in own], "bands": [signer(s) if len(s) else None for s in own]})
        _words.clear()  # the worker goes on to other work

    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), _fingerprint(text_col).alias("f"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInPandas(sign, "doc_id string, f string, digest binary, n_grams int, bands array<long>").withColumn("doc_id", F.col("doc_id").cast("long"))


def linked(sizes: np.ndarray, parts: list[np.ndarray], left: int, threshold: tuple[int, int]) -> np.ndarray:
    """Which sets reach the threshold: a matrix of the first `left` sets against the others, or of all against all if there are no others."""
    flat, spot, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(parts)), sizes)
    again = times > 1
    column = np.cumsum(again) - 1
    keep = again[spot]
    column, owner = column[spot[keep]], owner[keep]
    right = slice(left, None) if left < len(parts) else slice(None)
    shared = np.zeros((left, len(parts[right])), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for lo in range(0, int(again.sum()), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        x = np.zeros((len(parts), min(4096, int(again.sum()) - lo)), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        shared += x[:left] @ x[right].T
    p, q = threshold
    out = (p + q) * shared >= p * (sizes[:left, None] + sizes[None, right])
    if left == len(parts):
        np.fill_diagonal(out, False)
    return out


def _unit(keys: np.ndarray, copies: np.ndarray, parts: list[np.ndarray], blocks: np.ndarray, band: int, bands: list, threshold: tuple[int, int]) -> tuple[list, list]:
    """((sid, links), ...) and spanning edges of one unit's sets, compared within a block or across its two. Pairs that share a band before `band` belong to other units."""
    order = np.argsort(blocks, kind="stable")
    keys, copies, parts = keys[order].tolist(), copies[order], [parts[i] for i in order]
    left = int((blocks == blocks.min()).sum())
    near = linked(np.array([len(p) for p in parts]), parts, left, threshold)
    if band > 0:
        early = np.stack([bands[i][:band] for i in order])
        right = early[left:] if left < len(parts) else early
        for k in range(band):
            near &= early[:left, k, None] != right[None, :, k]
    if left == len(parts):
        whole = near
    else:
        whole = np.zeros((len(parts), len(parts)), bool)
        whole[:left, left:] = near
        whole[left:, :left] = near.T
    links = whole @ copies.astype(np.int64)
    label = np.arange(len(parts))
    while True:
        lower = np.minimum(label, np.where(whole, label[None, :], len(parts)).min(axis=1, initial=len(parts)))
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    return [(keys[i], int(links[i])) for i in np.flatnonzero(links)], [(keys[i], keys[label[i]]) for i in range(len(keys)) if label[i] != i]


def verify(members: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(a, b, links): links of set a found by a unit (b null), or an edge of its spanning forest.

    members: (sid, place, band, blocks, weight, copies, bands, grams), a row for each set in each place: a component (band -1) or a bucket of a band.
    """
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    carried = ["place", "band", "sid", "copies", "bands", "grams"]
    packs = max(1, (members.where("blocks = 1").agg(F.sum("weight")).first()[0] or 0) // PACK)
    one = members.where("blocks = 1").select(F.pmod(F.xxhash64("place", "band"), F.lit(packs)).alias("pack"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), *carried)
    many = members.where("blocks > 1").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select(F.xxhash64("place", "band").alias("pack"), (F.least("own", "other") + 1).alias("i"), (F.greatest("own", "other") + 1).alias("j"), "own", *carried)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        across = rows["i"].iloc[0] != rows["j"].iloc[0]
        for (_, band), unit in rows.groupby(["place", "band"]):
            blocks = unit["own"].to_numpy()
            if len(unit) < 2 or (across and blocks.min() == blocks.max()):
                continue
            parts = [np.frombuffer(g, np.uint64) for g in unit["grams"]]
            links, edges = _unit(unit["sid"].to_numpy(), unit["copies"].to_numpy(), parts, blocks, int(band), unit["bands"].tolist(), threshold)
            out += [(a, None, x) for a, x in links] + [(a, b, 0) for a, b in edges]
        return pd.DataFrame({"a": pd.array([x[0] for x in out], "Int64"), "b": pd.array([x[1] for x in out], "Int64"), "links": pd.array([x[2] for x in out], "Int64")})

    return one.unionByName(many).groupBy("pack", "i", "j").applyInPandas(compare, "a long, b long, links long")


def _spot():
    """Where a row's bit is in the bitmap: (row, bit)."""
    h = F.xxhash64("doc_id", "f")
    return F.pmod(F.shiftright(h, 6), F.lit(BITMAP)).alias("spot"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")).alias("bit")


def gathered(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(sid, grams): the shingles of wanted texts (sid, rep_id, rep_f, written), each made once."""
    spot, bit = _spot()
    bitmap = wanted.select(F.col("rep_id").alias("doc_id"), F.col("rep_f").alias("f")).select(spot, bit).groupBy("spot").agg(F.bit_or("bit").alias("bits"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _fingerprint(text_col).alias("f")).select("*", spot, bit)
    rows = rows.join(F.broadcast(bitmap.withColumnRenamed("spot", "of")), (F.col("spot") == F.col("of")) & (F.col("bits").bitwiseAND(F.col("bit")) != 0))
    rows = rows.groupBy("doc_id", "f").agg(F.first("text").alias("text"))
    found = rows.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("f") == F.col("rep_f"))).select("sid", "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"sid": batch["sid"], "grams": [shingles(text, n).tobytes() for text in batch["text"]]})

    return found.mapInPandas(cut, "sid long, grams binary")


def places(members: DataFrame) -> DataFrame:
    """(sid, place, band, blocks) from (sid, weight, band, hash): where each set that shares a band is compared."""
    buckets = materialize(members.groupBy("band", "hash").agg(F.min("sid").alias("first"), F.count("*").alias("n"), F.sum("weight").alias("heavy")).where("n > 1"), "ngram-buckets")
    inside = members.join(buckets.withColumnsRenamed({"band": "b", "hash": "h"}), (F.col("band") == F.col("b")) & (F.col("hash") == F.col("h"))).drop("b", "h")
    inside = materialize(inside, "ngram-inside")
    groups = materialize(components(inside.select(F.col("sid").alias("a"), F.col("first").alias("b"))), "ngram-groups")
    blocks = F.ceil(F.col("heavy") / SPLIT).cast("int")
    each = groups.join(members.select("sid", "weight").distinct(), F.col("node") == F.col("sid"))
    sizes = each.groupBy(F.col("root").alias("comp")).agg(F.sum("weight").alias("heavy"), F.count("*").alias("n"))
    moved = (buckets.join(groups, F.col("first") == F.col("node")).groupBy(F.col("root").alias("of")).agg(F.sum(F.col("n") * blocks).alias("moved")))
    sizes = materialize(sizes.join(moved, F.col("comp") == F.col("of")).select("comp", blocks.alias("blocks"), (F.col("n") * blocks <= F.col("moved")).alias("whole")), "ngram-sizes")
    placed = materialize(groups.join(sizes, F.col("root") == F.col("comp")).select("node", "comp", "blocks", "whole"), "ngram-placed")
    whole = placed.where("whole").select(F.col("node").alias("sid"), F.col("comp").alias("place"), F.lit(-1).alias("band"), "blocks")
    parts = inside.join(placed.where("NOT whole").select("node"), F.col("sid") == F.col("node")).select("sid", F.col("hash").alias("place"), "band", blocks.alias("blocks"))
    return whole.unionByName(parts)


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, f, root, class_id, n_links) of every document: class_id is the smallest id of its near duplicates and its own; f the text's md5; root the class' number, null without words."""
    rows = materialize(sets(docs, id_col, text_col, n, threshold), "ngram-sets")
    classes = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "f")).alias("rep"), F.first("bands").alias("bands"), F.first("n_grams").alias("n_grams"))
    classes = materialize(classes.withColumn("sid", F.monotonically_increasing_id()), "ngram-classes")
    weight = F.ceil(F.col("n_grams") / WEIGHT).alias("weight")
    where = materialize(places(classes.select("sid", weight, F.posexplode("bands").alias("band", "hash"))), "ngram-places")
    known = where.select("sid").distinct().join(classes, "sid").select("sid", "copies", weight, "bands", F.col("rep.doc_id").alias("rep_id"), F.col("rep.f").alias("rep_f"))
    wanted = materialize(known, "ngram-wanted")
    grams = gathered(docs, wanted.select("sid", "rep_id", "rep_f"), id_col, text_col, n)
    grams = materialize(grams.join(wanted.select("sid", "copies", "weight", "bands"), "sid"), "ngram-grams")
    members = where.join(grams, "sid").withColumn("bands", F.when(F.col("band") > 0, F.col("bands")))
    result = materialize(verify(members, threshold), "ngram-links")
    number = result.where(F.col("b").isNull()).groupBy(F.col("a").alias("of")).agg(F.sum("links").alias("others"))
    tied = materialize(components(result.where(F.col("b").isNotNull()).select("a", "b")), "ngram-tied")
    known = classes.select("sid", "digest", "copies", "least").join(number, F.col("sid") == F.col("of"), "left").drop("of").join(tied, F.col("sid") == F.col("node"), "left").drop("node")
    known = materialize(known.select("digest", "least", F.coalesce("root", "sid").alias("root"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "ngram-known")
    heads = materialize(known.groupBy(F.col("root").alias("head")).agg(F.min("least").alias("class_id")), "ngram-heads")
    known = materialize(known.join(heads, F.col("root") == F.col("head")).select(F.col("digest").alias("of"), "root", "class_id", "n_links"), "ngram-known")
    with_set = rows.where(F.col("digest").isNotNull()).join(known, F.col("digest") == F.col("of")).select("doc_id", "f", "root", "class_id", "n_links")
    without = rows.where(F.col("digest").isNull()).select("doc_id", "f", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_set.union(without)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate class, that of the smallest id (nulls first; equal ids: smallest md5 of the text, then of the row); all texts without words stay."""
    found = materialize(links(docs), "ngram-result")
    same = found.where(F.col("root").isNotNull()).groupBy("root", "doc_id", "f").agg(F.count("*").alias("n"))
    keep = same.groupBy("root").agg(F.min(F.struct("doc_id", "f", "n")).alias("k"))
    keep = materialize(keep.select(F.col("k.doc_id").alias("keep_id"), F.col("k.f").alias("keep_f"), F.col("k.n").alias("keep_n")), "ngram-keep")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), _fingerprint("text").alias("f"), (F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == "").alias("blank"))

    def rows_of(ids: DataFrame) -> DataFrame:
        """ids are as many as classes: sorted and merged at every size."""
        return own.where(~F.col("blank")).join(ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("f") == F.col("keep_f")))

    kept, repeated = rows_of(keep.where("keep_n = 1")).select("doc"), keep.where("keep_n > 1")
    if not repeated.isEmpty():  # only rows that share id and text need whole rows to meet
        row = F.md5(F.to_json("doc", {"ignoreNullFields": "false"}))
        kept = kept.union(rows_of(repeated).groupBy("doc_id", "f").agg(F.min_by("doc", row).alias("doc")).select("doc"))
    return kept.union(own.where("blank").select("doc")).select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")
