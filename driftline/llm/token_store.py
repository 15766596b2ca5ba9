"""Token ids in a content-addressed store.

Folders of a store, all Parquet:
  kind=chunk  digest, width, n, ids: each distinct chunk once; ids are unsigned little-endian, 2 or 4 bytes each (width)
  recipes     part, idx, doc_id, local_start, n_tokens, digests (16 bytes each, concatenated), ends (array: end of each chunk in
              the document's ids), root: in ascending doc_id order, nulls first; parts follow each other, local_start counts inside one
  manifest    part, n_docs, n_tokens, root: the Merkle root of a part's document roots; the store's root is over the parts'
A rolling hash over WINDOW ids ends a chunk where its high bits are zero, so documents that share a long passage share its chunks
wherever it stands; a chunk stops at LONGEST ids. A document's root is over its chunks' digests.

Tokenising splits a text at ASCII white space, which the tokenizer drops and never merges across, and remembers words' ids. That is
for files whose normalizer and pre-tokenizer are those of KNOWN; other files' texts go through the library whole.

Reading: each chunk is read once and its digest checked; document roots are made again from the recipes' digests, part roots from
these, and compared with the manifest, so swapped, lost or replaced chunks, recipes and parts all raise. crc32 is linear, so a document's crc32 is the exclusive or of its
chunks' crc32s, each moved by the bytes that follow it; documents(...) puts the ids themselves together.

Defined results: a null text is empty and has the end id only; equal rows are documents of their own, next to each other, that
share all chunks; null ids come first; an empty table makes an empty store; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import shared_dir

WINDOW = 8
MASK_BITS = 9
LONGEST = 8192
MEMO = 400_000
#: Documents encoded at a time.
DOCS = 500
RECIPES = "doc_id long, n_tokens long, digests binary, ends array<int>, part int, idx long, local_start long, root binary"
_PRIME = np.uint32(0x9E3779B1)

_loaded: dict[str, object] = {}


class _Pieces(dict):
    """Packed ids of pieces that the pre-tokenizer leaves whole, by the tokenizers library's merges."""

    def __init__(self, model):
        self.model = model
        # Byte-level merges see each byte as a printable character: Latin-1's own where it is one, else one from 256 on.
        own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.shown = {b: b for b in own} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - own))}

    def __missing__(self, piece: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
        found = self[piece] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return found


class _Words(dict):
    """Packed ids of words."""

    _plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
    _piece = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, tokenizer):
        self.tokenizer, self.pieces = tokenizer, _Pieces(tokenizer.model)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > MEMO:
            self.clear()
        if word.isalpha():
            found = self.pieces[word.lower().decode()]
        else:
            text = word.decode()
            if self._plain.fullmatch(text) and "<|" not in text:
                found = b"".join(map(self.pieces.__getitem__, self._piece.findall(text.lower())))
            else:
                found = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = found
        return found


#: Digest of the normalizer and pre-tokenizer (sorted JSON) that the split into words and pieces stands for.
KNOWN = "030f605e4f340b0458c72cba5c104920ded9b7910a25d9e82c455d4a8374b9a5"


def _settings(path: str) -> str:
    with open(path) as f:
        whole = json.load(f)
    return hashlib.sha256(json.dumps([whole.get("normalizer"), whole.get("pre_tokenizer")], sort_keys=True).encode()).hexdigest()


class WordEncoder:
    """Packed ids of texts by a tokenizer file, by way of memos of words and of the pieces its pre-tokenizer makes.

    Words of printable ASCII and Latin-1 letters are lower-cased and cut into pieces here, as the file's normalizer and
    pre-tokenizer would; unseen pieces go through the merges of the tokenizers library, all other words through the whole of it.
    """

    def __init__(self, path: str):
        if path not in _loaded:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            _loaded[path] = _Words(own) if _settings(path) == KNOWN else own
        self.words = _loaded[path]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Of texts in UTF-8."""
        if not isinstance(self.words, _Words):
            return [array("I", e.ids).tobytes() for e in self.words.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        get = self.words.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]


def chunk_ends(ids: np.ndarray, doc_ends: np.ndarray) -> np.ndarray:
    """Where chunks end, for documents laid end to end (doc_ends ascending; no document is empty)."""
    gear = (ids + np.uint32(1)) * _PRIME
    gear ^= gear >> np.uint32(15)
    rolled, weight = gear.copy(), 1
    for k in range(1, min(WINDOW, len(ids))):
        weight = weight * 0x01000193 & 0xFFFFFFFF
        rolled[k:] += gear[: len(ids) - k] * np.uint32(weight)
    starts = np.concatenate([[0], doc_ends[:-1]])
    hits = np.flatnonzero(rolled >> np.uint32(32 - MASK_BITS) == 0) + 1
    inside = hits - starts[np.searchsorted(doc_ends, hits, side="left")] >= WINDOW
    ends = np.union1d(hits[inside], doc_ends)
    sizes = np.diff(ends, prepend=0)
    over = [np.arange(end - size, end, LONGEST)[1:] for end, size in zip(ends.tolist(), sizes.tolist()) if size > LONGEST]
    return np.union1d(ends, np.concatenate(over)) if over else ends


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _objects(encoder: WordEncoder, batch: pa.RecordBatch, end_id: int, seen: set[bytes]) -> pa.RecordBatch:
    """Chunks that the task hasn't sent yet, and the recipes, of a batch of (doc_id, text)."""
    stop = np.array([end_id], "<u4").tobytes()
    packed = [p + stop for p in encoder.encode(batch.column(1).to_pylist())]
    ids, doc_ends = np.frombuffer(b"".join(packed), "<u4"), np.cumsum([len(p) // 4 for p in packed])
    ends = chunk_ends(ids, doc_ends)
    begins = np.concatenate([[0], ends[:-1]])
    width = np.where(np.maximum.reduceat(ids, begins) > 0xFFFF, 4, 2)
    raw4, raw2 = ids.tobytes(), ids.astype("<u2").tobytes()
    digests = [_digest(raw4[a:b]) for a, b in zip((4 * begins).tolist(), (4 * ends).tolist())]
    if len(seen) > 100_000:  # only spares repeats inside a task; the rest go in the shuffle
        seen.clear()
    fresh = [i for i, d in enumerate(digests) if not (d in seen or seen.add(d))]
    spans = zip(width[fresh].tolist(), begins[fresh].tolist(), ends[fresh].tolist())
    chunk_ids = [raw2[2 * a : 2 * b] if w == 2 else raw4[4 * a : 4 * b] for w, a, b in spans]
    first = np.concatenate([[0], np.searchsorted(ends, doc_ends, side="right")]).tolist()
    bases = np.concatenate([[0], doc_ends[:-1]])
    inner = (ends - np.repeat(bases, np.diff(first))).astype(np.int32)
    joined, n, m = b"".join(digests), len(fresh), len(packed)
    return pa.RecordBatch.from_arrays([
        pa.array(["chunk"] * n + ["doc"] * m),
        pa.array([digests[i] for i in fresh] + [joined[16 * a : 16 * b] for a, b in zip(first, first[1:])], pa.binary()),
        pa.array(np.concatenate([width[fresh], np.zeros(m, np.int64)]).astype(np.int32)),
        pa.array(np.concatenate([(ends - begins)[fresh], doc_ends - bases]).astype(np.int64)),
        pa.array(chunk_ids + [None] * m, pa.binary()),
        pa.array([None] * n + batch.column(0).to_pylist(), pa.int64()),
        pa.ListArray.from_arrays(pa.array([0] * n + first, pa.int32()), pa.array(inner)),
    ], names=["kind", "digest", "width", "n", "ids", "doc_id", "ends"])


def write(docs: DataFrame, path: str, vocab: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, each followed by end_id, and write them to a new store at path."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = WordEncoder(vocab), set()
        for whole in batches:
            for lo in range(0, whole.num_rows, DOCS):
                yield _objects(encoder, whole.slice(lo, DOCS), end_id, seen)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # equal chunks are neighbours
        for batch in batches:
            keep = []
            for kind, d in zip(batch.column("kind").to_pylist(), batch.column("digest").to_pylist()):
                keep.append(kind == "doc" or d != last)
                if kind == "chunk":
                    last = d
            yield batch.filter(pa.array(keep, pa.bool_()))

    schema = "kind string, digest binary, width int, n long, ids binary, doc_id long, ends array<int>"
    # Chunks of one digest meet in one partition; recipes are dealt by their digests and id, so equal texts don't meet.
    (own.mapInArrow(encoded, schema).repartition("digest", "doc_id").sortWithinPartitions("kind", "digest").mapInArrow(distinct, schema)
     .write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/objects"))

    stored = spark.read.schema(schema).parquet(f"{path}/objects").where("kind = 'doc'").select("doc_id", "n", "digest", "ends")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, idx, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            ends = np.cumsum(n)
            more = {"part": np.full(len(n), part, np.int32), "idx": np.arange(idx, idx + len(n)), "local_start": start + ends - n, "root": [_digest(d) for d in batch.column("digests").to_pylist()]}
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more.values())], names=[*batch.schema.names, *more])
            idx, start = idx + len(n), start + (int(ends[-1]) if len(ends) else 0)

    # Equal rows, whose order says nothing, are told apart so that many of them part.
    spread = F.xxhash64(F.monotonically_increasing_id())
    (stored.withColumnsRenamed({"n": "n_tokens", "digest": "digests"}).withColumn("spread", spread).repartitionByRange("doc_id", "digests", "spread").sortWithinPartitions("doc_id", "digests").drop("spread")
     .mapInArrow(numbered, RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes"))
    _manifest(recipes(spark, path)).write.parquet(f"{path}/manifest")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def _manifest(rows: DataFrame) -> DataFrame:
    """Merkle root by part: document roots, made from the recipes' digests, are hashed in order in runs of 1024, then the runs' hashes."""

    @F.pandas_udf("binary")
    def root(digests: pd.Series) -> pd.Series:
        return digests.map(_digest)

    rows = rows.select("part", "idx", "n_tokens", root("digests").alias("root"))
    runs = rows.groupBy("part", F.floor(F.col("idx") / 1024).alias("run")).agg(
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "root"))), lambda x: F.hex(x["root"])), ""), 256).alias("root"),
        F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    return runs.groupBy("part").agg(
        F.sum("n").alias("n_docs"), F.sum("tokens").alias("n_tokens"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "root"))), lambda x: x["root"]), ""), 256).alias("root"))


def _compared(spark: SparkSession, path: str) -> DataFrame:
    """(part, root, now) of every part that the manifest or the recipes have."""
    now = _manifest(recipes(spark, path)).select("part", F.col("root").alias("now"))
    kept = spark.read.schema("part int, n_docs long, n_tokens long, root string").parquet(f"{path}/manifest")
    return kept.select("part", "root").join(now, "part", "full_outer")


def broken_parts(spark: SparkSession, path: str) -> DataFrame:
    """Parts whose recipes don't give the manifest's root; no rows if the store is whole."""
    return _compared(spark, path).where(~F.col("root").eqNullSafe(F.col("now")))


def store_root(spark: SparkSession, path: str) -> DataFrame:
    kept = spark.read.schema("part int, n_docs long, n_tokens long, root string").parquet(f"{path}/manifest")
    return kept.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "root"))), lambda x: x["root"]), ""), 256).alias("root"))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest binary, width int, n long, ids binary, kind string").parquet(f"{path}/objects").where("kind = 'chunk'").drop("kind")


def _wide(width: int, ids: bytes) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo that of crc32, reflected."""
    a, b, out = a.astype(np.uint32), b.astype(np.uint32), np.zeros(len(a), np.uint32)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


def moved(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What crc32s contribute if n_bytes more follow."""
    out, power, n = crc.astype(np.uint32), np.array([0x00800000], np.uint32), n_bytes.astype(np.int64).copy()
    while n.any():
        odd = (n & 1).astype(bool)
        out[odd] = _times(out[odd], np.full(int(odd.sum()), power[0], np.uint32))
        power, n = _times(power, power), n >> 1
    return out


def _exploded(spark: SparkSession, path: str) -> DataFrame:
    """A row for each chunk of each document: part, idx, at, after (ids that follow), digest."""
    chunk = F.transform("ends", lambda end, i: F.struct(i.alias("at"), (F.col("n_tokens") - end).alias("after"), F.substring(F.col("digests"), 16 * i + 1, F.lit(16)).alias("digest")))
    return recipes(spark, path).select("part", "idx", F.explode(chunk).alias("c")).select("part", "idx", "c.*")


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, idx, doc_id, n_tokens, start) of the recipes, start being local_start and all ids of the parts before; raises where a part's root isn't the manifest's. There is one row by part to sum over."""
    rows = recipes(spark, path).select("part", "idx", "doc_id", "local_start", "n_tokens")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    parts = parts.join(_compared(spark, path), "part", "full_outer")
    whole = F.when(F.col("root").eqNullSafe(F.col("now")), F.coalesce("tokens", F.lit(0))).otherwise(F.raise_error(F.lit("a part's recipes don't give its root in the manifest")))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", whole.cast("long").alias("tokens")).select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
    return rows.join(parts, "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the store's files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            crcs = []
            for digest, width, ids in zip(batch["digest"], batch["width"], batch["ids"]):
                raw = _wide(width, ids)
                if _digest(raw) != digest:
                    raise ValueError(f"a chunk of {path} doesn't have the digest {digest.hex()}")
                crcs.append(zlib.crc32(raw))
            yield pd.DataFrame({"digest": batch["digest"], "n": batch["n"], "crc": np.array(crcs, np.int64)})

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(moved(crc.to_numpy(), 4 * after.to_numpy()).astype(np.int64))

    crcs = chunks(spark, path).mapInPandas(read, "digest binary, n long, crc long")
    by_doc = (_exploded(spark, path).join(crcs, "digest", "left").withColumn("moved", shifted(F.coalesce("crc", F.lit(0)), F.col("after")))
              .groupBy("part", "idx").agg(F.bit_xor("moved").alias("ids_crc32"), F.sum("n").alias("found"), F.count_if(F.col("crc").isNull()).alias("lost")))
    rows = _starts(spark, path)
    whole = F.when((F.col("found") == F.col("n_tokens")) & (F.col("lost") == 0), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document's chunks are not all there")))
    return rows.join(by_doc, ["part", "idx"]).select("doc_id", "start", "n_tokens", whole.alias("ids_crc32"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents' ids put together from their chunks, 4 bytes each."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"part": batch["part"], "idx": batch["idx"], "ids": [b"".join(_wide(c["width"], c["ids"]) for c in cs) for cs in batch["chunks"]]})

    whole = (_exploded(spark, path).join(chunks(spark, path), "digest")
             .groupBy("part", "idx").agg(F.sort_array(F.collect_list(F.struct("at", "width", "ids"))).alias("chunks")).mapInPandas(join, "part int, idx long, ids binary"))
    rows = _starts(spark, path)
    return rows.join(whole, ["part", "idx"]).select("doc_id", "start", "n_tokens", "ids")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    write(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return checksums(spark, path)
