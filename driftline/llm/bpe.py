"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than STRIDE code points is cut into chunks that start every STRIDE code points and reach OVERLAP beyond the next
start. Tasks pre-tokenise the chunks in parallel. A chunk's first pre-tokens may be off, as it can start inside one, and so may
its last ones; but a match of the pattern depends only on the text from its own start on, so from the first start that two
neighbouring chunks share, both agree. There the chunks are stitched, and each piece has the ids of its byte-pair merges. If two
neighbours share no start in the overlap (a run of one kind longer than it), the whole text is pre-tokenised in one piece.
Shorter texts are one chunk. Decoding concatenates the raw bytes of the ids.

Defined results: null texts are empty, with no ids; equal rows give equal rows; ids are unsigned 32-bit little-endian; an empty
table gives no rows; other columns of the documents are neither read nor returned. Ids pass Python as text, so that longs beside
nulls stay what they are.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRIDE = 16384
OVERLAP = 1024
#: Pieces a worker remembers at most; then it starts anew.
MEMO = 150_000

_loaded: dict[str, tuple] = {}


def load(path: str, pattern: str) -> tuple:
    """(compiled pattern, memo of ids by piece, encoder of one piece, bytes by id), once for each worker."""
    if path not in _loaded:
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            table[rank] = piece
        # The library's \s is Unicode's White_Space, of which the control characters 1C to 1F are no part.
        blank = r"\t-\r \x85\xa0  -     　"
        own = regex.compile(pattern.replace(r"[^\s", f"[^{blank}").replace(r"\s", f"[{blank}]").replace(r"\S", f"[^{blank}]"))
        _loaded[path] = own, {}, encoding._encode_single_piece, table
    return _loaded[path]


class _Coder:
    def __init__(self, path: str, pattern: str):
        self.pattern, self.memo, self.single, self.table = load(path, pattern)

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, packed."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        out = list(map(memo.get, pieces))
        if None in out:
            for i, piece in enumerate(pieces):
                if out[i] is None:
                    found = memo.get(piece)
                    if found is None:
                        found = memo[piece] = np.array(self.single(piece.encode()), "<u4").tobytes()
                    out[i] = found
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _digest_row(coder: _Coder, packed: bytes) -> tuple:
    return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(coder.decode(packed)).hexdigest()


def _ids_row(coder: _Coder, packed: bytes) -> tuple:
    return len(packed) // 4, packed, coder.decode(packed).decode("utf-8")


def stitch(coder: _Coder, chunks: list[tuple]) -> bytes:
    """The ids of a text from its chunks (start, own text, piece starts, packed ids by piece), in order."""
    starts, ids = chunks[0][2], chunks[0][3]
    for begin, _, more, more_ids in chunks[1:]:
        starts, ids = starts[:-2], ids[:-2]  # these may have met the end of their chunk
        at = np.intersect1d(starts[np.searchsorted(starts, begin):], more, assume_unique=True)
        if not len(at):
            return b"".join(coder.ids(coder.pieces("".join(c[1] for c in chunks))))
        keep, skip = np.searchsorted(starts, at[0]), np.searchsorted(more, at[0])
        starts, ids = np.concatenate([starts[:keep], more[skip:]]), ids[:keep] + more_ids[skip:]
    return b"".join(ids)


def encode(docs: DataFrame, vocab: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           row: Callable = _ids_row, schema: str = "n_tokens long, ids binary, decoded string", stride: int = STRIDE, overlap: int = OVERLAP) -> DataFrame:
    """A row for each document: (doc_id, n_tokens, ids, decoded text) by default; row and schema can ask for others of the ids."""
    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out, names = f"doc_id string, {schema}", ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _Coder(vocab, pattern)
        for batch in batches:
            rows = [(doc, *row(coder, b"".join(coder.ids(coder.pieces(text))))) for doc, text in zip(batch["doc_id"], batch["text"])]
            yield pd.DataFrame(rows, columns=names)

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _Coder(vocab, pattern)
        for batch in batches:
            found = []
            for text in batch["text"]:
                pieces = coder.pieces(text)
                ids = coder.ids(pieces)
                found.append((np.array([len(p) for p in pieces], "<u4").tobytes(), np.array([len(x) // 4 for x in ids], "<u4").tobytes(), b"".join(ids)))
            yield pd.concat([batch.assign(text=batch["text"].str[:stride]).reset_index(drop=True), pd.DataFrame(found, columns=["lengths", "counts", "ids"])], axis=1)

    def stitched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _Coder(vocab, pattern)
        for batch in batches:
            rows = []
            for doc, chunks in zip(batch["doc_id"], batch["chunks"]):
                parts = []
                for c in chunks:
                    lengths = np.frombuffer(c["lengths"], "<u4").astype(np.int64)
                    ends = np.cumsum(np.frombuffer(c["counts"], "<u4").astype(np.int64)) * 4
                    parts.append((c["begin"], c["text"], c["begin"] + np.cumsum(lengths) - lengths, [c["ids"][a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]))
                rows.append((doc, *row(coder, stitch(coder, parts))))
            yield pd.DataFrame(rows, columns=names)

    size = F.length("text")
    one = own.where(size <= stride).mapInPandas(short, out)
    many = (own.where(size > stride)
            .withColumn("rid", F.monotonically_increasing_id())
            .select("rid", "doc_id", "text", F.explode(F.sequence(F.lit(0), size - 1, F.lit(stride))).alias("begin"))
            .select("rid", "doc_id", "begin", F.expr(f"substring(text, begin + 1, {stride + overlap})").alias("text"))
            .mapInPandas(chunked, "rid long, doc_id string, begin int, text string, lengths binary, counts binary, ids binary")
            .groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("begin", "text", "lengths", "counts", "ids"))).alias("chunks"))
            .mapInPandas(stitched, out))
    return one.union(many).withColumn("doc_id", F.col("doc_id").cast("long"))


def decode(encoded: DataFrame, vocab: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """encoded with its bytes: what the ids of each row stand for, concatenated."""

    @F.pandas_udf("binary")
    def raw(ids: pd.Series) -> pd.Series:
        coder = _Coder(vocab, pattern)
        return ids.map(coder.decode, na_action="ignore")

    return encoded.withColumn("bytes", raw(F.col(ids_col)))


def digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, row=_digest_row,
                  schema="n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
