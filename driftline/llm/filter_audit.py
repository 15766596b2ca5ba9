"""Filter interaction audit: what each of five filters removes in each of their 120 orders, by source.

Failure conditions (words are runs of anything but ASCII white space): A: fewer than 50 words; B: 100 * distinct words < 65 * words;
C: 100 * capitals A-Z > 5 * code points; D: any of #$%&*|; E: the text is that of a document with a smaller doc_id, anywhere in
the table, removed or not.

Tasks read each text once, as bytes, and keep (doc_id, part, digest, four bits). E comes from the smallest id of each digest: only
digests with two ids or more are joined back, their minima are made by partial aggregation, and rows are joined, not paired, so a
group of copies of any size stays linear. With its five bits a document is one of 32 cells. Per task, np.bincount counts the cells
by part and label; FIRST, a table of 32 cells by 120 orders, holds the step at which an order removes a cell, and a second
np.bincount adds the cells up by part, order, step and label. The partial arrays of all tasks are summed by part, order and step;
kept and Shapley sums are windows over 5 and 120 rows. A task holds arrays for PARTS parts at most and sends them off beyond that.

Defined results: a null text is empty; a null source is the part '' (as an empty one is); a null doc_id is neither smaller than
another nor has a smaller one, and has no labels; repeated rows count each, and a row with the same id is not a smaller one; of
labels that repeat an id, any 1 counts, null labels are no 1; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, b"#$%&*|"
#: Parts whose counts a task holds at a time.
PARTS = 128
_CAPITALS, _TAILS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(0x80, 0xC0))
_GOOD, _TOXIC = (1, 3), (2, 3)


def first_failures() -> np.ndarray:
    """[cell, order]: the step, from 1, whose filter is the first of the order that the cell fails; 0 if it passes all. Bit k of a cell: fails FILTERS[k]."""
    bits = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    fails = (np.arange(32)[:, None, None] >> bits) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2) + 1, 0)


FIRST = first_failures()


def text_bits(text: bytes) -> int:
    """Which of A to D a text, as UTF-8, fails."""
    words = text.split()  # at ASCII white space
    points = len(text) if text.isascii() else len(text.translate(None, _TAILS))
    return ((len(words) < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
            | (100 * (len(text) - len(text.translate(None, _CAPITALS))) > MOST_CAPITALS * points) << 2
            | (len(text.translate(None, MARKS)) < len(text)) << 3)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, digest, cell) of each document, E not yet judged."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, cells = [], []
            for text in batch.column("text"):
                text = text.as_py()
                digests.append(hashlib.sha256(text).digest())
                cells.append(text_bits(text))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(cells, pa.int32())], names=["doc_id", "part", "digest", "cell"])

    return own.mapInArrow(read, "doc_id long, part string, digest binary, cell int")


def judged(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cell, label) of each document from measure(), materialised; label: 1 if good, plus 2 if toxic."""
    ids = measured.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(F.col("digest").alias("of"), "least")
    marks = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("marked"))
             .agg((F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")) + 2 * F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int"))).alias("label")).where("label > 0"))
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")
    return (measured.join(ids, F.col("digest") == F.col("of"), "left").join(marks, F.col("doc_id") == F.col("marked"), "left")
            .select("part", (F.col("cell") + 16 * copy).alias("cell"), F.coalesce("label", F.lit(0)).alias("label")))


_SUMS = ("docs", "fails", "unique_fails", "removed", "good_lost", "toxic_lost")


def _sums(parts: list[str], cells: np.ndarray) -> pa.RecordBatch:
    """A row for each part, order and step from cells[part, cell, label]."""
    n, orders = len(parts), len(ORDERS)
    at = ((np.arange(n)[:, None, None] * orders + np.arange(orders)) * 6 + FIRST[None])[..., None] * 4 + np.arange(4)  # [part, cell, order, label]
    weights = np.broadcast_to(cells[:, :, None, :], at.shape)
    gone = np.bincount(at.ravel(), weights.ravel(), n * orders * 24).astype(np.int64).reshape(n, orders, 6, 4)[:, :, 1:]
    by_cell = cells.sum(axis=2)
    place = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])  # [order, step]
    fails = np.stack([by_cell[:, (np.arange(32) >> k) & 1 == 1].sum(axis=1) for k in range(5)], axis=1)
    sums = (np.broadcast_to(by_cell.sum(axis=1)[:, None, None], gone.shape[:3]), fails[:, place], by_cell[:, 1 << place],
            gone.sum(axis=3), gone[..., _GOOD].sum(axis=3), gone[..., _TOXIC].sum(axis=3))
    names = pa.array(np.repeat(np.array(parts, object), orders * 5), pa.string())
    where = [np.tile(np.repeat(np.arange(orders, dtype=np.int32), 5), n), np.tile(np.arange(1, 6, dtype=np.int32), n * orders)]
    return pa.RecordBatch.from_arrays([names, *map(pa.array, where), *(pa.array(np.ascontiguousarray(x).ravel().astype(np.int64)) for x in sums)], names=["part", "at", "step", *_SUMS])


def partial_sums(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """(part, at, step, _SUMS) of each task's rows (part, cell, label); a task holds the counts of so many parts at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            whole = _sums(list(held), np.stack(list(held.values())))
            held.clear()
            return whole

        for batch in batches:
            coded = batch.column("part").dictionary_encode()
            names = coded.dictionary.to_pylist()
            at = (coded.indices.to_numpy().astype(np.int64) * 32 + batch.column("cell").to_numpy()) * 4 + batch.column("label").to_numpy()
            cells = np.bincount(at, minlength=len(names) * 128).reshape(len(names), 32, 4)
            for k, name in enumerate(names):
                if name in held:
                    held[name] = held[name] + cells[k]
                    continue
                held[name] = cells[k]
                if len(held) >= parts:
                    yield sent()
        if held:
            yield sent()

    return rows.select("part", "cell", "label").mapInArrow(count, "part string, at int, step int, " + ", ".join(f"{c} long" for c in _SUMS))


def audit(rows: DataFrame) -> DataFrame:
    """The audit of rows (part, cell, label): one row for each part, order and step."""
    whole = partial_sums(rows).groupBy("part", "at", "step").agg(*[F.sum(c).alias(c) for c in _SUMS])
    upto = W.partitionBy("part", "at").orderBy("step")
    of_filter = W.partitionBy("part", "filter")
    order = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("at") + 1)
    return (whole.withColumn("kept", F.col("docs") - F.sum("removed").over(upto)).withColumn("filter_order", order)
            .withColumn("filter", F.substring("filter_order", F.col("step"), 1)).withColumn("shapley", F.sum("removed").over(of_filter))
            .select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"))


def query(spark, sf_dir: str) -> DataFrame:
    measured = materialize(measure(table(spark, sf_dir, "documents")), "audit-cells")
    return audit(judged(measured, table(spark, sf_dir, "labels")))


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), marks AS (
  SELECT doc_id AS id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    concat(CASE WHEN len(w) < 50 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
      CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS cell
  FROM d LEFT JOIN marks ON doc_id = id
), cells AS (
  SELECT part, cell, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_bad FROM f GROUP BY part, cell
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS f, filter_order[:step - 1] AS earlier FROM orders, range(1, 6) r(step)
), cases AS (
  SELECT part, filter_order, step, f, n, n_good, n_bad, cell, contains(cell, f) AS fails, cell <> '' AND regexp_matches(cell, '[' || earlier || '0]') AS gone FROM cells, steps
), sums AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (cell = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(n_bad) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM cases GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM sums
"""
