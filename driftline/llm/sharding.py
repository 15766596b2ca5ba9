"""Sharding by extendible hashing (native DataFrame operations only).

The directory is indexed by the first bits of a hash. A bucket of more than LIMIT bytes and more than one document splits on the
next bit, others stay, so shards have prefixes of different lengths; the shard of a document is its shortest prefix whose bucket
need not split. Bytes are summed once by the prefixes of a first directory depth, a few bits over what the total calls for; all
shallower prefixes come from these sums. Only documents in buckets that are still too large go on, 8 bits deeper each round.

The hash is over id, text and an ordinal among equal rows, so that equal rows, even a third of all, can part. Equal rows are
counted first, then numbered from their count in runs that are dealt over tasks; no task gathers them.

Defined results: null ids and texts are values of their own, with no bytes; a document over LIMIT has a shard of its own; at BITS
bits a bucket stays as it is; an empty table gives no rows; shard is the prefix in binary, '' for the only one. Where documents have a
column of that name, the new one has an underscore in front (as many as it takes).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, one_column_of

LIMIT = 16 << 20
BITS = 60
SPARE = 3
STEP = 8


def _prefix(h: Column, depth: Column) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, ordinal, h) for each row: equal rows are counted, then numbered."""
    fingerprint = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    same = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), fingerprint.alias("f")).groupBy("doc_id", "n_bytes", "f").agg(F.count("*").alias("copies"))
    each = numbered(same, "copies", "ordinal")
    return each.select("doc_id", "n_bytes", "ordinal", _hash(F.col("doc_id"), F.col("f"), F.col("ordinal")).alias("h"))


def _hash(id_: Column, fingerprint: Column, ordinal: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), fingerprint, ordinal.cast("string")))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def assign(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """rows (with n_bytes and h, materialised) with shard, depth and shard_bytes."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(total / limit, 1)))) + SPARE)
    done, pending = [], rows
    while True:
        cells = pending.groupBy(_prefix(F.col("h"), F.lit(high)).alias("slot")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
        each = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("prefix", F.call_function("shiftright", F.col("slot"), (F.lit(high) - F.col("depth")).cast("int")))
        buckets = each.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("docs"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("docs") <= 1) | (F.col("depth") == BITS)
        slots = (each.select("slot", "depth", "prefix").join(buckets.where(fits).withColumnsRenamed({"depth": "d", "prefix": "p"}), (F.col("depth") == F.col("d")) & (F.col("prefix") == F.col("p")), "left")
                 .groupBy("slot").agg(F.min(F.when(F.col("d").isNotNull(), F.struct("d", "shard_bytes"))).alias("leaf")))
        slots = materialize(slots.select("slot", F.col("leaf.d").alias("depth"), F.col("leaf.shard_bytes").alias("shard_bytes")), "shard-directory")
        placed = pending.withColumn("slot", _prefix(F.col("h"), F.lit(high))).join(slots, "slot").drop("slot")
        done.append(placed.where(F.col("depth").isNotNull()))
        if slots.where(F.col("depth").isNull()).isEmpty():
            break
        pending = materialize(placed.where(F.col("depth").isNull()).drop("depth", "shard_bytes"), "shard-pending")
        low, high = high + 1, min(BITS, high + STEP)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    bits = F.lpad(F.conv(_prefix(F.col("h"), F.col("depth")).cast("string"), 10, 2), F.col("depth").cast("int"), F.lit("0"))
    return out.withColumn("shard", F.when(F.col("depth") == 0, "").otherwise(bits))


def shard_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs (all columns) with `shard`, or a longer name that docs don't have. Rows equal in every column are counted and numbered; the hash is over all columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    each = numbered(whole.groupBy("doc").agg(F.count("*").alias("copies")), "copies", "ordinal")
    fingerprint = F.md5(F.to_json("doc", {"ignoreNullFields": "false"}))
    each = each.select("doc", F.coalesce(F.octet_length("doc.text"), F.lit(0)).cast("long").alias("n_bytes"), _hash(F.lit("row"), fingerprint, F.col("ordinal")).alias("h"))
    placed = assign(materialize(each, "shard-rows"), limit)
    return placed.select("doc.*", F.col("shard").alias(one_column_of(docs, "shard")))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write docs as Parquet, a folder for each shard (its prefix follows an x)."""
    sharded, name = shard_documents(docs, limit), one_column_of(docs, "shard")
    sharded.withColumn(name, F.concat(F.lit("x"), F.col(name))).repartition(name).write.partitionBy(name).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign(materialize(hashed(docs), "shard-hashes")).select("doc_id", "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes")


SQL = f"""
WITH rows AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, md5(coalesce(text, '')) AS f, row_number() OVER (PARTITION BY doc_id, strlen(coalesce(text, '')), md5(coalesce(text, ''))) AS ordinal FROM documents
), hashes AS (
  SELECT doc_id, n_bytes, row_number() OVER () AS rid, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || f || ':' || ordinal), 1, {BITS // 4}))::BIGINT AS h FROM rows
), each AS (
  SELECT rid, doc_id, n_bytes, h, d FROM hashes, range(0, {BITS + 1}) t(d)
), sums AS (
  SELECT *, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS docs FROM each WINDOW w AS (PARTITION BY d, h >> ({BITS} - d))
)
SELECT doc_id, n_bytes, depth, shard_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> ({BITS} - depth)), depth, '0') END AS shard
FROM (SELECT rid, any_value(doc_id) AS doc_id, any_value(n_bytes) AS n_bytes, any_value(h) AS h, min(d)::INTEGER AS depth, arg_min(shard_bytes, d)::BIGINT AS shard_bytes
      FROM sums WHERE shard_bytes <= {LIMIT} OR docs <= 1 OR d = {BITS} GROUP BY rid)
"""
