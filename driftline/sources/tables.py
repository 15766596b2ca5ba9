"""Any keyed table as a snapshot."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def digest(columns: list[Column]) -> Column:
    """SHA-256 over columns as text, nulls apart from empty."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def snapshot(df: DataFrame, key: Column, content: Column, ordinal: Column | None = None) -> DataFrame:
    """(key, size, sha256, file_class) of a table, its last row by ordinal for each key. content is the text whose digest is compared."""
    own = df.select(key.alias("key"), F.octet_length(content).cast("long").alias("size"), F.sha2(content, 256).alias("sha256"), (ordinal if ordinal is not None else F.lit(0)).alias("_o"))
    one = own.groupBy("key").agg(F.max(F.struct("_o", "sha256", "size")).alias("r")) if ordinal is not None else own.select("key", F.struct("_o", "sha256", "size").alias("r"))
    return one.select("key", "r.size", "r.sha256", paths.file_class(F.col("key")).alias("file_class"))


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back, so that later steps don't plan and compute it anew. A folder of its own only where a local session names none."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
