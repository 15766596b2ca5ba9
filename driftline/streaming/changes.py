"""A stream of contents against a snapshot that is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.diff import status


def changes(stream: DataFrame, known: DataFrame, key: str = "key", content: str = "text") -> DataFrame:
    """(key, status, size, sha256) of a stream's rows (key, content) as they come, against a snapshot (key, size, sha256).

    A stream tells nothing of what is gone, so there is no DELETED. The snapshot is joined to each batch and keeps no state; rows of
    one key that come several times are each compared with the snapshot, not with each other.
    """
    rows = stream.select(F.col(key).alias("key"), F.octet_length(content).cast("long").alias("size"), F.sha2(content, 256).alias("sha256"))
    kept = known.select(F.col("key").alias("known_key"), F.col("sha256").alias("known_sha"))
    joined = rows.join(kept, F.col("key") == F.col("known_key"), "left")
    return joined.select("key", status(F.col("known_key"), F.col("key"), F.col("sha256").eqNullSafe(F.col("known_sha"))).alias("status"), "size", "sha256")
