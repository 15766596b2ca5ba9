"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a class' sample has at most.
BYTES = 48 << 20


def fitting(drawn: list, most_bytes: int) -> list:
    """Of rows with label and n, in order, those that fit into what their label has left of most_bytes."""
    left, out = {}, []
    for r in drawn:
        if r["n"] <= left.setdefault(r["label"], most_bytes):
            left[r["label"]] -= r["n"]
            out.append(r)
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, per_class: int, most_bytes: int = BYTES) -> pd.DataFrame:
    """(text, label) of at most per_class documents and most_bytes of text of each class, as pandas on the driver.

    Documents are drawn in the order of md5(doc_id) and taken whole; one that doesn't fit into what is left of most_bytes is left out,
    those after it are not, so no text can cost a class the others. labels may repeat ids (the larger label counts) or lack them;
    may_learn is a condition on labels' doc_id. Of documents with equal ids the smallest text is taken. Ids and sizes of the draw, at
    most 2 * per_class rows, come to the driver before any text does, and the chosen ids are broadcast.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & may_learn)
             .groupBy(F.col("doc_id").cast("long").alias("known_id")).agg(F.max(label).alias("label")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sized = (own.select("doc_id", F.octet_length("text").cast("long").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
             .join(known, F.col("doc_id") == F.col("known_id")).withColumn("draw", F.md5(F.col("doc_id").cast("string"))))
    sized = sized.where(F.col("n") <= most_bytes).select("known_id", "label", "draw", "n")
    drawn = [r for c in (0, 1) for r in sized.where(F.col("label") == c).orderBy("draw", "known_id").limit(per_class).collect()]
    chosen = docs.sparkSession.createDataFrame([tuple(r)[:3] for r in fitting(drawn, most_bytes)], "known_id long, label int, draw string")
    rows = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("known_id")).groupBy("doc_id", "label", "draw").agg(F.min("text").alias("text")).toPandas()
    return rows.sort_values(["draw", "doc_id"]).reset_index(drop=True)[["text", "label"]]
