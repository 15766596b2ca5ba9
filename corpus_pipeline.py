"""The corpus pipeline: rules, toxicity, near duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs. All but
the last return the columns of documents, whatever their names, in their order.

Defined results, for every stage: an empty table gives no rows; null ids are documents like others. Null, empty and blank texts fail
the rules' floor, are not toxic by themselves, are nobody's copies, have no words to be mixed, and have no ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe, mixing, ngram_join, quality_rules, toxicity
from driftline.llm.common import id_fold, one_column_of, shared_dir, table


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules reject go. Null language and source are groups of their own; equal rows stay or go together."""
    return quality_rules.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the models learn from labelled documents of docs outside the held-out fold. Equal texts stay or go together; without labels of both classes all stay, or go if all are toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), id_fold(F.col("doc_id"), 5) != 0)
    name = one_column_of(docs, "toxic_score")
    return toxicity.score(docs, model, docs.columns, name=name).where(F.col(name) < 0.5).drop(name)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest id, nulls first, then of the smallest digests of text and row; texts without words all stay."""
    return ngram_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is one of its own; equal rows are drawn one by one."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each document's ids and of what they decode to, a row for each document, repeated ones too."""
    return bpe.digests(docs)


STAGES = [
    ("quality_rules", quality_rule_stage),
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", token_stage),
]

#: Neither the learned models nor byte-pair merges can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
