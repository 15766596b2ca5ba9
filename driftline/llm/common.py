"""Pieces the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests on local[n])."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id's text modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null and blank texts."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


#: Equal rows that one task numbers at a time.
STEP = 10_000


def numbered(rows: DataFrame, copies: str, name: str) -> DataFrame:
    """Each row as often as its `copies` says, numbered from 1 in `name`. Rows of many copies are cut into runs of STEP, dealt out before they expand."""
    few = rows.where(F.col(copies) <= STEP).withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies).cast("long"))))
    many = rows.where(F.col(copies) > STEP).withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies).cast("long"), F.lit(STEP).cast("long"))))
    many = many.repartition(F.xxhash64(*[F.col(f"`{c}`") for c in (copies, name)]))
    run = F.sequence(F.col(name), F.least(F.col(name) + (STEP - 1), F.col(copies).cast("long")))
    return few.unionByName(many.withColumn(name, F.explode(run))).drop(copies)


def one_column_of(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have yet."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name
