"""A diff as people go through it: filters, orders, pages and totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import labels, paths
from . import diff as d

#: Bytes of an entry's content that is kept with it at most.
MEMO = 64 << 10


@dataclass(frozen=True)
class Filters:
    """What the tree shows; what is empty lets all pass."""

    statuses: tuple[str, ...] = ()
    risks: tuple[str, ...] = ()
    search: str = ""
    regex: bool = False


def with_risk(rows: DataFrame, risks: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """rows whose risk (key, risk) is wanted; all of them where nothing is wanted or nothing has been judged yet."""
    if not wanted or risks.isEmpty():
        return rows
    return rows.join(risks.where(F.col("risk").isin(*wanted)).select("key").distinct(), "key", "left_semi")


def filtered(rows: DataFrame, filters: Filters, risks: DataFrame | None = None, excluded: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """rows (key, status) that pass filters, aren't excluded (key) and meet no view rule (type, value)."""
    if filters.statuses:
        rows = rows.where(F.col("status").isin(*filters.statuses))
    rows = rows.where(d.matches(filters.search, F.col("key"), filters.regex))
    if excluded is not None:
        rows = rows.join(excluded.select("key"), "key", "left_anti")
    if rules is not None:
        rows = d.without_rules(rows, rules)
    return with_risk(rows, risks, filters.risks) if risks is not None else rows


def line_diffable(rows: DataFrame, limit: int) -> DataFrame:
    """Entries of a diff on both sides, of a class that is compared by line, and no larger than limit."""
    return rows.where(paths.is_text_diffable(F.col("file_class")) & (F.col("old_size") <= limit) & (F.col("new_size") <= limit))


def without_flattened(entries: DataFrame) -> DataFrame:
    """entries (key) without those below an archive that is an entry itself, as container/x or container!/x."""
    archive = paths.file_class(F.col("key")).isin("ARCHIVE", "JAR")
    above = entries.select("key", F.explode(paths.ancestors(F.col("key"))).alias("container")).withColumn("container", F.regexp_replace("container", "!$", ""))
    inside = above.join(entries.where(archive).select(F.col("key").alias("container")).distinct(), "container", "left_semi").select("key").distinct()
    return entries.join(inside, "key", "left_anti")


def by_risk(then: str = "status") -> list[Column]:
    return [F.desc("rank"), *(by_status() if then == "status" else by_name())]


def by_status() -> list[Column]:
    return [labels.status_rank(F.col("status")).asc(), F.asc("key")]


def by_name() -> list[Column]:
    return [paths.file_name(F.col("key")).asc(), F.asc("key")]


def in_tree() -> list[Column]:
    """Folders before files at every level. A path's order is that of its segments, the last of a file's after all folders."""
    parts = F.split("key", "/")
    return [F.transform(parts, lambda x, i: F.concat(F.when((F.col("kind") == "FILE") & (i == F.size(parts) - 1), "1").otherwise("0"), x)).asc()]


def page(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows in an order, with pos. Only these are numbered."""
    if "risk" in rows.columns:
        rows = rows.withColumn("rank", labels.risk_rank(F.col("risk")))
    return rows.orderBy(*order).limit(k).withColumn("pos", F.row_number().over(W.orderBy(*order)).cast("long"))


def risk_counts(risks: DataFrame) -> DataFrame:
    """One row: how many of each risk, and the highest."""
    n = lambda r: F.count_if(F.col("risk") == r).alias(r.lower())
    return risks.agg(*[n(r) for r in ("CRITICAL", "HIGH", "MEDIUM", "LOW")], F.max_by("risk", labels.risk_rank(F.col("risk"))).alias("most"))


def layers(rows: DataFrame) -> DataFrame:
    """(layer, n, pos): entries by layer, in the order L0, L1, L2, others."""
    pos = F.when(F.col("layer") == "L0", 1).when(F.col("layer") == "L1", 2).when(F.col("layer") == "L2", 3).otherwise(4)
    return rows.groupBy("layer").agg(F.count("*").alias("n")).withColumn("pos", pos.cast("long"))


def class_split(classes: DataFrame) -> DataFrame:
    """(jar, unchanged, failed, beyond) of classes (jar, status, read): read is null where a class was not among those shown."""
    unchanged, failed = F.count_if(F.col("status") == "UNCHANGED"), F.count_if(~F.col("read"))
    return classes.groupBy("jar").agg(unchanged.alias("unchanged"), failed.alias("failed"), (F.count("*") - unchanged - failed - F.count_if("read")).alias("beyond"))


def usage(answers: DataFrame, answer: str, by: str) -> DataFrame:
    """(by, prompt_tokens, completion_tokens, calls) summed over answers in JSON."""
    n = lambda c: F.coalesce(F.sum(F.get_json_object(answer, f"$.usage.{c}").cast("long")), F.lit(0)).alias(c)
    return answers.groupBy(by).agg(n("prompt_tokens"), n("completion_tokens"), F.count("*").alias("calls"))


def held_bytes(entries: DataFrame, size: str) -> DataFrame:
    """(held, entries): bytes of contents small enough to be kept with their entries."""
    small = F.col(size) <= MEMO
    return entries.agg(F.coalesce(F.sum(F.when(small, F.col(size))), F.lit(0)).alias("held"), F.count_if(small).alias("entries"))
