"""Changes of public interfaces, who refers to what changed, and how risky that is."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import cut


def api_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(cls, level, api) from signatures (cls, api, ordinal) of both sides.

    A method name's first removed and first added signature, by ordinal, make one SIGNATURE_CHANGED; fields never do.
    """
    keys = ["cls", "api"]
    removed, added = old.join(new, keys, "left_anti"), new.join(old, keys, "left_anti")
    name = F.regexp_extract("api", r"^([^(]+)\([^)]*\)", 1)

    def first(side: DataFrame, c: str) -> DataFrame:
        return side.withColumn("name", name).where("name <> ''").groupBy("cls", "name").agg(F.min_by("api", "ordinal").alias(c))

    pairs = first(removed, "was").join(first(added, "now"), ["cls", "name"])
    changed = pairs.select("cls", F.lit("SIGNATURE_CHANGED").alias("level"), F.concat_ws(" → ", "was", "now").alias("api"))
    gone = removed.join(pairs.select("cls", F.col("was").alias("api")), keys, "left_anti").select("cls", F.lit("REMOVED_API").alias("level"), "api")
    fresh = added.join(pairs.select("cls", F.col("now").alias("api")), keys, "left_anti").select("cls", F.lit("ADDED_API").alias("level"), "api")
    return changed.unionByName(gone).unionByName(fresh)


def api_counts(changes: DataFrame) -> DataFrame:
    """One row: how many signatures went, changed and came."""
    n = lambda level, name: F.count_if(F.col("level") == level).alias(name)
    return changes.agg(n("REMOVED_API", "removed"), n("SIGNATURE_CHANGED", "changed"), n("ADDED_API", "added"))


def fqn(key: Column) -> Column:
    """A class' qualified name from its key: source or class file, without the folders that packages put in front."""
    k = F.regexp_replace(key, r"^(.*\.jar/)?((WEB-INF|BOOT-INF)/classes/)?", "")
    return F.replace(F.regexp_replace(k, r"\.(java|class)$", ""), F.lit("/"), F.lit("."))


def simple_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def package(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*)\.[^.]+$", 1)


def source_package(text: Column) -> Column:
    return F.regexp_extract(text, r"(?m)^\s*package\s+([\w.]+)\s*;", 1)


def source_imports(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;"), 1))


def references(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, source_key) where a source (key, fqn, pkg, imports, text) names a target and shares its package, imports it, or writes its full name; not itself.

    Sources are cut into their distinct words, which meet targets by simple name: no text is searched once per target.
    """
    word = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)"), 1))).alias("word")
    words = sources.select("key", "fqn", "pkg", word)
    named = targets.select("target", simple_name(F.col("target")).alias("word"), package(F.col("target")).alias("target_pkg"))
    found = words.join(named, "word").where(F.col("target") != F.col("fqn")).select("key", "target", (F.col("target_pkg") == F.col("pkg")).alias("near"))
    # Only those that neither share the package nor are the target itself need imports and text, and these travel once a source.
    far = found.where("NOT near").groupBy("key").agg(F.collect_set("target").alias("wanted"))
    imported = F.filter("wanted", lambda t: F.array_contains("imports", t) | F.contains(F.col("text"), t))
    written = sources.select("key", "imports", "text").join(far, "key").select(F.col("key").alias("source_key"), F.explode(imported).alias("target"))
    return found.where("near").select("target", F.col("key").alias("source_key")).unionByName(written.select("target", "source_key")).distinct()


def impact(targets: DataFrame, refs: DataFrame) -> DataFrame:
    """(target, status, risk, n_refs) of targets (target, deleted, signature_changed); who refers to a target are the rows of refs."""
    by = refs.select("target", "source_key").distinct().groupBy("target").agg(F.count("*").alias("n_refs"))
    rows = targets.join(by, "target", "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0)))
    risk = F.when(F.col("n_refs") == 0, "LOW").when(F.col("deleted"), "CRITICAL").when(F.col("signature_changed"), "HIGH").otherwise("MEDIUM")
    return rows.select("target", F.when(F.col("deleted"), "DELETED").otherwise("MODIFIED").alias("status"), risk.alias("risk"), "n_refs")


def longest_prefix(rows: DataFrame, prefixes: DataFrame, path: str, prefix: str, value: str, fallback: str) -> DataFrame:
    """rows with the value of the longest prefix that is a folder above path, else of the root prefix ''. Every folder above a path is looked up by equality."""
    from ..functions.paths import ancestors

    ups = rows.select(path, F.explode(F.array_union(ancestors(F.col(path)), F.array(F.lit("")))).alias(prefix)).distinct()
    best = ups.join(prefixes.select(prefix, value), prefix).groupBy(path).agg(F.max_by(value, F.length(prefix)).alias(value))
    return rows.join(best, path, "left").withColumn(value, F.coalesce(value, F.lit(fallback)))


def running_budget(rows: DataFrame, group: list[str], order: list, size: Column, per_item: int, total: int, least: int) -> DataFrame:
    """rows with given (what an item may take) and omitted: items in order take what they need, per_item at most, until less than least of total is left."""
    upto = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    want = F.least(size, F.lit(per_item))
    used = F.coalesce(F.sum(want).over(upto), F.lit(0))
    left = F.lit(total) - used
    return rows.withColumn("left_before", left).withColumn("given", F.when(left < least, 0).otherwise(F.least(want, left)).cast("long")).withColumn("omitted", F.col("left_before") < least)


def group_quotas(groups: DataFrame, total: int, order: list, key: str, need: str) -> DataFrame:
    """(key, quota): groups in order share what is left evenly among those still to come, and leave what they don't need.

    While more groups are to come than there is to share, a share is nothing; so only the last `total` groups can have any, and only
    they come together.
    """
    rows = groups.select(F.struct(*order).alias("o"), F.col(key).cast("string").alias("k"), F.col(need).cast("long").alias("n"))
    last = cut(rows.orderBy(F.desc("o"), F.desc("k")).limit(total)).withColumn("at", F.row_number().over(W.orderBy("o", "k")))

    def share(own: pd.DataFrame) -> pd.DataFrame:
        left, todo, out = total, len(own), []
        for k, n in own.sort_values("at")[["k", "n"]].itertuples(index=False):
            got = min(n, left // todo)
            out.append((k, got))
            left, todo = left - got, todo - 1
        return pd.DataFrame(out, columns=["k", "quota"])

    shared = last.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(share, "k string, quota long")
    rest = rows.select("k").join(last.select("k"), "k", "left_anti").select("k", F.lit(0).cast("long").alias("quota"))
    return shared.unionByName(rest).withColumnRenamed("k", key)


def without_added(targets: DataFrame, added: DataFrame) -> DataFrame:
    """targets (target, ...) that are not purely added classes (fqn): these can break nobody."""
    return targets.join(added.select(F.col("fqn").alias("target")), "target", "left_anti")
