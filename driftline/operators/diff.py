"""Comparison of two snapshots by key, and what is counted over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import labels, paths, text


def status(old: Column, new: Column, same: Column) -> Column:
    """A key's status from a column that is null on a side without it."""
    return F.when(new.isNull(), "DELETED").when(old.isNull(), "ADDED").when(same, "UNCHANGED").otherwise("MODIFIED")


def snapshot_diff(old: DataFrame, new: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, status, old_size, new_size, old_sha, new_sha, file_class) of every key of either side.

    Sides are (key, size, sha256), one row a key. A missing digest on both sides says nothing: sizes decide, and hash_skipped is
    true. One full outer join on the key; contents are joined afterwards, by those that need them.
    """
    o = old.select("key", F.struct("size", "sha256", *extra).alias("o"))
    n = new.select("key", F.struct("size", "sha256", *extra).alias("n"))
    skipped = F.coalesce(F.nullif("o.sha256", F.lit("")), F.nullif("n.sha256", F.lit(""))).isNull() & F.col("o").isNotNull() & F.col("n").isNotNull()
    same = F.when(skipped, False).otherwise(F.col("o.sha256").eqNullSafe(F.col("n.sha256")))
    return o.join(n, "key", "full_outer").select(
        "key", status(F.col("o"), F.col("n"), same).alias("status"),
        F.col("o.size").alias("old_size"), F.col("n.size").alias("new_size"), F.col("o.sha256").alias("old_sha"), F.col("n.sha256").alias("new_sha"),
        paths.file_class(F.col("key")).alias("file_class"), skipped.alias("hash_skipped"),
        *[F.col(f"o.{c}").alias(f"old_{c}") for c in extra], *[F.col(f"n.{c}").alias(f"new_{c}") for c in extra])


def refine(diff: DataFrame, old_normal: Column, new_normal: Column, limit: int) -> DataFrame:
    """MODIFIED texts whose normal forms are equal become UNCHANGED, with formatted_only. Both sides at most limit bytes, both text."""
    text = paths.is_text_diffable(F.col("file_class")) | paths.is_known_text(F.col("key"))
    equal = (F.col("status") == "MODIFIED") & text & (F.col("old_size") <= limit) & (F.col("new_size") <= limit) & (old_normal == new_normal)
    equal = F.coalesce(equal, F.lit(False))
    return diff.withColumn("formatted_only", equal).withColumn("status", F.when(equal, "UNCHANGED").otherwise(F.col("status")))


def count_status(name: str) -> Column:
    return F.count_if(F.col("status") == name)


def stats(diff: DataFrame) -> DataFrame:
    """One row of counts; changed keys are library jars or the rest."""
    changed = F.col("status") != "UNCHANGED"
    return diff.agg(
        count_status("ADDED").alias("added"), count_status("DELETED").alias("deleted"), count_status("MODIFIED").alias("modified"), count_status("UNCHANGED").alias("unchanged"),
        F.count_if(changed & ~paths.is_lib_jar(F.col("key"))).alias("biz_changed"), F.count_if(changed & paths.is_lib_jar(F.col("key"))).alias("jar_changed"))


def type_breakdown(diff: DataFrame) -> DataFrame:
    """Changes by category, and a row of category null for all."""
    return (diff.where("status <> 'UNCHANGED'").withColumn("category", paths.category_label(F.col("file_class")))
            .rollup("category").agg(count_status("ADDED").alias("added"), count_status("DELETED").alias("deleted"), count_status("MODIFIED").alias("modified"), F.count("*").alias("total")))


def class_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(jar, inner, status) of classes inside libraries; sides are (jar, inner, sha256)."""
    o, n = old.withColumnRenamed("sha256", "o"), new.withColumnRenamed("sha256", "n")
    return o.join(n, ["jar", "inner"], "full_outer").select("jar", "inner", status(F.col("o"), F.col("n"), F.col("o") == F.col("n")).alias("status"))


def class_rollup(classes: DataFrame) -> DataFrame:
    """Counts of classes by jar, and a row of jar null for all."""
    return classes.rollup("jar").agg(*[count_status(s).alias(s.lower()) for s in ("ADDED", "DELETED", "MODIFIED", "UNCHANGED")])


def top_classes(classes: DataFrame, k: int) -> DataFrame:
    """The first k changed classes over all jars, in order of jar, status and name, numbered. Only k rows are numbered."""
    order = ["jar", labels.status_rank(F.col("status")), "inner"]
    return classes.where("status <> 'UNCHANGED'").orderBy(*order).limit(k).withColumn("pick", F.row_number().over(W.orderBy(*order)))


def listing_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of two archive listings (name, size, crc32) by size and checksum; directories (trailing slash) only by presence."""
    o, n = (side.select("name", F.struct("size", "crc32").alias(x)) for side, x in ((old, "o"), (new, "n")))
    is_dir = F.col("name").endswith("/")
    same = is_dir | ((F.col("o.size") == F.col("n.size")) & (F.col("o.crc32") == F.col("n.crc32")))
    return o.join(n, "name", "full_outer").select(
        "name", is_dir.alias("is_dir"), status(F.col("o"), F.col("n"), same).alias("status"), F.col("o.size").alias("old_size"), F.col("n.size").alias("new_size"), F.col("o.crc32").alias("old_crc"), F.col("n.crc32").alias("new_crc"))


def folder_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, status, changes, type) of two folders (path, type, size, mtime_ms, sha256), compared by attributes; equal or equally unknown digests are equal contents."""
    l, r = (side.select("path", F.struct("type", "size", "mtime_ms", "sha256").alias(x)) for side, x in ((left, "l"), (right, "r")))
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    file = both & (F.col("l.type") == "FILE") & (F.col("r.type") == "FILE")
    changes = F.array_compact(F.array(
        F.when(both & (F.col("l.type") != F.col("r.type")), "TYPE"), F.when(file & ~F.col("l.size").eqNullSafe(F.col("r.size")), "SIZE"),
        F.when(file & ~F.col("l.mtime_ms").eqNullSafe(F.col("r.mtime_ms")), "MTIME"), F.when(file & ~F.col("l.sha256").eqNullSafe(F.col("r.sha256")), "CONTENT")))
    state = F.when(F.col("l").isNull(), "RIGHT_ONLY").when(F.col("r").isNull(), "LEFT_ONLY").when(F.col("l.type") != F.col("r.type"), "TYPE_MISMATCH").when(F.size(changes) == 0, "SAME").otherwise("MODIFIED")
    kind = F.when(both & (F.col("l.type") != F.col("r.type")), "FILE").otherwise(F.coalesce("l.type", "r.type"))
    return l.join(r, "path", "full_outer").select("path", state.alias("status"), changes.alias("changes"), kind.alias("type"), both.alias("both"), F.col("l").isNotNull().alias("in_left"), F.col("r").isNotNull().alias("in_right"), F.col("l.type").alias("left_type"), F.col("r.type").alias("right_type"),
        *[F.col(f"{s}.{c}").alias(f"{side}_{c}") for s, side in (("l", "left"), ("r", "right")) for c in ("size", "mtime_ms")])


def folder_summary(diff: DataFrame) -> DataFrame:
    def n(c):
        return F.count_if(c)

    s, content = F.col("status"), F.array_contains("changes", "CONTENT")
    return diff.agg(
        n(s == "SAME").alias("same"), n(s == "MODIFIED").alias("modified"), n(s == "LEFT_ONLY").alias("left_only"), n(s == "RIGHT_ONLY").alias("right_only"), n(s == "TYPE_MISMATCH").alias("type_mismatch"),
        n((s == "MODIFIED") & content).alias("content_changed"), n((s == "MODIFIED") & ~content).alias("attr_only_changed"),
        (n(F.col("left_type") == "FILE") + n(F.col("right_type") == "FILE")).alias("scanned_files"), (n(F.col("left_type") == "DIR") + n(F.col("right_type") == "DIR")).alias("scanned_dirs"))


def subtree_differs(diff: DataFrame, differs: Column, path: str = "path") -> DataFrame:
    """(dir, differs) of every folder above the rows: whether anything below it differs."""
    return diff.select(F.explode(paths.ancestors(F.col(path))).alias("dir"), differs.alias("d")).groupBy("dir").agg(F.bool_or("d").alias("differs"))


def ignored(keys: DataFrame, extensions: DataFrame, key: str = "key") -> DataFrame:
    """keys without those that end with an ignored extension (any case; dots optional; '.' alone is none). Candidates meet on the suffixes of a key's name, so the rules need not be small."""
    rules = extensions.select(F.concat(F.lit("."), F.regexp_replace(F.lower(F.trim("ext")), r"^\.+", "")).alias("ext")).where("ext <> '.'").distinct()
    parts = F.split(F.lower(paths.file_name(F.col(key))), r"\.")
    suffixes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(F.lit("."), F.array_join(F.slice(parts, i, F.size(parts)), ".")))).otherwise(F.array().cast("array<string>"))
    hit = keys.select(key, F.explode(suffixes).alias("ext")).join(rules, "ext").select(key).distinct()
    return keys.join(hit, key, "left_anti")


def distinct_rules(rules: DataFrame) -> DataFrame:
    return rules.dropDuplicates(["type", "value"])


def with_rule(rules: DataFrame, kind: str, value: str) -> DataFrame:
    """rules (at, type, value) with one more at their end, unless it is there. A user's list of rules."""
    new = rules.sparkSession.createDataFrame([(kind, value)], "type string, value string").join(rules, ["type", "value"], "left_anti")
    end = rules.agg(F.coalesce(F.max("at") + 1, F.lit(0)).alias("at"))
    return rules.unionByName(end.join(F.broadcast(new)).select(F.col("at").cast(rules.schema["at"].dataType), "type", "value"))  # one row each


def without_rule(rules: DataFrame, at: int) -> DataFrame:
    """rules without the one at a place from 0; those behind it move up. A place that isn't there removes none."""
    return rules.where(F.col("at") != at).withColumn("at", F.col("at") - F.when(F.col("at") > at, 1).otherwise(0) if at >= 0 else F.col("at"))


def without_rules(keys: DataFrame, rules: DataFrame, key: str = "key") -> DataFrame:
    """keys without those a view rule (type, value) names: exact keys, everything at or below a prefix, file names, extensions.

    A key meets rules by equality, on the few values that each type of rule can have for it.
    """
    k = F.col(key)
    name = paths.file_name(k)

    def of(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias("value"))

    values = F.concat(F.array(of("exact", k), of("prefix", k), of("name", name), of("ext", F.lower(F.substring_index(name, ".", -1)))), F.transform(paths.ancestors(k), lambda a: of("prefix", a)))
    value = F.when(F.col("type") == "ext", F.lower(F.regexp_replace("value", r"^\.+", ""))).otherwise(F.regexp_replace("value", "/$", ""))
    named = keys.select(k, F.explode(values).alias("r")).select(key, "r.*").join(rules.select("type", value.alias("value")).distinct(), ["type", "value"]).select(key).distinct()
    return keys.join(named, key, "left_anti")


def matches(search: str, key: Column, regex: bool = False) -> Column:
    """Whether keys contain a text or match a pattern, in any case; an empty search or a broken pattern lets all pass."""
    if not search:
        return F.lit(True)
    if not regex:
        return F.contains(F.lower(key), F.lit(search.lower()))
    pattern = text.valid_pattern(f"(?i){search}")
    return key.rlike(pattern) if pattern else F.lit(True)


def tree(diff: DataFrame) -> DataFrame:
    """(key, depth, kind, files): every entry and every folder above one, with the number of files below it."""
    dirs = diff.select(F.explode(paths.ancestors(F.col("key"))).alias("key")).groupBy("key").agg(F.count("*").alias("files")).select("key", F.lit("DIR").alias("kind"), "files")
    both = dirs.unionByName(diff.select("key", F.lit("FILE").alias("kind"), F.lit(1).cast("long").alias("files")))
    return both.select("key", paths.depth(F.col("key")).cast("long").alias("depth"), "kind", "files")


def increment(diff: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(bucket, key, text) of what an upgrade takes: added and modified entries from the new side by their new key, deleted ones from the old side."""
    fresh = diff.where(F.col("status").isin("ADDED", "MODIFIED")).select(F.coalesce("new_key", "key").alias("key"))
    gone = diff.where("status = 'DELETED'").select("key")
    return new.join(fresh, "key").select(F.lit("increment").alias("bucket"), "key", "text").unionByName(old.join(gone, "key").select(F.lit("deleted").alias("bucket"), "key", "text"))


# What a small export has at most (files, bytes), and bytes written in a second.
SMALL_EXPORT, EXPORT_RATE = (20_000, 256 << 20), 40 << 20


def export_estimate(diff: DataFrame) -> DataFrame:
    """(files, bytes, small, eta_s) of the changed entries."""
    size = F.when(F.col("status") == "DELETED", F.col("old_size")).otherwise(F.col("new_size"))
    sums = diff.where("status <> 'UNCHANGED'").agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    return sums.select("files", "bytes", ((F.col("files") <= SMALL_EXPORT[0]) & (F.col("bytes") <= SMALL_EXPORT[1])).alias("small"), F.ceil(F.col("bytes") / EXPORT_RATE).cast("long").alias("eta_s"))


def outside_containers(diff: DataFrame, containers: DataFrame) -> DataFrame:
    """diff without what lies inside containers (key) that were added or deleted whole."""
    inside = F.when(F.contains(F.col("key"), F.lit("!/")), F.get(paths.compound(F.col("key")), 0))
    return diff.withColumn("_container", inside).join(containers.select(F.col("key").alias("_container")).distinct(), "_container", "left_anti").drop("_container")


def without_pseudo_directories(entries: DataFrame) -> DataFrame:
    """entries (key, size) without empty ones that have entries below them: folders that an archive lists without their slash."""
    dirs = entries.select(F.explode(paths.ancestors(F.col("key"))).alias("key")).distinct()
    pseudo = entries.where("size = 0").join(dirs, "key", "left_semi").select("key").distinct()
    return entries.join(pseudo, "key", "left_anti")
