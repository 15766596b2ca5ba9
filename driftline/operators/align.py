"""Pairing of deleted with added keys that a new version has only renamed.

Keys meet in buckets: of one content or one normalised path, and of the same first characters of every path segment, which
equivalent paths share. A deleted key takes the only added key of its own skeleton (the path without versions) that is left, or
where there is none the only equivalent one. Where every deleted key of a bucket has exactly one added key of its skeleton and the
reverse, which counts by skeleton tell, nobody competes and an equi-join on the skeleton pairs them, however many share the bucket.
Before contents are looked at, a skeleton that one deleted and one added key have pairs these, whatever they hold: else a file that
was edited would take a copy of its old text from the file that still has it, and that file would lose its own successor.
Only buckets with competitors are settled in key order, as an earlier pair can make a later candidate the only one. Before that, keys
without any candidate go: equivalent paths share a stem (what stands before a run of digits), so a key whose stems nobody on the
other side has is nobody's competitor. The keys that are left, not their pairs, come together; a key looks only at those that share
a stem, and no further than two of them.

Archives of one base name take each other without meeting: an archive is taken only while it is the only one of another version,
which can be so for two of a base name at most, and counts by version tell which. Base names near which a name without a version
stands, which competes by its common beginning, are settled from sorted names.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import paths, versions
from ..functions.text import version_normalized_path
from ..sources.tables import cut


def _two(candidates, d, fits) -> list:
    """The first candidate that fits, or the first two."""
    found = []
    for row in candidates:
        if fits(d, row):
            found.append(row)
            if len(found) == 2:
                break
    return found


def in_order(deleted: pd.DataFrame, added: pd.DataFrame, fits, stems) -> list[tuple[str, str]]:
    """Pairs of one bucket's keys (key, skeleton, ...), in the order of deleted keys. fits says whether a deleted row may take an added one; rows that may share one of their stems."""
    own, near, out = defaultdict(dict), defaultdict(dict), []
    for row in added.sort_values("key").itertuples(index=False):
        own[row.skeleton][row.key] = row
        for stem in stems(row.key):
            near[stem][row.key] = row
    for d in deleted.sort_values("key").itertuples(index=False):
        found = _two(own[d.skeleton].values(), d, fits)
        if not found:
            seen = {}
            for stem in stems(d.key):
                for row in _two(near[stem].values() if stem in near else (), d, fits):
                    seen[row.key] = row
            found = list(seen.values())
        if len(found) == 1:
            a = found[0]
            out.append((d.key, a.key))
            del own[a.skeleton][a.key]
            for stem in stems(a.key):
                del near[stem][a.key]
    return out


@F.pandas_udf(ArrayType(StringType()))
def _path_stems(keys: pd.Series) -> pd.Series:
    return keys.map(versions.path_stems)


def with_candidates(side: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of side that share a stem with one of the other side in their bucket."""
    stems, theirs = (x.select(*keys, "key", F.explode(_path_stems("key")).alias("stem")) for x in (side, other))
    live = stems.join(theirs.select(*keys, "stem").distinct(), [*keys, "stem"], "left_semi").select(*keys, "key").distinct()
    return side.join(live, [*keys, "key"], "left_semi")


def _settled(deleted: DataFrame, added: DataFrame, keys: list[str], pairs_of) -> DataFrame:
    def settle(d: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(pairs_of(d, a) if len(d) and len(a) else [], columns=["d", "a"])

    deleted, added = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (deleted, added))  # columns of their own: both may come from one diff
    return deleted.groupBy(*keys).cogroup(added.groupBy(*keys)).applyInPandas(settle, "d string, a string")


def _equivalent(d, a) -> bool:
    return versions.equivalent_paths(d.key, a.key)


def equivalent_pairs(deleted: DataFrame, added: DataFrame, bucket: str) -> DataFrame:
    """(d, a) of keys whose bucket is the same and whose paths are equivalent."""
    keys = ["bucket", "p"]
    d, a = (side.select("key", F.col(bucket).alias("bucket"), versions.prefix_key(F.col("key")).alias("p"), version_normalized_path(F.col("key")).alias("skeleton")).where("bucket IS NOT NULL") for side in (deleted, added))
    sizes = lambda side, n: side.groupBy(*keys, "skeleton").agg(F.count("*").alias(n), F.min("key").alias(f"{n}_key"))
    both = cut(sizes(d, "n_d").join(sizes(a, "n_a"), [*keys, "skeleton"], "full_outer"))
    alone = (F.col("n_d") == 1) & (F.col("n_a") == 1) & versions.equivalent_path(F.col("n_d_key"), F.col("n_a_key"))
    # A bucket is easy if nobody in it looks beyond their own skeleton, or at two there.
    easy = both.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("n_d").isNull() | alone, F.lit(False))).alias("easy"), F.count("n_d").alias("any_d"), F.count("n_a").alias("any_a"))
    easy = cut(easy.where("any_d > 0 AND any_a > 0").select(*keys, "easy"))
    pairs = both.where("n_d IS NOT NULL").join(easy.where("easy"), keys, "left_semi").select(F.col("n_d_key").alias("d"), F.col("n_a_key").alias("a"))
    hard = easy.where("NOT easy")
    if hard.isEmpty():
        return pairs
    d, a = cut(d.join(hard, keys, "left_semi")), cut(a.join(hard, keys, "left_semi"))
    return pairs.unionByName(_settled(with_candidates(d, a, keys), with_candidates(a, d, keys), keys, lambda x, y: in_order(x, y, _equivalent, versions.path_stems)))


class _Sorted:
    """Added archives by name, those taken skipped: the first two that begin like a name up to `least` characters, and not up to `most`."""

    def __init__(self, rows: list):
        self.rows = sorted(rows, key=lambda r: (r.stem, r.key))
        self.stems = [r.stem for r in self.rows]
        self.next = list(range(len(rows) + 1))
        self.place = {r.key: i for i, r in enumerate(self.rows)}

    def _alive(self, i: int) -> int:
        while self.next[i] != i:
            self.next[i] = self.next[self.next[i]]
            i = self.next[i]
        return i

    def take(self, key: str) -> None:
        if key in self.place:
            self.next[self.place[key]] = self.place[key] + 1

    def _range(self, prefix: str) -> tuple[int, int]:
        return bisect_left(self.stems, prefix), bisect_right(self.stems, prefix, key=lambda s: s[: len(prefix)])

    def near(self, stem: str):
        """Those whose common beginning with stem leaves both a tail."""
        digits = [i for i, c in enumerate(stem) if unicodedata.category(c) == "Nd"]
        if not digits or digits[-1] < versions.LEAST_PREFIX:
            return
        tail = len(stem)
        while tail > 0 and (stem[tail - 1] in "()._-" or unicodedata.category(stem[tail - 1]) == "Nd" or unicodedata.category(stem[tail - 1])[0] == "L"):
            tail -= 1
        low, high = self._range(stem[: max(versions.LEAST_PREFIX, tail)])
        skip, past = self._range(stem[: digits[-1] + 1])
        for a, b in ((low, max(low, skip)), (max(low, past), high)):
            i = self._alive(a)
            while i < b:
                yield self.rows[i]
                i = self._alive(i + 1)


def _archives_in_order(deleted: pd.DataFrame, added: pd.DataFrame) -> list[tuple[str, str]]:
    """Pairs of archives that share their first characters, some of them without a version."""
    rows = list(added.sort_values("key").itertuples(index=False))
    by_base, everyone = defaultdict(lambda: defaultdict(dict)), _Sorted(rows)
    unversioned = _Sorted([r for r in rows if r.version is None])
    for r in rows:
        if r.version is not None and r.base is not None:
            by_base[r.base][r.version][r.key] = r
    fits = lambda d, a: versions.same_base(d.name, a.name, d.version, a.version, d.base, a.base)
    out = []
    for d in deleted.sort_values("key").itertuples(index=False):
        if d.version is None:
            found = _two(everyone.near(d.stem), d, fits)
        else:
            others = (r for v, own in by_base[d.base].items() if v != d.version for r in own.values()) if d.base is not None and d.base in by_base else ()
            found = list(islice(others, 2)) + _two(unversioned.near(d.stem), d, fits)
        if len(found) == 1:
            a = found[0]
            out.append((d.key, a.key))
            everyone.take(a.key)
            unversioned.take(a.key)
            if a.version is not None and a.base is not None:
                del by_base[a.base][a.version][a.key]
    return out


def _by_base(deleted: DataFrame, added: DataFrame) -> DataFrame:
    """Pairs of versioned archives. Of one base name an added archive is the only one of another version for some deleted one if it is the only one, or all others share a version; so counts by version say which can be taken."""
    sizes = added.groupBy("base", "version").agg(F.count("*").alias("n"), F.min("key").alias("k"))
    least, most = F.min(F.struct("n", "version", "k")), F.max(F.struct("n", "version", "k"))
    kinds = sizes.groupBy("base").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), least.alias("x"), most.alias("y"))
    kinds = kinds.where("n = 1 OR (kinds = 2 AND x.n = 1)")
    # Alone: any other version takes it. One and one: whoever has one version takes the other. One and many: only the many's version takes it.
    v = F.col("version")
    may = F.when(F.col("n") == 1, v != F.col("x.version")).when(F.col("y.n") == 1, v.isin(F.col("x.version"), F.col("y.version"))).otherwise(v == F.col("y.version"))
    met = deleted.join(kinds, "base").select("base", "key", "version", "n", "x", "y", may.alias("may"))
    first = met.where("may").groupBy("base").agg(F.min(F.struct("key", "version")).alias("d"), F.first("n").alias("n"), F.first("x").alias("x"), F.first("y").alias("y"))
    takes_x = (F.col("n") == 1) | (F.col("y.n") > 1) | (F.col("d.version") == F.col("y.version"))
    first = first.select("base", "n", F.col("d.key").alias("d"), F.when(takes_x, F.col("x.k")).otherwise(F.col("y.k")).alias("a"), F.when(takes_x, F.col("y")).otherwise(F.col("x")).alias("left"))
    first = cut(first)
    rest = first.where("n = 2").select(F.col("base").alias("of"), F.col("d").alias("after"), "left")
    later = met.select("base", "key", "version").join(rest, F.col("base") == F.col("of")).where((F.col("key") > F.col("after")) & (F.col("version") != F.col("left.version")))
    later = later.groupBy("base").agg(F.min("key").alias("d"), F.first("left.k").alias("a"))
    return first.select("d", "a").unionByName(later.select("d", "a"))


def container_pairs(deleted: DataFrame, added: DataFrame) -> DataFrame:
    """Archives of one package in different versions: each takes the only one that is left."""
    is_archive = F.col("file_class").isin("ARCHIVE", "JAR")

    def side(df: DataFrame) -> DataFrame:
        f = paths.file_name(F.col("key"))
        own = df.where(is_archive).select("key", f.alias("name"), versions.stem(f).alias("stem"), versions.base_name(f).alias("base"), versions.version(f).alias("version"))
        return cut(own.where(F.length("stem") > versions.LEAST_PREFIX).withColumn("near", F.substring("stem", 1, versions.LEAST_PREFIX)))

    d, a, versioned = side(deleted), side(added), "base IS NOT NULL AND version IS NOT NULL"
    sizes = [x.agg(F.count("*").alias("n"), F.count_if(F.col("version").isNull()).alias("bare")).first() for x in (d, a)]
    if not all(x.n for x in sizes):
        return d.select(F.col("key").alias("d"), F.col("key").alias("a")).limit(0)
    if not any(x.bare for x in sizes):
        return _by_base(*(x.where(versioned) for x in (d, a)))
    odd = d.where("version IS NULL").select("near").join(a.select("near"), "near", "left_semi").union(a.where("version IS NULL").select("near").join(d.select("near"), "near", "left_semi")).distinct()
    odd = cut(odd)
    plain = [x.join(odd, "near", "left_anti").where(versioned) for x in (d, a)]
    near = [x.join(odd, "near", "left_semi") for x in (d, a)]
    return _by_base(*plain).unionByName(_settled(*near, ["near"], _archives_in_order))


def subfile_pairs(deleted: DataFrame, added: DataFrame, containers: DataFrame) -> DataFrame:
    """Keys under paired containers, at the same place below them. Containers end in / or !/."""
    mark = F.regexp_replace(F.col("key"), "!/", "/")
    own = deleted.select(F.col("key").alias("d"), mark.alias("m"), F.explode(paths.ancestors(mark)).alias("root"))
    moved = own.join(containers.select(F.regexp_replace("d", "!/", "/").alias("root"), F.regexp_replace("a", "!/", "/").alias("to")), "root")
    moved = moved.select("d", F.concat("to", F.expr("substring(m, length(root) + 1)")).alias("m"))
    return moved.join(added.select(F.col("key").alias("a"), mark.alias("m")), "m").select("d", "a")


def content_pairs(deleted: DataFrame, added: DataFrame) -> DataFrame:
    return equivalent_pairs(deleted, added, "content_key")


def path_pairs(deleted: DataFrame, added: DataFrame) -> DataFrame:
    skeleton = version_normalized_path(F.col("key"))
    return equivalent_pairs(deleted.withColumn("path", skeleton), added.withColumn("path", skeleton), "path")


def own_pairs(deleted: DataFrame, added: DataFrame) -> DataFrame:
    """(d, a, same) of equivalent keys whose skeleton nobody else has on either side, and whether their contents are equal."""
    side = lambda df, name: df.select(version_normalized_path(F.col("key")).alias("skeleton"), F.lit(name).alias("side"), "key", "content_key")
    of = lambda name: F.max(F.when(F.col("side") == name, F.struct("key", "content_key"))).alias(name)
    both = side(deleted, "d").unionByName(side(added, "a")).groupBy("skeleton").agg(of("d"), of("a"), F.count("*").alias("n")).where("n = 2 AND d IS NOT NULL AND a IS NOT NULL")
    same = F.coalesce(F.col("d.content_key") == F.col("a.content_key"), F.lit(False))
    return both.where(versions.equivalent_path(F.col("d.key"), F.col("a.key"))).select(F.col("d.key").alias("d"), F.col("a.key").alias("a"), same.alias("same"))


def align(diff: DataFrame, deleted_content: Column | None = None) -> DataFrame:
    """diff (key, status, file_class, old_sha, new_sha, old_content_key, new_content_key) with new_key and match_kind; paired rows are keyed by the old key, and the added rows they took are gone.

    Containers pair first, then what lies under them, then keys that are alone with their versioned path, then equal contents, then versioned paths. Each step's pairs and what they
    leave are cut, as the next step reads them several times.
    """
    diff = cut(diff)
    deleted = diff.where("status = 'DELETED'").select("key", "file_class", F.col("old_sha").alias("sha"), F.coalesce("old_content_key", "old_sha").alias("content_key"))
    added = diff.where("status = 'ADDED'").select("key", "file_class", F.col("new_sha").alias("sha"), F.coalesce("new_content_key", "new_sha").alias("content_key"))
    found = None
    left_d, left_a = deleted, added

    def take(pairs: DataFrame, kind: Column) -> None:
        nonlocal found, left_d, left_a
        pairs = cut(pairs.select("d", "a", kind.alias("kind")))
        found = pairs if found is None else found.unionByName(pairs)
        left_d = left_d.join(pairs.select(F.col("d").alias("key")), "key", "left_anti")
        left_a = left_a.join(pairs.select(F.col("a").alias("key")), "key", "left_anti")

    take(container_pairs(left_d, left_a), F.lit("CONTAINER"))
    take(subfile_pairs(left_d, left_a, found.select("d", "a")), F.lit("SUBFILE"))
    take(own_pairs(left_d, left_a), F.when(F.col("same"), "CONTENT").otherwise("PATH"))
    take(content_pairs(left_d, left_a), F.lit("CONTENT"))
    take(path_pairs(left_d, left_a), F.lit("PATH"))
    d = deleted.select(F.col("key").alias("d"), F.col("sha").alias("d_sha"), F.col("content_key").alias("d_content"))
    a = added.select(F.col("key").alias("a"), F.col("sha").alias("a_sha"), F.col("content_key").alias("a_content"))
    paired = found.join(d, "d").join(a, "a")
    same = (F.col("kind") == "CONTENT") | ((F.col("kind") != "PATH") & ((F.col("d_sha") == F.col("a_sha")) | ((F.col("kind") == "SUBFILE") & (F.col("d_content") == F.col("a_content")))))
    paired = paired.select(F.col("d").alias("key"), F.col("a").alias("new_key"), F.when(same, "UNCHANGED").otherwise("MODIFIED").alias("status"), F.col("kind").alias("match_kind"))
    rest = diff.join(found.select(F.col("d").alias("key")), "key", "left_anti").join(found.select(F.col("a").alias("key")), "key", "left_anti")
    kept = rest.select("key", F.when(F.col("status") != "DELETED", F.col("key")).alias("new_key"), "status", F.when(F.col("status").isin("ADDED", "DELETED"), "NONE").otherwise("KEY").alias("match_kind"))
    return kept.unionByName(paired)


def looked_up(aligned: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """asked with new_key, what an old key is called now if it is paired with another, and old_key, what a new key was called."""
    pairs = aligned.where("new_key IS NOT NULL AND new_key <> key AND match_kind NOT IN ('KEY', 'NONE')").select("key", "new_key")
    forth = pairs.select(F.col("key").alias("of_old"), "new_key")
    back = pairs.select(F.col("new_key").alias("of_new"), F.col("key").alias("old_key"))
    return asked.join(forth, F.col(key) == F.col("of_old"), "left").join(back, F.col(key) == F.col("of_new"), "left").drop("of_old", "of_new")
