"""What lies inside archives, addressed as a!/b!/c: listings as a tree of both versions, and contents read only along the way.

The tree goes depth by depth. A step joins the archives that are open with the names wanted of each, opens every archive once, and
carries on nothing but what was asked for: names, and bytes of the archives that are opened next. Where whole addresses are given, an
archive meets all of its own once, and is opened as deep as they lead.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import beautify, paths, versions
from ..operators import diff, lines
from .archives import decode_text, office_text, row_by_row
from .tables import cut

# How deep a tree goes, how many nodes it has, how large an entry is read.
DEPTH, NODES, MOST_BYTES = 12, 20_000, 64 << 20
# Fixed value: the short hash of what isn't there.
NO_HASH = "0000000"
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError, RuntimeError, NotImplementedError)


def listing(data: bytes) -> dict[str, tuple[int, int]]:
    """Names of an archive with size and checksum; folders end in a slash, those only implied by names too, and an empty entry that others lie below is one."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = {i.filename: (0, 0) if i.is_dir() else (i.file_size, i.CRC) for i in z.infolist()}
    folders = {name[: k + 1] for name in found for k, c in enumerate(name) if c == "/"}
    found = {name: x for name, x in found.items() if not (x[0] == 0 and f"{name}/" in folders)}
    return found | {f: (0, 0) for f in folders}


def resolved(names: list[str], wanted: str) -> str | None:
    """A name of an archive: as it is, else the only file of the same package in another version."""
    if wanted in names:
        return wanted
    found = [n for n in names if not n.endswith("/") and versions.same_package(wanted, n)]
    return found[0] if len(found) == 1 else None


def listings(containers: DataFrame) -> DataFrame:
    """(root, key, name, size, crc, error) of the entries of archives (root, key, bytes); one row with an error of those that can't be read."""

    def read(root: str, key: str, data: bytes) -> Iterator[tuple]:
        try:
            yield from [(root, key, name, size, crc, None) for name, (size, crc) in listing(data).items()]
        except BROKEN as e:
            yield root, key, None, None, None, type(e).__name__

    return row_by_row(containers.select("root", "key", "bytes"), read, "root string, key string, name string, size long, crc long, error string")


def entry(z: zipfile.ZipFile, wanted: str) -> bytes | None:
    """An entry of an open archive by its resolved name; none if it isn't there, is a folder, too large or can't be read."""
    found = wanted if wanted in z.NameToInfo else resolved(z.namelist(), wanted)
    if found is None or found.endswith("/") or z.getinfo(found).file_size > MOST_BYTES:
        return None
    try:
        return z.read(found)
    except BROKEN:
        return None


#: Names that are sent to where the archives are; more are joined to them by shuffling both.
NAMES = 500_000


def met(containers: DataFrame, asked: DataFrame, keys: list[str], n: int) -> DataFrame:
    """containers with what is asked of them. Bytes stay where they are unless too many names are asked."""
    return containers.join(F.broadcast(asked) if n <= NAMES else asked, keys)


def read_entries(containers: DataFrame, wanted: DataFrame) -> DataFrame:
    """(root, key, bytes) of wanted (root, key, name) entries of archives (root, key, bytes), keyed as they were asked for; those that aren't there or can't be read have no row."""
    n = wanted.count()
    names = wanted.groupBy("root", "key").agg(F.collect_set("name").alias("names"))  # an archive's own names at most

    def read(root: str, key: str, data: bytes, names: list[str]) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for name in names:
                    own = entry(z, name)
                    if own is not None:
                        yield root, f"{key}!/{name}", own
        except BROKEN:
            return

    return row_by_row(met(containers, names, ["root", "key"], n).select("root", "key", "bytes", "names"), read, "root string, key string, bytes binary")


def _rank(status: Column) -> Column:
    return F.when(status == "MODIFIED", 0).when(status == "DELETED", 1).when(status == "ADDED", 2).otherwise(3)


_NODE = ["root", "key", "parent", "name", "depth", "status", "file_class", "is_dir", "old_size", "new_size", "old_crc", "new_crc", "path"]


def tree(old: DataFrame, new: DataFrame, ignored: DataFrame | None = None, depth: int = DEPTH, most: int = NODES) -> DataFrame:
    """(at, root, key, parent, name, depth, status, file_class, is_dir, sizes, checksums, expandable, error): both versions of archives (root, bytes), opened down to `depth`.

    at numbers the nodes of a root from 1, each before those below it, siblings by status and name; a root has the first `most`. After
    each depth nodes beyond that are left out, as nodes still to come can only push them further back, so no depth opens more
    archives than that. ignored: extensions (ext) left out.
    """
    sides = [x.select("root", F.col("root").alias("key"), "bytes") for x in (old, new)]  # read twice, as they were given
    known = failed = None
    for level in range(depth):
        o, n = (cut(listings(side)) for side in sides)
        broken = o.unionByName(n).where("error IS NOT NULL").groupBy("root", "key").agg(F.min("error").alias("error"))
        failed = broken if failed is None else failed.unionByName(broken)
        o, n = (x.where("error IS NULL").select("root", "key", "name", F.struct("size", "crc").alias(c)) for x, c in ((o, "o"), (n, "n")))
        both = o.join(n, ["root", "key", "name"], "full_outer")
        is_dir = F.col("name").endswith("/")
        both = both.withColumns({"is_dir": is_dir, "status": diff.status(F.col("o"), F.col("n"), is_dir | (F.col("o") == F.col("n")))})
        if ignored is not None:
            both = both.where("is_dir").unionByName(diff.ignored(both.where("NOT is_dir"), ignored, "name").select(*both.columns))
        step = F.struct(_rank(F.col("status")).alias("rank"), F.col("name").alias("name"))
        if known is None:
            both = both.withColumn("path", F.array(step))
        else:
            both = both.join(known.where(F.col("depth") == level - 1).select("root", F.col("key"), F.col("path").alias("above")), ["root", "key"]).withColumn("path", F.concat("above", F.array(step)))
        nodes = both.select("root", F.concat("key", F.lit("!/"), "name").alias("key"), F.col("key").alias("parent"), "name", F.lit(level).alias("depth"), "status",
                            F.when(F.col("is_dir"), "OTHER").otherwise(paths.file_class(F.col("name"))).alias("file_class"), "is_dir",
                            *[F.when(~F.col("is_dir"), F.col(f"{s}.{c}")).alias(f"{'old' if s == 'o' else 'new'}_{c}") for c in ("size", "crc") for s in ("o", "n")], "path").select(*_NODE)
        every = nodes if known is None else known.select(*_NODE).unionByName(nodes)
        order = W.partitionBy("root").orderBy("path")  # a root's nodes: `most`, and those of one depth below them
        known = cut(every.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most))
        wanted = known.where((F.col("depth") == level) & F.col("file_class").isin("ARCHIVE", "JAR") & ~F.col("is_dir")).select("root", F.col("parent").alias("key"), "name")
        if level + 1 == depth or wanted.isEmpty():
            break
        sides = [cut(read_entries(side, wanted)) for side in sides]
    failed = cut(failed.groupBy("root", "key").agg(F.min("error").alias("error")))
    expandable = F.col("file_class").isin("ARCHIVE", "JAR") & ~F.col("is_dir")
    return known.join(failed, ["root", "key"], "left").select("at", *_NODE[:-1], expandable.alias("expandable"), "error")


def _opened(data: bytes | None) -> zipfile.ZipFile | None:
    try:
        return None if data is None else zipfile.ZipFile(io.BytesIO(data))
    except BROKEN:
        return None


def reached(contents: list[bytes | None], asked: list[tuple[str, list[str]]]) -> Iterator[tuple]:
    """(key, *contents) of what is asked (key, names on the way) of archives of several versions. An archive on the way is opened once, and one entry of each version is held at a time."""
    if all(x is None for x in contents):
        return
    below: dict[str, list] = {}
    for key, way in asked:
        if way:
            below.setdefault(way[0], []).append((key, way[1:]))
        else:
            yield key, *contents
    if below:
        boxes = [_opened(x) for x in contents]
        for name, further in below.items():
            yield from reached([z and entry(z, name) for z in boxes], further)


def inner_bytes(files: DataFrame, keys: DataFrame, missing: bool = True, names: DataFrame | None = None) -> DataFrame:
    """(snapshot, key, contents) of keys (snapshot, key as a!/b!/c) in archives (snapshot, name, contents). Contents are one column of bytes, or several for versions of an archive under one name, which are read side by side. A key that leads nowhere has none, or, without `missing`, no row, and then its bytes are not shuffled.

    An archive or entry that isn't there under its name is the only one of the same package in another version, if there is one. What
    is asked of an archive meets it once, at any number of keys, and it is opened there as deep as they lead: bytes of archives are
    shuffled once. names: (snapshot, name) of the files where these are known without their bytes; files are read once then.
    """
    sides = [c for c in files.columns if c not in ("snapshot", "name")]
    keys = cut(keys.select("snapshot", "key", paths.compound(F.col("key")).alias("parts")).distinct())
    tops = keys.select("snapshot", F.get("parts", 0).alias("key")).distinct()
    names = cut((files if names is None else names).select("snapshot", "name"))
    exact = tops.join(names, (tops["snapshot"] == names["snapshot"]) & (F.col("key") == F.col("name"))).select(tops["snapshot"], "key", "name")
    lost = tops.join(names, (tops["snapshot"] == names["snapshot"]) & (F.col("key") == F.col("name")), "left_anti")

    def stemmed(df: DataFrame, c: str) -> DataFrame:
        f = paths.file_name(F.col(c))
        return df.withColumns({"version": versions.version(f), "base": versions.base_name(f)}).where("base IS NOT NULL AND version IS NOT NULL")

    a, b = stemmed(lost, "key"), stemmed(names, "name").withColumnsRenamed({"snapshot": "s", "base": "b", "version": "v"})
    other = (a.join(b, (F.col("snapshot") == F.col("s")) & (F.col("base") == F.col("b"))).where("version <> v")
             .groupBy("snapshot", "key").agg(F.min("name").alias("name"), F.count("*").alias("n")).where("n = 1").drop("n"))
    chosen = exact.unionByName(other).withColumnRenamed("key", "top").distinct()
    ways = keys.select("snapshot", F.get("parts", 0).alias("top"), F.struct("key", F.slice("parts", F.lit(2), F.size("parts")).alias("way")).alias("asked"))
    asked = ways.join(chosen, ["snapshot", "top"]).groupBy("snapshot", "name").agg(F.collect_list("asked").alias("asked"))  # an archive's own keys at most

    def read(snapshot: str, asked: list[dict], *contents: bytes | None) -> Iterator[tuple]:
        for row in reached(list(contents), [(x["key"], x["way"]) for x in asked]):
            yield snapshot, *row

    # Keys are hashed and archives only pass by: bytes that are not sorted don't spill.
    found = files.join(asked.hint("shuffle_hash"), ["snapshot", "name"]).select("snapshot", "asked", *sides)
    done = row_by_row(found, read, ", ".join(["snapshot string", "key string", *(f"{c} binary" for c in sides)]))
    return keys.select("snapshot", "key").join(done, ["snapshot", "key"], "left") if missing else done


def _listing_lines(data: bytes) -> list[str]:
    rows = sorted(listing(data).items())
    return [f"{size:>12} {'--------' if name.endswith('/') else format(crc, '08x')} {'d' if name.endswith('/') else '-'} {name[:512]}" for name, (size, crc) in rows[:50_000]]


def _read(key: str, data: bytes, file_class: str, way: str) -> tuple[str | None, str | None, str | None, str]:
    """(text, spread, error, hash) of an entry by the way of its class; spread is the form of minified scripts and styles, which is made here, so that no other process gets the text for it."""
    text = spread = error = None
    try:
        if way == "listing":
            text = "\n".join(_listing_lines(data))
        elif way == "office":
            text, error = office_text(key, data)
        elif way == "text":
            text = decode_text(data)
            spread = beautify.spread_form(text, file_class)
        else:
            error = f"{file_class} has no text"
    except BROKEN as e:
        error = f"{type(e).__name__}"
    return text, spread, error, hashlib.sha1(data).hexdigest()[:7] if data else NO_HASH


def readable(rows: DataFrame) -> DataFrame:
    """(key, side, text, spread, error, hash) of entries (key, side, bytes): listings of archives, texts of office documents, decoded texts; what has no text has an error."""

    def read(key: str, side: str, data: bytes, file_class: str, way: str) -> Iterator[tuple]:
        yield key, side, *_read(key, data, file_class, way)

    cls = _class()
    return row_by_row(rows.select("key", "side", "bytes", cls.alias("file_class"), route(cls).alias("route")), read, "key string, side string, text string, spread string, error string, hash string")


def _class() -> Column:
    return paths.file_class(F.element_at(paths.compound(F.col("key")), -1))


def route(cls: Column) -> Column:
    """How an entry of a class is compared."""
    return F.when(cls.isin("ARCHIVE", "JAR"), "listing").when(cls == "OFFICE", "office").when(paths.is_text_diffable(cls), "text").otherwise("none")


def units(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, engine, error, old_lines, new_lines, old_hash, new_hash) of entries (key, bytes) of two versions: what is compared line by line, and why not. A side without the entry has no lines."""
    rows = old.select("key", F.lit("old").alias("side"), "bytes").unionByName(new.select("key", F.lit("new").alias("side"), "bytes"))
    none = rows.where(F.col("bytes").isNull()).select("key", "side", F.lit(None).cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("error"), F.lit(NO_HASH).alias("hash"))
    read = readable(rows.where(F.col("bytes").isNotNull())).select("key", "side", _lines("text", "spread").alias("lines"), "error", "hash").unionByName(none)
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    met = read.groupBy("key").agg(side("old", "lines").alias("o"), side("new", "lines").alias("n"), F.min("error").alias("e"), *[F.coalesce(side(s, "hash"), F.lit(NO_HASH)).alias(f"{s}_hash") for s in ("old", "new")])
    return _units(met.withColumn("error", F.when(F.col("o").isNull() & F.col("n").isNull() & F.col("e").isNull(), NEITHER).otherwise(F.col("e"))))


# Fixed value: why an entry that no version has is not compared.
NEITHER = "on neither side"


def pair_units(pairs: DataFrame) -> DataFrame:
    """units of entries whose versions are side by side (key, old, new), a row a key: they are read where they are, and nothing is shuffled."""

    def read(key: str, old: bytes | None, new: bytes | None, file_class: str, way: str) -> Iterator[tuple]:
        (o, o_spread, e, o_hash), (n, n_spread, f, n_hash) = (_read(key, x, file_class, way) if x is not None else (None, None, None, NO_HASH) for x in (old, new))
        error = min((x for x in (e, f) if x is not None), default=NEITHER if o is None and n is None else None)
        yield key, o, n, o_spread, n_spread, error, o_hash, n_hash

    cls = _class()
    texts = row_by_row(pairs.select("key", "old", "new", cls.alias("file_class"), route(cls).alias("route")), read, "key string, o string, n string, o_spread string, n_spread string, error string, old_hash string, new_hash string")
    return _units(texts.withColumns({c: _lines(c, f"{c}_spread") for c in ("o", "n")}))


def _lines(text: str, spread: str) -> Column:
    """The lines of a text in the form in which its class is compared."""
    cls = _class()
    return F.split(F.when(route(cls) == "text", beautify.form(F.col(text), cls, F.col(spread))).otherwise(F.col(text)), "\n")


def _units(met: DataFrame) -> DataFrame:
    cls, error = _class(), F.col("error")
    engine = F.when(route(cls) == "listing", "archive-listing").when(route(cls) == "office", "office-text").when(route(cls) == "text", beautify.engine(cls))
    empty = F.array().cast("array<string>")
    return met.select("key", F.when(error.isNull(), engine).alias("engine"), "error", *[F.when(error.isNotNull(), empty).otherwise(F.coalesce(c, empty)).alias(f"{s}_lines") for s, c in (("old", "o"), ("new", "n"))], "old_hash", "new_hash")


def unit_lines(units: DataFrame) -> DataFrame:
    """(key, pos, op, old_no, new_no, text): the units' differences by longest common subsequence."""
    return lines.lcs_diff(units.where("error IS NULL"), "key", "old_lines", "new_lines")


def unit_counts(units: DataFrame) -> DataFrame:
    """(key, same, deleted, added): lines of the units' differences, counted."""
    return lines.lcs_counts(units.where("error IS NULL"), "key", "old_lines", "new_lines")
