"""Archives and folders as snapshots: listings, recursive expansion, office texts. Scan functions return an error column and never raise."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import best_version, manifest_versions, properties_version
from ..model import Options
from .tables import cut

ENTRY = "snapshot_id string, key string, container_key string, depth int, size long, crc32 long, sha256 string, bytes binary, error string"


def _unsafe(name: str) -> bool:
    return not name or name.startswith("/") or ":" in name or ".." in name


def expand_zip(data: bytes, options: Options) -> Iterator[tuple[str, int, int, bytes | None, str | None]]:
    """(name, size, crc32, bytes, error) of an archive's files; one row with an error if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = [i.filename.replace("\\", "/") for i in z.infolist()]
            folders = {n[: k + 1] for n in names for k in range(len(n)) if n[k] == "/"}
            total = 0
            for info, name in zip(z.infolist(), names):
                if name.endswith("/") or (info.file_size == 0 and f"{name}/" in folders):
                    continue
                total += info.file_size
                if _unsafe(name):
                    yield name, info.file_size, info.CRC, None, "unsafe name"
                elif info.file_size > options.max_entry_bytes or total > options.max_total_bytes:
                    yield name, info.file_size, info.CRC, None, "over the limit"
                else:
                    try:
                        yield name, info.file_size, info.CRC, z.read(info), None
                    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError) as e:
                        yield name, info.file_size, info.CRC, None, f"read: {type(e).__name__}"
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError) as e:
        yield "", 0, 0, None, f"root: {type(e).__name__}"


#: Bytes of contents that a task hands on at a time.
FRAME = 4 << 20
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def frames(batches: Iterator[pa.RecordBatch], made: Callable[..., Iterator[tuple]], to: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows that made(*row) has for each row of batches, every FRAME bytes."""
    for batch in batches:
        out, held = [], 0
        for k in range(batch.num_rows):
            for row in made(*(c[k].as_py() for c in batch.columns)):
                out.append(row)
                held += 64 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
                if held > FRAME:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), to)], schema=to)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), to)], schema=to)


def row_by_row(df: DataFrame, made: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that made(*row) has for each row of df, in tasks. One row of a batch is a Python object at a time, and what is made goes on every FRAME bytes, so a task holds no more however large its part is."""
    to = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])
    return df.mapInArrow(lambda batches: frames(batches, made, to), schema)


def _expanded(rows: DataFrame, options: Options) -> DataFrame:
    """Children of archives (snapshot_id, key, depth, bytes)."""

    def expand(snapshot_id: str, key: str, depth: int, data: bytes) -> Iterator[tuple]:
        for name, size, crc, inner, error in expand_zip(data, options):
            yield snapshot_id, f"{key}/{name}" if key and name else name or key, key, depth + 1, size, crc, hashlib.sha256(inner).hexdigest() if inner is not None else None, inner, error

    return row_by_row(rows.select("snapshot_id", "key", "depth", "bytes"), expand, ENTRY)


def entries_of(files: DataFrame, options: Options | None = None) -> DataFrame:
    """Entries of archives (path, content); snapshot_id is the file's name."""
    roots = files.select(paths.file_name(F.col("path")).alias("snapshot_id"), F.lit("").alias("key"), F.lit(-1).alias("depth"), F.col("content").alias("bytes"))
    return _expanded(roots, options or Options())


def scan_archives(spark: SparkSession, pattern: str, options: Options | None = None) -> DataFrame:
    """Entries of every archive that matches a path pattern."""
    return entries_of(spark.read.format("binaryFile").load(pattern), options)


def flatten(entries: DataFrame, options: Options | None = None) -> DataFrame:
    """entries with archives inside archives expanded, depth by depth, children keyed container/inner; an expanded container goes, one that can't be read stays with its error. Each depth is cut, so no archive is unpacked twice."""
    options = options or Options()
    is_container = paths.file_class(F.col("key")).isin("ARCHIVE", "JAR") & F.col("bytes").isNotNull()
    done, level = None, entries
    for _ in range(options.max_depth):
        containers = level.where(is_container)
        children = cut(_expanded(containers, options))  # read three times below
        failed = children.where(F.col("error").startswith("root:")).select("snapshot_id", F.col("container_key").alias("key"), F.col("error").alias("root_error"))
        kept = level.join(failed, ["snapshot_id", "key"], "left").where(~is_container | F.col("root_error").isNotNull())
        kept = kept.withColumn("error", F.coalesce("root_error", "error")).drop("root_error").select(*[c.split()[0] for c in ENTRY.split(", ")])
        done = kept if done is None else done.unionByName(kept)
        level = children.where(~F.coalesce(F.col("error").startswith("root:"), F.lit(False)))
        if level.isEmpty():
            return done
    rest = level.withColumn("error", F.when(is_container, "too deep").otherwise(F.col("error")))
    return done.unionByName(rest)


def unpack_log(entries: DataFrame) -> DataFrame:
    return entries.groupBy("snapshot_id").agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.bool_or(F.col("error") == "too deep"), F.lit(False)).alias("incomplete"))


def package_type(keys: DataFrame, group: str = "snapshot_id") -> DataFrame:
    return keys.groupBy(group).agg(F.when(F.bool_or(F.col("key").startswith("BOOT-INF/")), "FAT_JAR").when(F.bool_or(F.col("key").startswith("WEB-INF/")), "WAR").otherwise("JAR").alias("package_type"))


def package_versions(texts: DataFrame) -> DataFrame:
    """(snapshot_id, version) of packages from their entries' texts (snapshot_id, key, text): the more detailed of the manifest's and the first build file's."""
    manifest = F.col("key") == "META-INF/MANIFEST.MF"
    build = F.col("key").startswith("META-INF/maven/") & F.col("key").endswith("pom.properties")
    rows = texts.select("snapshot_id", "key", F.when(manifest, best_version(manifest_versions(F.col("text")))).alias("m"), F.when(build, properties_version(F.col("text"))).alias("p"))
    both = rows.groupBy("snapshot_id").agg(F.max("m").alias("m"), F.min(F.when(F.col("p").isNotNull(), F.struct("key", "p"))).alias("p"))
    return both.select("snapshot_id", best_version(F.array("m", F.col("p.p"))).alias("version"))


def library_layers(entries: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """(jar, inner, layer, key) of listings (jar, inner): jars with a class under an internal prefix are expanded to L1 rows, others are one L2 row."""
    own = F.lit(False)
    for p in prefixes:
        own = own | F.col("inner").startswith(p)
    internal = entries.groupBy("jar").agg(F.bool_or(own & F.col("inner").endswith(".class")).alias("internal"))
    expanded = entries.join(internal.where("internal"), "jar", "left_semi").select("jar", "inner", F.lit("L1").alias("layer"), F.concat_ws("/", "jar", "inner").alias("key"))
    whole = internal.where("NOT internal").select("jar", F.lit(None).cast("string").alias("inner"), F.lit("L2").alias("layer"), F.col("jar").alias("key"))
    return expanded.unionByName(whole)


def listing_lines(entries: DataFrame) -> DataFrame:
    """(snapshot_id, key, line): how a listing shows an entry: size, checksum, d or -, name. Folders above entries have lines of their own."""
    files = entries.where("error IS NULL").select("snapshot_id", "key", "size", "crc32", F.lit("-").alias("kind"))
    dirs = files.select("snapshot_id", F.explode(paths.ancestors(F.col("key"))).alias("key")).distinct()
    dirs = dirs.select("snapshot_id", F.concat("key", F.lit("/")).alias("key"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("crc32"), F.lit("d").alias("kind"))
    crc = F.coalesce(F.lpad(F.lower(F.hex("crc32")), 8, "0"), F.lit("--------"))
    return files.unionByName(dirs).select("snapshot_id", "key", F.concat_ws(" ", F.lpad(F.col("size").cast("string"), 12, " "), crc, "kind", F.substring("key", 1, 512)).alias("line"))


def first_lines(lines: DataFrame, limit: int) -> DataFrame:
    """(snapshot_id, line_no, line): the first lines of every listing by name. A listing's order is a window over one archive's names, without those beyond the limit."""
    order = W.partitionBy("snapshot_id").orderBy("key")
    return lines.withColumn("line_no", F.row_number().over(order).cast("long")).where(F.col("line_no") <= limit).select("snapshot_id", "line_no", "line")


def is_zip(data: Column) -> Column:
    return F.hex(F.substring(data, 1, 4)) == "504B0304"


def is_ole(data: Column) -> Column:
    return F.hex(F.substring(data, 1, 8)) == "D0CF11E0A1B11AE1"


def scan_folder(spark: SparkSession, root: str, options: Options | None = None) -> DataFrame:
    """(path, type, size, mtime_ms, sha256) of the files under a folder and the folders above them; digests up to the limit only."""
    options = options or Options()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", ""), f"^{re.escape(prefix)}/", "")
    rows = files.select(rel.alias("path"), F.lit("FILE").alias("type"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), F.when(F.col("length") <= options.hash_limit, F.sha2("content", 256)).alias("sha256"))
    dirs = rows.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    return rows.unionByName(dirs.select("path", F.lit("DIR").alias("type"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("mtime_ms"), F.lit(None).cast("string").alias("sha256")))


def decode_text(data: bytes) -> str:
    """Strict UTF-8, else GBK, else Latin-1."""
    for encoding in ("utf-8", "gbk"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def office_text(name: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of an office document: paragraphs, or rows of cells."""
    kind = name.lower().rpartition(".")[2]
    if data[:4] != b"PK\x03\x04":
        return None, "legacy office format"
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            def tree(part: str):
                raw = z.read(part)
                if b"<!DOCTYPE" in raw[:4096]:
                    raise ValueError("a document type declaration")
                return ElementTree.fromstring(raw)

            def paragraphs(part: str) -> list[str]:
                return ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in tree(part).iter() if _local(p.tag) == "p"]

            parts = sorted(z.namelist(), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
            if kind.startswith("do"):
                return "\n".join(paragraphs("word/document.xml")), None
            if kind.startswith("pp"):
                return "\n".join(line for p in parts if re.fullmatch(r"ppt/slides/slide\d+\.xml", p) for line in paragraphs(p) if line), None
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in parts else []
            lines = []
            for p in parts:
                if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", p):
                    for row in (x for x in tree(p).iter() if _local(x.tag) == "row"):
                        cells = []
                        for c in (x for x in row if _local(x.tag) == "c"):
                            value = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                            cells.append(f"{c.get('r')}={shared[int(value)] if c.get('t') == 's' and value else value}")
                        lines.append(f"Row {row.get('r')}: {' | '.join(cells)}")
            return "\n".join(lines), None
    except (KeyError, ValueError, IndexError, zipfile.BadZipFile, ElementTree.ParseError, zlib.error, OSError) as e:
        return None, f"{type(e).__name__}: {e}"


def texts(entries: DataFrame) -> DataFrame:
    """(snapshot_id, key, text, error) of entries with bytes: office documents by their parts, text classes decoded."""

    def read(snapshot_id: str, key: str, data: bytes, file_class: str) -> Iterator[tuple]:
        yield snapshot_id, key, *(office_text(key, data) if file_class == "OFFICE" else (decode_text(data), None))

    cls = paths.file_class(F.col("key"))
    own = entries.where(F.col("bytes").isNotNull() & ((cls == "OFFICE") | paths.is_text_diffable(cls) | paths.is_known_text(F.col("key"))))
    return row_by_row(own.select("snapshot_id", "key", "bytes", cls.alias("file_class")), read, "snapshot_id string, key string, text string, error string")
