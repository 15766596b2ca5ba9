"""Folders as tables: a data source that lists folders in parallel, and digests of what it lists.

The driver opens folders from the root down only until there are enough of them to deal out; tasks walk what is below. Reading the
files is another step, dealt by path, so a folder with most of the files keeps no task busier than others. Paths have to be mounted
where executors run.

Links are not followed and not listed, nor are sockets and pipes. A folder or file that can't be read is a row with its error, and
so is a name that could leave the root.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import paths
from ..model import Options
from .tables import cut

LISTED = "path string, type string, size long, mtime_ms long, error string"
#: Folders below which the driver doesn't look any further.
SUBTREES = 64
#: Bytes of a file that a task holds at a time.
PIECE = 1 << 20
# Fixed value: what stands for the digest of a folder.
FOLDER_DIGEST = "dir"


def local_path(root: str) -> str:
    """The path of a mounted folder, from a path or a file: address."""
    path = root.removeprefix("file:")
    if "://" in path:
        raise ValueError(f"{root} is not mounted as a folder")
    return "/" + path.lstrip("/") if path.startswith("/") else path


class _Subtree(InputPartition):
    """Folders to be walked, and to be listed without what lies below them."""

    def __init__(self, walked: list[str], listed: list[str]):
        super().__init__((tuple(walked), tuple(listed)))
        self.walked, self.listed = walked, listed


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = local_path(options["path"])
        self.depth = int(options.get("depth", 0)) or 1 << 30
        self.pruned = {x for x in options.get("pruned", "").split(",") if x}
        self.subtrees = int(options.get("subtrees", SUBTREES))
        if not os.path.isdir(self.root):
            raise ValueError(f"{self.root} is no folder")

    def _below(self, rel: str) -> Iterator[tuple[str, str, int, int, str | None]]:
        """(path, type, size, mtime, error) of what a folder holds."""
        try:
            entries = sorted(os.scandir(os.path.join(self.root, rel)), key=lambda e: e.name)
        except OSError as e:
            yield rel, "DIR", 0, 0, f"list: {type(e).__name__}"
            return
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            try:
                own = e.stat(follow_symlinks=False)
            except OSError as x:
                yield path, "FILE", 0, 0, f"stat: {type(x).__name__}"
                continue
            kind = "DIR" if stat.S_ISDIR(own.st_mode) else "FILE" if stat.S_ISREG(own.st_mode) else None
            if kind and not (kind == "DIR" and e.name in self.pruned):
                yield path, kind, 0 if kind == "DIR" else own.st_size, own.st_mtime_ns // 1_000_000, "unsafe name" if ".." in e.name else None

    def partitions(self) -> list[_Subtree]:
        frontier, opened, level = [""], [], 1
        while 0 < len(frontier) < self.subtrees and level < self.depth:
            opened += frontier
            frontier = [r[0] for d in frontier for r in self._below(d) if r[1] == "DIR" and r[4] is None]
            level += 1
        parts = max(1, min(self.subtrees, len(frontier) + len(opened)))
        return [_Subtree(frontier[k::parts], opened[k::parts]) for k in range(parts)]

    def read(self, partition: _Subtree):
        pending = [(d, True) for d in partition.walked] + [(d, False) for d in partition.listed]
        while pending:
            at, deeper = pending.pop()
            for row in self._below(at):
                yield row
                if deeper and row[1] == "DIR" and row[4] is None and row[0].count("/") + 2 <= self.depth:
                    pending.append((row[0], True))


class FolderSource(DataSource):
    """format("folder"): options path, depth (levels below the root, 0 for all), pruned (names of folders left out, by commas)."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def listed(spark: SparkSession, root: str, depth: int = 0, pruned: tuple[str, ...] = (), subtrees: int = SUBTREES) -> DataFrame:
    """(path, type, size, mtime_ms, error) of everything below a folder."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").option("depth", depth).option("pruned", ",".join(pruned)).option("subtrees", subtrees).load(root)


def _digest(path: str) -> str:
    found = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(PIECE):
            found.update(piece)
    return found.hexdigest()


def digests(rows: DataFrame, root: str, options: Options | None = None) -> DataFrame:
    """rows of listed() with sha256 of the files up to the limit; a file that can't be read gets an error."""
    limit, base = (options or Options()).hash_limit, local_path(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for path, kind, size, error in zip(*(batch.column(c).to_pylist() for c in ("path", "type", "size", "error"))):
                digest = None
                if kind == "FILE" and error is None and size <= limit:
                    try:
                        digest = _digest(os.path.join(base, path))
                    except OSError as e:
                        error = f"read: {type(e).__name__}"
                found.append(digest)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "type", "size", "mtime_ms")), pa.array(errors, pa.string()), pa.array(found, pa.string())], names=["path", "type", "size", "mtime_ms", "error", "sha256"])

    return rows.repartition(F.xxhash64("path")).mapInArrow(read, f"{LISTED}, sha256 string")


def scan(spark: SparkSession, root: str, options: Options | None = None, depth: int = 0, pruned: tuple[str, ...] = ()) -> DataFrame:
    """(path, type, size, mtime_ms, error, sha256): a folder as folder_diff compares it, empty folders too. Files are read once, whatever is asked of the rows."""
    return cut(digests(listed(spark, root, depth, pruned), root, options))


def snapshot(scanned: DataFrame, options: Options | None = None) -> DataFrame:
    """(key, size, sha256, file_class) of scan()'s files, and a row for every folder above one. A file over the limit has no digest and is OTHER, as it is not read; what has an error has no row."""
    limit = (options or Options()).hash_limit
    files = scanned.where("type = 'FILE' AND error IS NULL")
    own = files.select(F.col("path").alias("key"), "size", "sha256", F.when(F.col("size") > limit, "OTHER").otherwise(paths.file_class(F.col("path"))).alias("file_class"))
    above = files.select(F.explode(paths.ancestors(F.col("path"))).alias("dir")).distinct()
    return own.unionByName(above.select(F.concat("dir", F.lit("/")).alias("key"), F.lit(0).cast("long").alias("size"), F.lit(FOLDER_DIGEST).alias("sha256"), F.lit("FOLDER").alias("file_class")))


def errors(scanned: DataFrame) -> DataFrame:
    """(path, error) of what could not be read."""
    return scanned.where("error IS NOT NULL").select("path", "error")
