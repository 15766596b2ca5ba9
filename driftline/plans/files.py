"""Queries about files: archives, archives in archives, office documents. The tables hold none, so tasks make them of documents, PACK to an archive."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..model import Options
from ..sources import archives
from .inputs import TEXT, class_sql, table

OPTIONS = Options()
QUERIES: dict = {}
SQL: dict = {}
PACK = 40
#: A day long past, for every entry.
_DATE = (2020, 1, 2, 3, 4, 6)


def query(name: str, sql: str | None = None):
    """Registers a query by name, with its SQL where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def zipped(entries: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(zipfile.ZipInfo(name, _DATE), data)
    return out.getvalue()


def _packs(spark, sf_dir, build) -> DataFrame:
    """(path, content): an archive of every PACK documents, as build makes it of their ids and texts."""
    rows = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").selectExpr("doc_id", f"{TEXT} AS text", f"CAST(floor(doc_id / {PACK}) AS BIGINT) AS pack")

    def make(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["doc_id", "text"])
        pack = int(own["pack"].iloc[0])
        return pd.DataFrame({"path": [f"store/p{pack}.zip"], "content": [build(pack, list(zip(own["doc_id"].tolist(), own["text"].tolist())))]})

    return rows.groupBy("pack").applyInPandas(make, "path string, content binary")


def _plain(pack: int, docs: list[tuple[int, str]]) -> bytes:
    """Classes and pages of one level, with a folder, a folder without its slash, a name that climbs out; every seventh archive is cut short."""
    entries = [("web/", b""), ("WEB-INF", b""), *((f"WEB-INF/classes/Doc{i}.class" if i % 2 else f"web/doc{i}.html", t.encode()) for i, t in docs), ("../out.txt", b"x")]
    data = zipped(entries)
    return data[: len(data) // 2] if pack % 7 == 3 else data


_ENTRIES = f"""p AS (SELECT doc_id, {TEXT} AS t, doc_id // {PACK} AS pack FROM documents WHERE doc_id IS NOT NULL),
 e AS (SELECT concat('p', pack, '.zip') AS snapshot_id, CASE WHEN doc_id % 2 <> 0 THEN concat('WEB-INF/classes/Doc', doc_id, '.class') ELSE concat('web/doc', doc_id, '.html') END AS key, strlen(t)::BIGINT AS size, sha256(t) AS sha256, NULL AS error FROM p WHERE pack % 7 <> 3
  UNION ALL SELECT concat('p', pack, '.zip'), '../out.txt', 1, NULL, 'unsafe name' FROM p WHERE pack % 7 <> 3 GROUP BY pack
  UNION ALL SELECT concat('p', pack, '.zip'), '', 0, NULL, 'root: BadZipFile' FROM p WHERE pack % 7 = 3 GROUP BY pack)"""


@query("zip_scan", f"WITH {_ENTRIES} SELECT snapshot_id, key, size, sha256, error, {class_sql('key')} AS file_class, key LIKE 'WEB-INF/classes/%' AS own FROM e")
def zip_scan(spark, sf_dir):
    """Entries of archives, those that can't be read among them."""
    k = F.col("key")
    return archives.entries_of(_packs(spark, sf_dir, _plain)).select("snapshot_id", "key", "size", "sha256", "error", paths.file_class(k).alias("file_class"), k.startswith("WEB-INF/classes/").alias("own"))


@query("unpack_log", f"WITH {_ENTRIES} SELECT snapshot_id, count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NOT NULL) AS failed, false AS incomplete FROM e GROUP BY snapshot_id")
def unpack_log(spark, sf_dir):
    return archives.unpack_log(archives.entries_of(_packs(spark, sf_dir, _plain)))


@query("zip_listing", f"""WITH {_ENTRIES}, f AS (SELECT snapshot_id, key, size, '-' AS kind FROM e WHERE error IS NULL UNION ALL SELECT DISTINCT snapshot_id, concat(unnest(CASE WHEN key LIKE 'web/%' THEN ['web'] ELSE ['WEB-INF', 'WEB-INF/classes'] END), '/'), 0, 'd' FROM e WHERE error IS NULL)
 SELECT snapshot_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY key) AS line_no, concat(lpad(size::VARCHAR, 12, ' '), ' ', kind, ' ', key) AS line FROM f""")
def zip_listing(spark, sf_dir):
    """Listings of archives by name, without checksums, which their check can't make."""
    lines = archives.first_lines(archives.listing_lines(archives.entries_of(_packs(spark, sf_dir, _plain))), OPTIONS.listing_limit)
    return lines.select("snapshot_id", "line_no", F.concat(F.substring("line", 1, 13), F.expr("substring(line, 23)")).alias("line"))


def _nested(pack: int, docs: list[tuple[int, str]]) -> bytes:
    """Three levels: an archive of tens, each with its texts and, for odd ids, a library of one more level; one that is broken."""
    inner: dict[int, list[tuple[str, bytes]]] = {}
    for i, t in docs:
        own = inner.setdefault(i % PACK // 10, [])
        own.append((f"doc{i}.txt", t.encode()) if i % 2 == 0 else (f"lib/d{i}.jar", zipped([(f"com/Doc{i}.class", t.encode())])))
    return zipped([(f"deep/in{k}.zip", zipped(own)) for k, own in sorted(inner.items())] + [("broken.zip", b"no archive"), ("top.txt", b"top")])


@query("nested_unpack", f"""WITH p AS (SELECT doc_id, {TEXT} AS t, doc_id // {PACK} AS pack FROM documents WHERE doc_id IS NOT NULL)
 SELECT concat('p', pack, '.zip') AS snapshot_id, concat('deep/in', doc_id % {PACK} // 10, '.zip/', CASE WHEN doc_id % 2 = 0 THEN concat('doc', doc_id, '.txt') ELSE concat('lib/d', doc_id, '.jar/com/Doc', doc_id, '.class') END) AS key, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS depth, sha256(t) AS sha256, NULL AS error FROM p
 UNION ALL SELECT concat('p', pack, '.zip'), 'broken.zip', 0, sha256('no archive'), 'root: BadZipFile' FROM p GROUP BY pack UNION ALL SELECT concat('p', pack, '.zip'), 'top.txt', 0, sha256('top'), NULL FROM p GROUP BY pack""")
def nested_unpack(spark, sf_dir):
    """Archives in archives, unpacked depth by depth; one that can't be read stays."""
    return archives.flatten(archives.entries_of(_packs(spark, sf_dir, _nested))).select("snapshot_id", "key", "depth", "sha256", "error")


def word_document(text: str) -> bytes:
    """A document with a paragraph for each line, without the characters that XML can't hold."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in re.sub("[\x00-\x08\x0b-\x1f]", "", text).split("\n"))
    return zipped([("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'.encode())])


def _office(pack: int, docs: list[tuple[int, str]]) -> bytes:
    return zipped([(f"office/doc{i}.docx", word_document(t)) for i, t in docs])


@query("office_text", f"""WITH p AS (SELECT doc_id, regexp_replace({TEXT}, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g') AS t, doc_id // {PACK} AS pack FROM documents WHERE doc_id IS NOT NULL)
 SELECT concat('p', pack, '.zip') AS snapshot_id, concat('office/doc', doc_id, '.docx') AS key, md5(t) AS text, NULL AS error FROM p""")
def office_text(spark, sf_dir):
    """Paragraphs of office documents in archives, in all languages of the texts."""
    return archives.texts(archives.entries_of(_packs(spark, sf_dir, _office))).select("snapshot_id", "key", F.md5("text").alias("text"), "error")


@query("zip_signature", f"SELECT doc_id, doc_id % 3 = 0 AS zip, doc_id % 3 = 1 AS ole FROM documents")
def zip_signature(spark, sf_dir):
    head = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("504B0304"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("D0CF11E0A1B11AE1"))).otherwise(F.lit("PK").cast("binary"))
    data = F.concat(head, F.coalesce("text", F.lit("")).cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", archives.is_zip(data).alias("zip"), archives.is_ole(data).alias("ole"))
