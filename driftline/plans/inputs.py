"""Two versions of the tables, for the queries: by DataFrame operations, and in SQL for their check.

The new version has every row of the old one: some keys have moved, some contents are edited, some have only gained a blank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EXTENSIONS, FILE_CLASSES, KNOWN_TEXT
from ..sources.tables import snapshot

#: Expressions that both engines read alike.
KEY = """CASE CAST(doc_id % 12 AS INT)
 WHEN 0 THEN concat('WEB-INF/classes/com/app/', coalesce(source, 'none'), '/Doc', doc_id, '.class')
 WHEN 1 THEN concat('WEB-INF/lib/', coalesce(source, 'none'), '-', doc_id, '.jar')
 WHEN 2 THEN concat('WEB-INF/classes/com/app/', coalesce(source, 'none'), '/controller/Doc', doc_id, '.java')
 WHEN 3 THEN concat('conf/', coalesce(lang, 'none'), '/doc', doc_id, '.xml')
 WHEN 4 THEN concat('web/', coalesce(lang, 'none'), '/doc', doc_id, '.js')
 WHEN 5 THEN concat('web/', coalesce(lang, 'none'), '/doc', doc_id, '.min.js')
 WHEN 6 THEN concat('web/', coalesce(lang, 'none'), '/doc', doc_id, '.html')
 WHEN 7 THEN concat('web/', coalesce(lang, 'none'), '/doc', doc_id, '.css')
 WHEN 8 THEN concat('web/jsp/', coalesce(source, 'none'), '/doc', doc_id, '.jsp')
 WHEN 9 THEN concat('img/doc', doc_id, '.png')
 WHEN 10 THEN concat('deliver/', coalesce(source, 'none'), '.zip!/doc', doc_id, '.ZIP')
 ELSE concat('office/', coalesce(source, 'none'), '/dao/doc', doc_id, '.docx') END"""
NEW_KEY = f"CASE WHEN doc_id % 7 = 0 THEN concat('moved/', {KEY}) ELSE {KEY} END"
TEXT = "coalesce(text, '')"
NEW_TEXT = f"CASE WHEN doc_id % 5 = 0 THEN concat({TEXT}, 'x') WHEN doc_id % 3 = 0 THEN concat({TEXT}, ' ') ELSE {TEXT} END"
#: Edits that leave lines in front, at the end, or inside.
LINES_TEXT = f"CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN {TEXT} WHEN 1 THEN concat({TEXT}, chr(10), 'tail') WHEN 2 THEN concat('intro', chr(10), {TEXT}) ELSE replace({TEXT}, 'a', 'e') END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, text) of the documents, old and new."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return docs.selectExpr(f"{KEY} AS key", "doc_id", f"{TEXT} AS text"), docs.selectExpr(f"{NEW_KEY} AS key", "doc_id", f"{NEW_TEXT} AS text")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(snapshot(side, F.col("key"), F.col("text")) for side in versions(spark, sf_dir))


def _any_end(key: str, extensions: tuple[str, ...]) -> str:
    return f"regexp_matches({key}, '\\.(" + "|".join(e.replace(".", "\\.") for e in extensions) + ")$')"


def class_sql(key: str) -> str:
    """The file class in DuckDB's SQL."""
    arms = []
    for name, (any_case, exact) in EXTENSIONS.items():
        tests = ([_any_end(f"lower({key})", any_case)] if any_case else []) + ([_any_end(key, exact)] if exact else [])
        arms.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return f"CASE {' '.join(arms)} ELSE 'OTHER' END"


def label_sql(cls: str) -> str:
    return f"CASE {cls} " + " ".join(f"WHEN '{c}' THEN '{label}'" for c, (_, _, label) in FILE_CLASSES.items()) + " END"


def in_sql(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


FRONT = in_sql(c for c, (front, _, _) in FILE_CLASSES.items() if front)
DIFFABLE = in_sql(c for c, (_, text, _) in FILE_CLASSES.items() if text)
KNOWN = in_sql(KNOWN_TEXT)
LIB_JAR = "(key LIKE '%/lib/%' AND key LIKE '%.jar')"

#: Common table expressions: o and n the two versions, diff their comparison.
VERSIONS_SQL = f"o AS (SELECT {KEY} AS key, doc_id, {TEXT} AS text FROM documents), n AS (SELECT {NEW_KEY} AS key, doc_id, {NEW_TEXT} AS text FROM documents)"
DIFF_SQL = f"""{VERSIONS_SQL}, diff AS (
  SELECT *, {class_sql('key')} AS file_class FROM (
    SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NULL THEN 'DELETED' WHEN o.key IS NULL THEN 'ADDED' WHEN sha256(o.text) = sha256(n.text) THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status,
      strlen(o.text)::BIGINT AS old_size, strlen(n.text)::BIGINT AS new_size, o.text AS old_text, n.text AS new_text
    FROM o FULL JOIN n ON o.key = n.key))"""
