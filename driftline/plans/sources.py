"""Queries about Java sources, made of documents: interfaces of two versions, and edits that only change the layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import java_source
from ..model import Options
from ..operators import impact
from ..sources.tables import cut
from .inputs import table

OPTIONS = Options()
QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a query by name, with its SQL where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_OLD = """concat('package com.p', doc_id % 7, ';', chr(10), 'import java.util.*;', chr(10), '/** Doc ', doc_id, ' { */', chr(10), 'public class Doc', doc_id, '<T> extends Base implements A, B {', chr(10),
 '  private int secret = 1;', chr(10), '  public static final String A = "x;{", B = "y";', chr(10), '  // run(int)', chr(10), '  @Deprecated("(") public int run(int n, final String... more) { if (n > 0) { return n; } return ', doc_id % 9, '; }', chr(10),
 '  protected Map<String, List<T>> items(Map<String, ? extends T> m) throws Exception { return null; }', chr(10), '  public Doc', doc_id, '(long x) { }', chr(10), '  void hidden() { }', chr(10), '  public enum Kind { ONE, TWO(2) { }; public int at; }', chr(10), '}', chr(10))"""
#: By id: a changed signature, a method gone and another there, only layout, a changed body, a broken source.
_NEW = """CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN replace(@OLD, 'run(int n,', 'run(long n,') WHEN 1 THEN replace(replace(@OLD, 'protected Map', 'private Map'), 'void hidden', 'public void shown')
 WHEN 2 THEN replace(replace(replace(@OLD, '  void hidden() { }' || chr(10), ''), '  private int secret = 1;', 'void   hidden( ) /* { */ { }' || chr(10) || '  private int secret=1; // }'), chr(10) || '  public Doc', '   public   Doc')
 WHEN 3 THEN replace(@OLD, 'return n;', 'return n + 1;') WHEN 4 THEN concat(@OLD, '}') ELSE @OLD END""".replace("@OLD", _OLD)


def _sources(spark, sf_dir, sql: str):
    return table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").selectExpr("doc_id", f"{sql} AS text")


_CLS = "concat('com.p', doc_id % 7, '.Doc', doc_id)"
_APIS = f"""SELECT {_CLS} AS cls, unnest(['A:String', 'B:String', 'run(int,String...):int', 'items(Map<String, ? extends T>):Map<String, List<T>>', '<init>(long):void']) AS api FROM documents WHERE doc_id IS NOT NULL
 UNION ALL SELECT concat({_CLS}, '.Kind'), unnest(['ONE:Kind', 'TWO:Kind', 'at:int']) FROM documents WHERE doc_id IS NOT NULL"""


@query("api_outline", _APIS)
def api_outline(spark, sf_dir):
    """What classes offer to others, read from their sources."""
    return java_source.outlines(_sources(spark, sf_dir, _OLD)).select("cls", "api")


@query("api_compatibility", f"""SELECT {_CLS} AS cls, 'SIGNATURE_CHANGED' AS level, 'run(int,String...):int → run(long,String...):int' AS api FROM documents WHERE doc_id % 6 = 0
 UNION ALL SELECT {_CLS}, unnest(['REMOVED_API', 'ADDED_API']), unnest(['items(Map<String, ? extends T>):Map<String, List<T>>', 'shown():void']) FROM documents WHERE doc_id % 6 = 1""")
def api_compatibility(spark, sf_dir):
    """Changes of interfaces between two versions of sources; what can't be read on a side says nothing about its class."""
    old, new = (cut(java_source.outlines(_sources(spark, sf_dir, sql))) for sql in (_OLD, _NEW))  # read several times below
    readable = new.select("cls").distinct()
    return impact.api_changes(old.join(readable, "cls", "left_semi"), new)


@query("layout_only_sources", "SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 'UNCHANGED' WHEN doc_id % 6 = 2 THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status, doc_id % 6 = 2 AS formatted_only FROM documents WHERE doc_id IS NOT NULL")
def layout_only_sources(spark, sf_dir):
    """Sources whose order, layout and comments changed are unchanged. Normal forms are made of those that differ only."""
    both = _sources(spark, sf_dir, _OLD).withColumnRenamed("text", "old").join(_sources(spark, sf_dir, _NEW).withColumnsRenamed({"text": "new", "doc_id": "id"}), F.col("doc_id") == F.col("id"))
    same = F.col("old") == F.col("new")
    rows = both.where(same).select("doc_id", F.lit(False).alias("formatted_only"), same.alias("same"))
    changed = both.where(~same).select("doc_id", java_source.normal_digest(F.col("old")).alias("o"), java_source.normal_digest(F.col("new")).alias("n"))
    rows = rows.unionByName(changed.select("doc_id", F.coalesce(F.col("o") == F.col("n"), F.lit(False)).alias("formatted_only"), F.lit(False).alias("same")))
    return rows.select("doc_id", F.when(F.col("same") | F.col("formatted_only"), "UNCHANGED").otherwise("MODIFIED").alias("status"), "formatted_only")
