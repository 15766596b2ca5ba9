"""Queries that compare two versions: status, refinement, filters, roll-ups, renames, folders, archives, libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import labels, paths, text
from ..model import Options
from ..operators import align, diff
from ..sources import archives
from ..sources.tables import digest, snapshot
from .inputs import DIFF_SQL, DIFFABLE, FRONT, KNOWN, LIB_JAR, class_sql, label_sql, snapshots, table, versions

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


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.snapshot_diff(*snapshots(spark, sf_dir))


@query("snapshot_diff", f"WITH {DIFF_SQL} SELECT key, status, old_size, new_size, file_class FROM diff")
def snapshot_diff(spark, sf_dir):
    return compared(spark, sf_dir).select("key", "status", "old_size", "new_size", "file_class")


_COUNTS = "count(*) FILTER (status = 'ADDED') AS added, count(*) FILTER (status = 'DELETED') AS deleted, count(*) FILTER (status = 'MODIFIED') AS modified"


@query("snapshot_diff_stats", f"""WITH {DIFF_SQL} SELECT {_COUNTS}, count(*) FILTER (status = 'UNCHANGED') AS unchanged,
  count(*) FILTER (status <> 'UNCHANGED' AND NOT {LIB_JAR}) AS biz_changed, count(*) FILTER (status <> 'UNCHANGED' AND {LIB_JAR}) AS jar_changed FROM diff""")
def snapshot_diff_stats(spark, sf_dir):
    return diff.stats(compared(spark, sf_dir))


@query("snapshot_diff_orders", """SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NULL THEN 'DELETED' WHEN o.key IS NULL THEN 'ADDED' WHEN o.c = n.c THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status
  FROM (SELECT 'o' || o_orderkey AS key, concat(o_custkey, '|', o_orderstatus, '|', o_orderpriority) AS c FROM orders) o
  FULL JOIN (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'p' ELSE 'o' END || o_orderkey AS key, concat(o_custkey, '|', CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END, '|', o_orderpriority) AS c FROM orders) n ON o.key = n.key""")
def snapshot_diff_orders(spark, sf_dir):
    rows, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    old = snapshot(rows, F.concat(F.lit("o"), k), F.concat_ws("|", "o_custkey", "o_orderstatus", "o_orderpriority"))
    edited = F.when(k % 4 == 0, "X").otherwise(F.col("o_orderstatus"))
    new = snapshot(rows, F.concat(F.when(k % 9 == 0, "p").otherwise("o"), k), F.concat_ws("|", "o_custkey", edited, "o_orderpriority"))
    return diff.snapshot_diff(old, new).select("key", "status")


_LINES = "SELECT concat(l_orderkey, '/', l_linenumber) AS key, count(*) AS n, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY l_orderkey, l_linenumber"


@query("snapshot_diff_lineitem", f"""WITH o AS ({_LINES}) SELECT status, count(*) AS n FROM (SELECT CASE WHEN q % 10 = 0 THEN 'MODIFIED' ELSE 'UNCHANGED' END AS status FROM o WHERE n < 3
  UNION ALL SELECT unnest(['DELETED', 'ADDED']) FROM o WHERE n >= 3) GROUP BY status""")
def snapshot_diff_lineitem(spark, sf_dir):
    """Repeated keys are summed first, so that a key is one row; keys of three rows and more move."""
    rows = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"))
            .select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("key"), "n", "q"))
    side = lambda key, q: rows.select(key.alias("key"), F.lit(0).cast("long").alias("size"), digest([F.col("n"), q]).alias("sha256"))
    old = side(F.col("key"), F.col("q"))
    new = side(F.when(F.col("n") >= 3, F.concat(F.lit("moved/"), "key")).otherwise(F.col("key")), F.when(F.col("q") % 10 == 0, F.col("q") + 1).otherwise(F.col("q")))
    return diff.snapshot_diff(old, new).groupBy("status").agg(F.count("*").alias("n"))


_TRIM = "regexp_replace({}, '(?m)[ \\t]+$', '', 'g')"
_IS_TEXT = f"(file_class IN {DIFFABLE} OR (regexp_matches(regexp_extract(lower(key), '[^/]*$'), '^.+\\.[^.]+$') AND regexp_extract(lower(key), '[^.]*$') IN {KNOWN}))"
_REFINED = f"""{DIFF_SQL}, refined AS (SELECT * EXCLUDE (status), status AS raw_status, coalesce(status = 'MODIFIED' AND {_IS_TEXT} AND old_size <= {OPTIONS.normalize_limit} AND new_size <= {OPTIONS.normalize_limit}
  AND {_TRIM.format('old_text')} = {_TRIM.format('new_text')}, false) AS formatted_only FROM diff)"""


@query("text_refined_diff", f"WITH {_REFINED} SELECT key, CASE WHEN formatted_only THEN 'UNCHANGED' ELSE raw_status END AS status, formatted_only FROM refined")
def text_refined_diff(spark, sf_dir):
    """A digest of the normal form rides along in place of the text."""
    old, new = (s.select("key", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"), F.sha2(text.normalize(F.col("text")), 256).alias("norm")) for s in versions(spark, sf_dir))
    rows = diff.refine(diff.snapshot_diff(old, new, ("norm",)), F.col("old_norm"), F.col("new_norm"), OPTIONS.normalize_limit)
    return rows.select("key", "status", "formatted_only")


@query("classify_files", f"WITH {DIFF_SQL} SELECT key, file_class, file_class IN {FRONT} AS frontend, file_class IN {DIFFABLE} AS diffable, {label_sql('file_class')} AS label FROM diff")
def classify_files(spark, sf_dir):
    c = F.col("file_class")
    return compared(spark, sf_dir).select("key", "file_class", paths.is_frontend_text(c).alias("frontend"), paths.is_text_diffable(c).alias("diffable"), paths.category_label(c).alias("label"))


@query("layer_counts", f"WITH {DIFF_SQL} SELECT CASE WHEN key LIKE 'WEB-INF/classes/%' THEN 'L1' ELSE 'L0' END AS layer, count(*) AS n FROM diff GROUP BY 1")
def layer_counts(spark, sf_dir):
    layer = paths.layer(F.col("key"), F.lit("WAR"), F.lit("WEB-INF/classes/"), OPTIONS.internal_prefixes)
    return compared(spark, sf_dir).groupBy(layer.alias("layer")).agg(F.count("*").alias("n"))


@query("type_breakdown", f"WITH {DIFF_SQL} SELECT {label_sql('file_class')} AS category, {_COUNTS}, count(*) AS total FROM diff WHERE status <> 'UNCHANGED' GROUP BY ROLLUP (1)")
def type_breakdown(spark, sf_dir):
    return diff.type_breakdown(compared(spark, sf_dir))


_DOCS_BY_SOURCE = f"SELECT coalesce(source, 'none') AS snapshot_id, CASE WHEN source LIKE '%1' THEN concat('BOOT-INF/', doc_id) WHEN source LIKE '%2' THEN concat('WEB-INF/', doc_id) ELSE concat('x/', doc_id) END AS key FROM documents"


@query("package_type", f"WITH k AS ({_DOCS_BY_SOURCE}) SELECT snapshot_id, CASE WHEN bool_or(key LIKE 'BOOT-INF/%') THEN 'FAT_JAR' WHEN bool_or(key LIKE 'WEB-INF/%') THEN 'WAR' ELSE 'JAR' END AS package_type FROM k GROUP BY 1")
def package_type(spark, sf_dir):
    s = F.col("source")
    keys = table(spark, sf_dir, "documents").select(F.coalesce(s, F.lit("none")).alias("snapshot_id"), F.concat(F.when(s.endswith("1"), "BOOT-INF/").when(s.endswith("2"), "WEB-INF/").otherwise("x/"), "doc_id").alias("key"))
    return archives.package_type(keys)


@query("ignored_extensions", f"WITH {DIFF_SQL} SELECT key FROM diff WHERE NOT (lower(key) LIKE '%.min.js' OR lower(key) LIKE '%.zip' OR lower(key) LIKE '%.png')")
def ignored_extensions(spark, sf_dir):
    rules = spark.createDataFrame([(".min.js",), ("ZIP",), (" .png ",), (".",)], "ext string")
    return diff.ignored(compared(spark, sf_dir).select("key"), rules)


@query("view_ignore_rules", f"WITH {DIFF_SQL} SELECT key FROM diff WHERE NOT (key = 'img/doc9.png' OR key = 'img' OR key LIKE 'img/%' OR regexp_extract(key, '[^/]*$') = 'doc3.xml' OR lower(key) LIKE '%.css')")
def view_ignore_rules(spark, sf_dir):
    rules = spark.createDataFrame([("exact", "img/doc9.png"), ("prefix", "img"), ("name", "doc3.xml"), ("ext", "css"), ("ext", "css")], "type string, value string")
    return diff.without_rules(compared(spark, sf_dir).select("key"), diff.distinct_rules(rules))


@query("unsafe_keys", "SELECT key FROM (SELECT CASE CAST(page_id % 4 AS INT) WHEN 0 THEN url WHEN 1 THEN concat('/', page_id) WHEN 2 THEN concat('a\\..\\', page_id) ELSE concat('ok/', page_id) END AS key FROM pages) WHERE key IS NULL OR key = '' OR key LIKE '/%' OR key LIKE '%:%' OR key LIKE '%..%'")
def unsafe_keys(spark, sf_dir):
    i = F.col("page_id")
    keys = table(spark, sf_dir, "pages").select(F.when(i % 4 == 0, F.col("url")).when(i % 4 == 1, F.concat(F.lit("/"), i)).when(i % 4 == 2, F.concat(F.lit("a\\..\\"), i)).otherwise(F.concat(F.lit("ok/"), i)).alias("key"))
    return keys.where(paths.is_unsafe(F.col("key")))


@query("status_filter", f"WITH {DIFF_SQL} SELECT key, status FROM diff WHERE status IN ('ADDED', 'MODIFIED')")
def status_filter(spark, sf_dir):
    return compared(spark, sf_dir).where(F.col("status").isin("ADDED", "MODIFIED")).select("key", "status")


@query("search_filter", f"WITH {DIFF_SQL} SELECT key FROM diff WHERE contains(lower(key), 'src1')")
def search_filter(spark, sf_dir):
    return compared(spark, sf_dir).where(diff.matches("SRC1", F.col("key"))).select("key")


@query("regex_filter", f"WITH {DIFF_SQL} SELECT key FROM diff WHERE regexp_matches(key, '(?i)DOC\\d*5\\.')")
def regex_filter(spark, sf_dir):
    return compared(spark, sf_dir).where(diff.matches(r"DOC\d*5\.", F.col("key"), regex=True)).select("key")


_CHANGED = "status <> 'UNCHANGED'"


@query("candidates", f"""WITH {DIFF_SQL} SELECT key, file_class = 'CLASS' AND key LIKE 'WEB-INF/classes/%' AS own_class, file_class IN {FRONT} AS frontend, file_class IN {DIFFABLE} AS diffable, {LIB_JAR} AS lib_jar
  FROM diff WHERE {_CHANGED}""")
def candidates(spark, sf_dir):
    """Changed entries and what is done with each: class outline, front-end text, text, library."""
    k, c = F.col("key"), F.col("file_class")
    return compared(spark, sf_dir).where(_CHANGED).select("key", ((c == "CLASS") & k.startswith("WEB-INF/classes/")).alias("own_class"), paths.is_frontend_text(c).alias("frontend"), paths.is_text_diffable(c).alias("diffable"), paths.is_lib_jar(k).alias("lib_jar"))


@query("directory_groups", f"WITH {DIFF_SQL} SELECT CASE WHEN contains(key, '/') THEN regexp_extract(key, '^(.*)/[^/]*$', 1) ELSE '' END AS dir, {_COUNTS}, count(*) AS n FROM diff WHERE {_CHANGED} GROUP BY 1")
def directory_groups(spark, sf_dir):
    return (compared(spark, sf_dir).where(_CHANGED).groupBy(paths.parent(F.col("key")).alias("dir"))
            .agg(diff.count_status("ADDED").alias("added"), diff.count_status("DELETED").alias("deleted"), diff.count_status("MODIFIED").alias("modified"), F.count("*").alias("n")))


_UPS = "SELECT array_to_string(parts[1:i], '/') AS dir, * FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM (SELECT *, string_split(key, '/') AS parts FROM diff))"


@query("subtree_has_diff", f"WITH {DIFF_SQL} SELECT dir, bool_or({_CHANGED}) AS differs FROM ({_UPS}) GROUP BY dir")
def subtree_has_diff(spark, sf_dir):
    return diff.subtree_differs(compared(spark, sf_dir), F.col("status") != "UNCHANGED", "key")


@query("directory_tree", f"""WITH {DIFF_SQL} SELECT dir AS key, len(string_split(dir, '/')) - 1 AS depth, 'DIR' AS kind, count(*) AS files FROM ({_UPS}) GROUP BY 1
  UNION ALL SELECT key, len(string_split(key, '/')) - 1, 'FILE', 1 FROM diff""")
def directory_tree(spark, sf_dir):
    return diff.tree(compared(spark, sf_dir))


@query("increment_export", f"WITH {DIFF_SQL} SELECT CASE WHEN status = 'DELETED' THEN 'deleted' ELSE 'increment' END AS bucket, key, md5(CASE WHEN status = 'DELETED' THEN old_text ELSE new_text END) AS content_md5 FROM diff WHERE {_CHANGED}")
def increment_export(spark, sf_dir):
    """Contents meet only the keys that changed, each from the side that has it."""
    old, new = versions(spark, sf_dir)
    rows = diff.increment(compared(spark, sf_dir).withColumn("new_key", F.when(F.col("status") != "DELETED", F.col("key"))), old, new)
    return rows.select("bucket", "key", F.md5("text").alias("content_md5"))


_BYTES = "coalesce(sum(CASE WHEN status = 'DELETED' THEN old_size ELSE new_size END), 0)::BIGINT"


@query("export_estimate", f"WITH {DIFF_SQL} SELECT count(*) AS files, {_BYTES} AS bytes, count(*) <= 20000 AND {_BYTES} <= 268435456 AS small, ceil({_BYTES} / 41943040.0)::BIGINT AS eta_s FROM diff WHERE {_CHANGED}")
def export_estimate(spark, sf_dir):
    return diff.export_estimate(compared(spark, sf_dir))


@query("ci_summary", f"""WITH {DIFF_SQL} SELECT {_COUNTS}, CASE WHEN count(*) FILTER ({_CHANGED}) > 0 THEN 1 ELSE 0 END AS exit_code FROM diff""")
def ci_summary(spark, sf_dir):
    return diff.stats(compared(spark, sf_dir)).select("added", "deleted", "modified", F.when(F.col("added") + F.col("deleted") + F.col("modified") > 0, 1).otherwise(0).alias("exit_code"))


# Names that only a new version has changed: build numbers in folders, archives of the next release and what lies in them.
_OLD_NAME = """CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN concat('core-036M059(20260101-0900)/src/doc', doc_id, '.js') WHEN 1 THEN concat('pkg/bundle_', coalesce(source, 'none'), '-1.2.zip!/doc', doc_id, '.txt') ELSE concat('plain/doc', doc_id, '.xml') END"""
_NEW_NAME = """CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN concat('core-036M061(20260707-1135)/src/doc', doc_id, '.js') WHEN 1 THEN concat('pkg/bundle_', coalesce(source, 'none'), '-1.3.zip!/doc', doc_id, '.txt') ELSE concat('plain/doc', doc_id, '.xml') END"""
_EDIT = "CASE WHEN doc_id % 5 = 0 THEN concat(coalesce(text, ''), 'x') ELSE coalesce(text, '') END"


def renamed(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    archive = lambda v: docs.where("doc_id % 3 = 1").select(F.concat(F.lit("pkg/bundle_"), F.coalesce("source", F.lit("none")), F.lit(f"-{v}.zip")).alias("key"), F.lit(v).alias("text")).distinct()
    sides = [docs.selectExpr(f"{name} AS key", f"{body} AS text").unionByName(archive(v)) for name, body, v in ((_OLD_NAME, "coalesce(text, '')", "1.2"), (_NEW_NAME, _EDIT, "1.3"))]
    old, new = (snapshot(s, F.col("key"), F.col("text")).withColumn("content_key", F.col("sha256")) for s in sides)
    return align.align(diff.snapshot_diff(old, new, ("content_key",)))


@query("rename_map", f"""SELECT {_OLD_NAME} AS key, {_NEW_NAME} AS new_key, CASE WHEN doc_id % 5 = 0 THEN 'MODIFIED' ELSE 'UNCHANGED' END AS status,
    CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'PATH' ELSE 'CONTENT' END WHEN 1 THEN 'SUBFILE' ELSE 'KEY' END AS match_kind FROM documents
  UNION ALL SELECT DISTINCT concat('pkg/bundle_', coalesce(source, 'none'), '-1.2.zip'), concat('pkg/bundle_', coalesce(source, 'none'), '-1.3.zip'), 'MODIFIED', 'CONTAINER' FROM documents WHERE doc_id % 3 = 1""")
def rename_map(spark, sf_dir):
    """Containers, what lies in them, equal contents and versioned paths, paired in this order."""
    return renamed(spark, sf_dir).select("key", "new_key", "status", "match_kind")


_FOLDER = """l AS (SELECT concat('d', doc_id % 10, '/f', doc_id) AS path, strlen(coalesce(text, ''))::BIGINT AS size, doc_id * 1000 AS m, sha256(coalesce(text, '')) AS h FROM documents),
 r AS (SELECT concat(CASE WHEN doc_id % 7 = 0 THEN 'new/' ELSE '' END, 'd', doc_id % 10, '/f', doc_id) AS path, strlen(coalesce(text, ''))::BIGINT + (doc_id % 5 = 0)::INT AS size, doc_id * 1000 + (doc_id % 3 = 0)::INT AS m,
   sha256(concat(coalesce(text, ''), CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END)) AS h FROM documents),
 fd AS (SELECT coalesce(l.path, r.path) AS path, CASE WHEN l.path IS NULL THEN 'RIGHT_ONLY' WHEN r.path IS NULL THEN 'LEFT_ONLY' WHEN l.size = r.size AND l.m = r.m AND l.h = r.h THEN 'SAME' ELSE 'MODIFIED' END AS status,
   CASE WHEN l.path IS NULL OR r.path IS NULL THEN '' ELSE concat_ws(',', CASE WHEN l.size <> r.size THEN 'SIZE' END, CASE WHEN l.m <> r.m THEN 'MTIME' END, CASE WHEN l.h <> r.h THEN 'CONTENT' END) END AS changes
   FROM l FULL JOIN r ON l.path = r.path)"""


def folders(spark, sf_dir) -> DataFrame:
    docs, i = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("doc_id")
    name = F.concat(F.lit("d"), i % 10, F.lit("/f"), i)
    body = F.when(i % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    side = lambda path, t, m: docs.select(path.alias("path"), F.lit("FILE").alias("type"), F.octet_length(t).cast("long").alias("size"), m.alias("mtime_ms"), F.sha2(t, 256).alias("sha256"))
    return diff.folder_diff(side(name, F.col("text"), i * 1000), side(F.when(i % 7 == 0, F.concat(F.lit("new/"), name)).otherwise(name), body, i * 1000 + (i % 3 == 0).cast("int")))


@query("folder_diff", f"WITH {_FOLDER} SELECT path, status, changes FROM fd")
def folder_diff(spark, sf_dir):
    return folders(spark, sf_dir).select("path", "status", F.array_join("changes", ",").alias("changes"))


@query("folder_summary", f"""WITH {_FOLDER} SELECT count(*) FILTER (status = 'SAME') AS same, count(*) FILTER (status = 'MODIFIED') AS modified, count(*) FILTER (status = 'LEFT_ONLY') AS left_only, count(*) FILTER (status = 'RIGHT_ONLY') AS right_only,
  0::BIGINT AS type_mismatch, count(*) FILTER (status = 'MODIFIED' AND contains(changes, 'CONTENT')) AS content_changed, count(*) FILTER (status = 'MODIFIED' AND NOT contains(changes, 'CONTENT')) AS attr_only_changed,
  (SELECT count(*) FROM l) + (SELECT count(*) FROM r) AS scanned_files, 0::BIGINT AS scanned_dirs FROM fd""")
def folder_summary(spark, sf_dir):
    return diff.folder_summary(folders(spark, sf_dir))


_JARS = """o AS (SELECT concat('WEB-INF/lib/j', l_orderkey, '.jar') AS jar, concat('c', l_linenumber) AS "inner", sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2),
 n AS (SELECT jar, CASE WHEN q % 6 = 0 THEN concat("inner", 'x') ELSE "inner" END AS "inner", CASE WHEN q % 5 = 0 THEN q + 1 ELSE q END AS q FROM o),
 c AS (SELECT coalesce(o.jar, n.jar) AS jar, coalesce(o."inner", n."inner") AS "inner", CASE WHEN n.jar IS NULL THEN 'DELETED' WHEN o.jar IS NULL THEN 'ADDED' WHEN o.q = n.q THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status
   FROM o FULL JOIN n ON o.jar = n.jar AND o."inner" = n."inner")"""


def jar_classes(spark, sf_dir) -> DataFrame:
    old = (table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("WEB-INF/lib/j"), "l_orderkey", F.lit(".jar")).alias("jar"), F.concat(F.lit("c"), "l_linenumber").alias("inner"))
           .agg(F.sum("l_quantity").cast("long").alias("q")))
    q = F.col("q")
    new = old.select("jar", F.when(q % 6 == 0, F.concat("inner", F.lit("x"))).otherwise(F.col("inner")).alias("inner"), F.when(q % 5 == 0, q + 1).otherwise(q).alias("q"))
    return diff.class_diff(*(s.select("jar", "inner", digest([q]).alias("sha256")) for s in (old, new)))


@query("jar_class_diff", f'WITH {_JARS} SELECT jar, "inner", status FROM c')
def jar_class_diff(spark, sf_dir):
    return jar_classes(spark, sf_dir)


@query("jar_rollup", f"WITH {_JARS} SELECT jar, {_COUNTS}, count(*) FILTER (status = 'UNCHANGED') AS unchanged FROM c GROUP BY ROLLUP (jar)")
def jar_rollup(spark, sf_dir):
    return diff.class_rollup(jar_classes(spark, sf_dir))


@query("jar_topk_budget", f"""WITH {_JARS}, r AS (SELECT *, CASE status WHEN 'MODIFIED' THEN 0 WHEN 'ADDED' THEN 1 ELSE 2 END AS rank FROM c WHERE {_CHANGED}), p AS (SELECT *, row_number() OVER (ORDER BY jar, rank, "inner") AS pick FROM r)
  SELECT jar, "inner", status, pick FROM p WHERE pick <= {OPTIONS.top_k}""")
def jar_topk_budget(spark, sf_dir):
    return diff.top_classes(jar_classes(spark, sf_dir), OPTIONS.top_k)


_NODES = """o AS (SELECT concat('e', o_orderkey) AS name, o_custkey AS size, o_orderkey * 7 AS crc FROM orders UNION ALL SELECT concat('dir', o_orderkey % 50, '/'), 0, 0 FROM orders GROUP BY 1),
 n AS (SELECT concat(CASE WHEN o_orderkey % 8 = 0 THEN 'f' ELSE 'e' END, o_orderkey) AS name, o_custkey + (o_orderkey % 5 = 0)::INT AS size, o_orderkey * 7 + (o_orderkey % 3 = 0)::INT AS crc FROM orders UNION ALL SELECT concat('dir', o_orderkey % 40, '/'), 0, 1 FROM orders GROUP BY 1)"""


@query("archive_children", f"""WITH {_NODES} SELECT coalesce(o.name, n.name) AS name, suffix(coalesce(o.name, n.name), '/') AS is_dir,
  CASE WHEN n.name IS NULL THEN 'DELETED' WHEN o.name IS NULL THEN 'ADDED' WHEN suffix(o.name, '/') OR (o.size = n.size AND o.crc = n.crc) THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status,
  CASE WHEN n.name IS NULL THEN 1 WHEN o.name IS NULL THEN 2 WHEN suffix(o.name, '/') OR (o.size = n.size AND o.crc = n.crc) THEN 3 ELSE 0 END AS rank FROM o FULL JOIN n ON o.name = n.name""")
def archive_children(spark, sf_dir):
    rows, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")

    def side(name, size, crc, dirs, dir_crc):
        files = rows.select(name.alias("name"), size.cast("long").alias("size"), crc.cast("long").alias("crc32"))
        return files.unionByName(rows.select(F.concat(F.lit("dir"), k % dirs, F.lit("/")).alias("name"), F.lit(0).cast("long").alias("size"), F.lit(dir_crc).cast("long").alias("crc32")).distinct())

    old = side(F.concat(F.lit("e"), k), F.col("o_custkey"), k * 7, 50, 0)
    new = side(F.concat(F.when(k % 8 == 0, "f").otherwise("e"), k), F.col("o_custkey") + (k % 5 == 0).cast("int"), k * 7 + (k % 3 == 0).cast("int"), 40, 1)
    return diff.listing_diff(old, new).select("name", "is_dir", "status", labels.archive_rank(F.col("status")).alias("rank"))


@query("library_layers", """WITH l AS (SELECT concat('lib/p', ps_k, '.jar') AS jar, nm AS "inner" FROM (SELECT p_partkey % 100 AS ps_k, concat(CASE WHEN p_partkey % 100 < 30 THEN 'com/' ELSE 'org/' END, p_partkey, '.class') AS nm FROM part)),
 i AS (SELECT jar, bool_or("inner" LIKE 'com/%') AS own FROM l GROUP BY jar)
 SELECT l.jar, "inner", 'L1' AS layer, l.jar || '/' || "inner" AS key FROM l JOIN i ON l.jar = i.jar WHERE own UNION ALL SELECT jar, NULL, 'L2', jar FROM i WHERE NOT own""")
def library_layers(spark, sf_dir):
    i = F.col("p_partkey")
    listing = table(spark, sf_dir, "part").select(F.concat(F.lit("lib/p"), i % 100, F.lit(".jar")).alias("jar"), F.concat(F.when(i % 100 < 30, "com/").otherwise("org/"), i, F.lit(".class")).alias("inner"))
    return archives.library_layers(listing, OPTIONS.internal_prefixes)


@query("whole_container_hidden", f"WITH {DIFF_SQL}, w AS (SELECT 'deliver/src1.zip' AS c) SELECT key FROM diff WHERE NOT (contains(key, '!/') AND string_split(key, '!/')[1] IN (SELECT c FROM w))")
def whole_container_hidden(spark, sf_dir):
    containers = spark.createDataFrame([("deliver/src1.zip",)], "key string")
    return diff.outside_containers(compared(spark, sf_dir), containers).select("key")


@query("pseudo_directories", """WITH e AS (SELECT concat('a', doc_id % 20) AS key, 0 AS size FROM documents GROUP BY 1 UNION ALL SELECT concat('a', doc_id % 11, '/', doc_id), strlen(coalesce(text, ''))::BIGINT FROM documents)
 SELECT key FROM e WHERE NOT (size = 0 AND key IN (SELECT split_part(key, '/', 1) FROM e WHERE contains(key, '/')))""")
def pseudo_directories(spark, sf_dir):
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    entries = docs.select(F.concat(F.lit("a"), i % 20).alias("key"), F.lit(0).cast("long").alias("size")).distinct().unionByName(
        docs.select(F.concat(F.lit("a"), i % 11, F.lit("/"), i).alias("key"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size")))
    return diff.without_pseudo_directories(entries).select("key")


@query("merged_units", f"""WITH {DIFF_SQL} SELECT key, CASE WHEN file_class IN {DIFFABLE} THEN 'text' ELSE 'class' END AS engine FROM diff WHERE file_class IN {DIFFABLE} OR key LIKE 'WEB-INF/classes/%'""")
def merged_units(spark, sf_dir):
    """Units of classes and of texts; a key of both is the text's."""
    rows = compared(spark, sf_dir)
    classes, texts = rows.where(F.col("key").startswith("WEB-INF/classes/")).select("key"), rows.where(paths.is_text_diffable(F.col("file_class"))).select("key")
    both = classes.withColumns({"engine": F.lit("class"), "rank": F.lit(0)}).unionByName(texts.withColumns({"engine": F.lit("text"), "rank": F.lit(1)}))
    return both.groupBy("key").agg(F.max_by("engine", "rank").alias("engine"))


@query("top_candidates", f"WITH {DIFF_SQL} SELECT key, status FROM diff WHERE {_CHANGED} ORDER BY CASE status WHEN 'MODIFIED' THEN 0 WHEN 'ADDED' THEN 1 ELSE 2 END, key LIMIT {OPTIONS.top_k}")
def top_candidates(spark, sf_dir):
    return compared(spark, sf_dir).where(_CHANGED).orderBy(labels.status_rank(F.col("status")), "key").limit(OPTIONS.top_k).select("key", "status")


@query("sorted_tree", f"""WITH {DIFF_SQL}, s AS (SELECT *, {class_sql('key')} AS c FROM diff) SELECT c AS file_class, status, min(key) AS first_key, max(key) AS last_key, count(*) AS n FROM s GROUP BY ALL""")
def sorted_tree(spark, sf_dir):
    """First and last key of each class and status, in code-point order."""
    return compared(spark, sf_dir).groupBy("file_class", "status").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n"))
