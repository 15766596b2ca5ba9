"""Queries about what a comparison hands on: trees, exports, manifests, reports, routes, project facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, mojibake, paths, text, versions
from ..model import Options
from ..operators import align, diff, report
from ..sources.tables import snapshot
from .compare import compared, folders
from .inputs import DIFF_SQL, DIFFABLE, FRONT, LIB_JAR, TEXT, table

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


@query("tree_json", f"""WITH {DIFF_SQL} SELECT key, concat('{{"key":"', key, '","name":"', regexp_extract(key, '[^/]*$'), '","status":"', status, '","fileClass":"', file_class, '"', CASE WHEN old_size IS NULL THEN '' ELSE concat(',"oldSize":', old_size) END, CASE WHEN new_size IS NULL THEN '' ELSE concat(',"newSize":', new_size) END, '}}') AS node FROM diff""")
def tree_json(spark, sf_dir):
    return report.nodes(compared(spark, sf_dir))


@query("class_export", f"""WITH {DIFF_SQL}, c AS (SELECT key, status, coalesce(CASE WHEN status = 'DELETED' THEN old_text ELSE new_text END, '') AS t FROM diff WHERE status <> 'UNCHANGED' AND file_class = 'CLASS')
 SELECT key AS path, md5(t) AS content FROM c UNION ALL SELECT concat(regexp_extract(key, '^(.*/)?[^/]*$', 1), '.', status, '.', regexp_extract(key, '[^/]*$')), md5(concat(status, ' ', key)) FROM c""")
def class_export(spark, sf_dir):
    """Changed classes under their paths, each with a file that says how it changed."""
    from .inputs import versions as sides

    return report.class_files(compared(spark, sf_dir), *sides(spark, sf_dir)).select("path", F.md5("content").alias("content"))


@query("jar_export", f"WITH {DIFF_SQL} SELECT replace(key, '/', '_') AS path, CASE WHEN status = 'DELETED' THEN 'old' ELSE 'new' END AS side FROM diff WHERE status <> 'UNCHANGED' AND {LIB_JAR}")
def jar_export(spark, sf_dir):
    rows = compared(spark, sf_dir).where((F.col("status") != "UNCHANGED") & paths.is_lib_jar(F.col("key")))
    return rows.select(F.replace("key", F.lit("/"), F.lit("_")).alias("path"), F.when(F.col("status") == "DELETED", "old").otherwise("new").alias("side"))


@query("source_manifest", f"""WITH {DIFF_SQL} SELECT concat(key, ' | ', CASE WHEN file_class IN {DIFFABLE} THEN 'text' ELSE 'none' END, ' | ', CASE WHEN file_class IN {DIFFABLE} THEN 'true' ELSE 'false' END) AS line FROM diff WHERE status <> 'UNCHANGED'
 ORDER BY CASE status WHEN 'MODIFIED' THEN 0 WHEN 'ADDED' THEN 1 ELSE 2 END, key LIMIT {OPTIONS.top_k}""")
def source_manifest(spark, sf_dir):
    """What the export of sources holds: the first changed keys, how they were read and whether they could be."""
    first = compared(spark, sf_dir).where("status <> 'UNCHANGED'").orderBy(labels.status_rank(F.col("status")), "key").limit(OPTIONS.top_k)
    ok = paths.is_text_diffable(F.col("file_class"))
    return first.select(F.concat_ws(" | ", "key", F.when(ok, "text").otherwise("none"), ok.cast("string")).alias("line"))


_LOG = "concat(CAST(epoch_ms(ts) AS VARCHAR), ',', CASE WHEN event_id % 50 = 0 THEN 'x' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END, ',', CASE WHEN event_id % 30 = 0 THEN '' ELSE event_type END, ',', CASE WHEN event_type = 'error' THEN 'FALSE' ELSE 'true' END)"


@query("load_log", """WITH r AS (SELECT CASE WHEN event_id % 30 = 0 THEN 'ALL' ELSE event_type END AS label, CAST(floor(value) AS BIGINT) AS e, epoch_ms(ts) AS t, event_type <> 'error' AS ok FROM events WHERE event_id % 50 <> 0), d AS (SELECT (max(t + e) - min(t)) / 1000.0 AS seconds FROM r)
 SELECT label, count(*) AS n, round(avg(e), 4) AS mean, min(e) AS least, max(e) AS most, count(*) FILTER (NOT ok) AS errors, round(100.0 * count(*) FILTER (NOT ok) / count(*), 4) AS error_rate, round(count(*) / any_value(seconds), 6) AS per_second FROM r, d GROUP BY label""")
def load_log(spark, sf_dir):
    """A load test's log: lines of time, duration, label and success; lines without a duration don't count."""
    rows = table(spark, sf_dir, "events")
    i, kind = F.col("event_id"), F.col("event_type")
    line = F.concat_ws(",", F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.when(i % 50 == 0, "x").otherwise(F.floor("value").cast("string")), F.when(i % 30 == 0, "").otherwise(kind), F.when(kind == "error", "FALSE").otherwise("true"))
    return report.load_summary(report.load_rows(rows.select(line.alias("line"))))


_ANSWER = """concat('{"risk": "', CASE WHEN turn % 2 = 0 THEN 'high' ELSE 'low' END, '", "points": ["a', turn, '", "b"], "choices": [{"message": {"content": "say \\"', turn, '\\""}}]', CASE WHEN turn % 3 = 0 THEN ', "summary_text": "s"' ELSE ', "summary": "t"' END, CASE WHEN turn % 5 = 0 THEN '' ELSE '}' END)"""


@query("answer_fields", """SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN NULL WHEN turn % 2 = 0 THEN 'high' ELSE 'low' END AS risk, CASE WHEN turn % 5 = 0 THEN NULL ELSE concat('a', turn, '; b') END AS points,
 CASE WHEN turn % 5 = 0 THEN NULL WHEN turn % 3 = 0 THEN 's' ELSE 't' END AS summary, CASE WHEN turn % 5 = 0 THEN NULL ELSE concat('say "', turn, '"') END AS content FROM conversations""")
def answer_fields(spark, sf_dir):
    """Fields of answers in JSON: a text, a list as text, the first of several names; null where an answer is cut short."""
    t = F.col("turn")
    body = F.concat(F.lit('{"risk": "'), F.when(t % 2 == 0, "high").otherwise("low"), F.lit('", "points": ["a'), t, F.lit('", "b"], "choices": [{"message": {"content": "say \\"'), t, F.lit('\\""}}]'),
                    F.when(t % 3 == 0, ', "summary_text": "s"').otherwise(', "summary": "t"'), F.when(t % 5 == 0, "").otherwise("}"))
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("a"))
    return own.select("conv_id", "turn", report.field("a", "risk").alias("risk"), report.field("a", "points").alias("points"), report.field("a", "summary", "summary_text").alias("summary"), report.field("a", "choices[0].message.content").alias("content"))


@query("update_check", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size >= p_partkey % 50 END AS up_to_date FROM part")
def update_check(spark, sf_dir):
    """Whether a version is as new as a tag; unknown for tags without a number."""
    current = F.concat(F.when(F.col("p_partkey") % 2 == 0, "v").otherwise(""), F.lit("1."), "p_size")
    tag = F.when(F.col("p_partkey") % 7 == 0, "rolling").otherwise(F.concat(F.lit("V1."), F.col("p_partkey") % 50))
    return table(spark, sf_dir, "part").select("p_partkey", versions.up_to_date(current, tag).alias("up_to_date"))


@query("report_labels", f"""WITH {DIFF_SQL} SELECT key, CASE status WHEN 'ADDED' THEN '新增 +' WHEN 'DELETED' THEN '删除 -' WHEN 'MODIFIED' THEN '修改 ~' ELSE '未变 =' END AS label, replace(concat(key, '|', status), '|', '\\|') AS cell,
 CASE WHEN length(key) % 3 = 0 THEN 'AI 智能分析报告' WHEN length(key) % 3 = 1 THEN concat(status, '报告') ELSE concat(status, '报告') END AS title FROM diff""")
def report_labels(spark, sf_dir):
    n = F.length("key")
    focus = F.when(n % 3 == 0, "").when(n % 3 == 1, F.col("status")).otherwise(F.concat("status", F.lit("报告")))
    return compared(spark, sf_dir).select("key", report.status_label(F.col("status")).alias("label"), report.cell(F.concat("key", F.lit("|"), "status")).alias("cell"), report.title(focus).alias("title"))


@query("entry_routes", f"WITH {DIFF_SQL} SELECT CASE WHEN file_class = 'CLASS' THEN 'class' WHEN file_class IN ('ARCHIVE', 'JAR') THEN 'archive' WHEN file_class = 'OFFICE' THEN 'office' WHEN file_class IN {DIFFABLE} OR regexp_matches(lower(key), '\\.(java)$') THEN 'text' ELSE 'binary' END AS route, count(*) AS n FROM diff GROUP BY 1")
def entry_routes(spark, sf_dir):
    """How each entry is compared, by its class."""
    return compared(spark, sf_dir).groupBy(report.route(F.col("key"), F.col("file_class")).alias("route")).agg(F.count("*").alias("n"))


@query("classify_coverage", f"WITH {DIFF_SQL}, c AS (SELECT * FROM diff WHERE status <> 'UNCHANGED') SELECT count(*) AS total_changed, count(*) FILTER (file_class = 'CONFIG' OR file_class IN {FRONT}) AS low, least(count(*), {OPTIONS.top_k}) AS read, round(100.0 * least(count(*), {OPTIONS.top_k}) / count(*), 2) AS coverage FROM c")
def classify_coverage(spark, sf_dir):
    """How many changes are labelled, and what share of them is read closely."""
    return report.coverage(compared(spark, sf_dir).where("status <> 'UNCHANGED'"), OPTIONS.top_k)


_TREE = """t AS (SELECT coalesce(source, 'none') AS project, concat('m', doc_id % 5, '/', CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN 'pom.xml' WHEN 1 THEN concat('src/A', doc_id, '.java') WHEN 2 THEN concat('src/b/B', doc_id, '.java') WHEN 3 THEN 'package.json' ELSE concat('doc/d', doc_id, '.md') END) AS path, doc_id * 1000 AS mtime FROM documents)"""


def project_files(spark, sf_dir):
    i = F.col("doc_id")
    name = F.when(i % 8 == 0, "pom.xml").when(i % 8 == 1, F.concat(F.lit("src/A"), i, F.lit(".java"))).when(i % 8 == 2, F.concat(F.lit("src/b/B"), i, F.lit(".java"))).when(i % 8 == 3, "package.json").otherwise(F.concat(F.lit("doc/d"), i, F.lit(".md")))
    return table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("project"), F.concat(F.lit("m"), i % 5, F.lit("/"), name).alias("path"), (i * 1000).alias("mtime"))


@query("project_fingerprints", f"WITH {_TREE} SELECT project, count(*) AS files, count(*) FILTER (path LIKE '%.java') AS java_files, sha256(concat_ws('|', count(*), max(mtime), coalesce(string_agg(DISTINCT path, ',' ORDER BY path) FILTER (path LIKE '%pom.xml' OR path LIKE '%package.json'), ''))) AS fingerprint FROM t GROUP BY project")
def project_fingerprints(spark, sf_dir):
    return report.fingerprints(project_files(spark, sf_dir))


@query("stale_projects", f"WITH {_TREE} SELECT project FROM t GROUP BY project HAVING length(project) % 2 = 0 OR project LIKE '%1'")
def stale_projects(spark, sf_dir):
    """Projects to be read again: those without a fresh enough index, and those whose fingerprint changed."""
    now = report.fingerprints(project_files(spark, sf_dir))
    known = now.where(F.length("project") % 2 == 1).select("project", F.when(F.col("project").endswith("1"), "other").otherwise(F.col("fingerprint")).alias("fingerprint"), F.lit(100).alias("read_at"))
    return report.stale(now, known, F.lit(130), 60).select("project")


@query("build_systems", f"WITH {_TREE} SELECT project, split_part(path, '/', 1) AS module, CASE WHEN bool_or(path LIKE 'm_/pom.xml') THEN 'Maven' WHEN bool_or(path LIKE 'm_/package.json') THEN 'npm' WHEN bool_or(path LIKE '%.java') THEN 'source' ELSE 'none' END AS build FROM t GROUP BY 1, 2")
def build_systems(spark, sf_dir):
    rows = project_files(spark, sf_dir)
    module = F.split("path", "/")
    return report.build_systems(rows.select("project", F.get(module, 0).alias("module"), F.expr("substring(path, 4)").alias("path")), ["project", "module"])


@query("nearest_aggregator", """WITH p AS (SELECT p_partkey AS id, concat('r', p_partkey % 4, '/g', p_partkey % 12, '/m', p_partkey, '/pom.xml') AS pom FROM part), a AS (SELECT 'r0' AS dir UNION ALL SELECT 'r1/g1' UNION ALL SELECT 'r1' UNION ALL SELECT 'r2/g6' )
 SELECT id, arg_max(dir, length(dir)) AS root FROM p LEFT JOIN a ON starts_with(pom, concat(dir, '/')) GROUP BY id""")
def nearest_aggregator(spark, sf_dir):
    """The nearest folder above a module whose build file lists modules."""
    i = F.col("p_partkey")
    poms = table(spark, sf_dir, "part").select(i.alias("id"), F.concat(F.lit("r"), i % 4, F.lit("/g"), i % 12, F.lit("/m"), i, F.lit("/pom.xml")).alias("path"))
    return report.nearest(poms, spark.createDataFrame([("r0",), ("r1/g1",), ("r1",), ("r2/g6",)], "dir string"), "id").select("id", F.col("dir").alias("root"))


@query("folder_report", """WITH l AS (SELECT concat('d', doc_id % 10, '/f', doc_id) AS path, strlen(coalesce(text, ''))::BIGINT AS size, doc_id * 1000 AS m, sha256(coalesce(text, '')) AS h FROM documents),
 r AS (SELECT concat(CASE WHEN doc_id % 7 = 0 THEN 'new/' ELSE '' END, 'd', doc_id % 10, '/f', doc_id) AS path, strlen(coalesce(text, ''))::BIGINT + (doc_id % 5 = 0)::INT AS size, doc_id * 1000 + (doc_id % 3 = 0)::INT AS m, sha256(concat(coalesce(text, ''), CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END)) AS h FROM documents),
 f AS (SELECT l.path AS lp, r.path AS rp, l.size = r.size AND l.m = r.m AND l.h = r.h AS same, l.h <> r.h AS content FROM l FULL JOIN r ON l.path = r.path),
 s AS (SELECT count(*) FILTER (rp IS NULL) AS a, count(*) FILTER (lp IS NULL) AS b, count(*) FILTER (NOT same) AS c, count(*) FILTER (NOT same AND content) AS d, count(*) FILTER (NOT same AND NOT content) AS e, count(*) FILTER (same) AS g, count(lp) + count(rp) AS h FROM f)
 SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS line_no, unnest([concat('| 仅左侧存在 (LEFT_ONLY) | ', a, ' |'), concat('| 仅右侧存在 (RIGHT_ONLY) | ', b, ' |'), concat('| 两侧不同 (MODIFIED) | ', c, ' |'), concat('|   ├ 内容不同 | ', d, ' |'), concat('|   └ 仅属性不同 | ', e, ' |'), concat('| 完全相同 (SAME) | ', g, ' |'), '| 类型冲突 (TYPE_MISMATCH) | 0 |', concat('| 扫描文件 / 目录 | ', h, ' / 0 |')]) AS line FROM s""")
def folder_report(spark, sf_dir):
    """The table of a folder report."""
    return report.folder_table(diff.folder_summary(folders(spark, sf_dir)))


@query("noise_renames", f"SELECT concat('core-036M059(20260101-0900)/conf/doc', doc_id, '.properties') AS key, concat('core-036M061(20260707-1135)/conf/doc', doc_id, '.properties') AS new_key, CASE WHEN doc_id % 4 = 0 THEN 'MODIFIED' ELSE 'UNCHANGED' END AS status, CASE WHEN doc_id % 4 = 0 THEN 'PATH' ELSE 'CONTENT' END AS match_kind FROM documents WHERE doc_id IS NOT NULL")
def noise_renames(spark, sf_dir):
    """Renamed files whose contents differ only in what a build writes into them are unchanged."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").selectExpr("doc_id", f"{TEXT} AS text")
    i = F.col("doc_id")

    def side(folder: str, stamp: str, body):
        t = F.concat(F.lit(f"#{stamp}\n"), F.lit("id="), i, F.lit("\n"), body)
        own = docs.select(F.concat(F.lit(f"{folder}/conf/doc"), i, F.lit(".properties")).alias("key"), t.alias("text"))
        keyed = own.select("key", text.content_key(F.col("key"), F.col("text"), OPTIONS.normalize_limit).alias("content_key"))
        return snapshot(own, F.col("key"), F.col("text")).join(keyed, "key")

    old = side("core-036M059(20260101-0900)", "Mon Jan 05 10:00:00 CST 2026", F.col("text"))
    new = side("core-036M061(20260707-1135)", "Tue Jul 07 11:35:00 CST 2026", F.when(i % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return align.align(diff.snapshot_diff(old, new, ("content_key",))).select("key", "new_key", "status", "match_kind")


@query("default_rules", f"""WITH {DIFF_SQL}, b AS (SELECT key, regexp_extract(key, '[^/]*$') AS name FROM diff) SELECT key, CASE WHEN regexp_matches(name, '^.+\\.') THEN regexp_extract(name, '\\.[^.]*$') ELSE '' END AS ext, name, regexp_extract(key, '^(.*/)?', 0) AS prefix FROM b""")
def default_rules(spark, sf_dir):
    """What a rule made from a key would ignore: its extension, its name, or its folder."""
    k = F.col("key")
    return compared(spark, sf_dir).select("key", *[report.default_rule(k, kind).alias(kind) for kind in ("ext", "name", "prefix")])


@query("log_bundle", r"""WITH l AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id), t AS (SELECT conv_id, CASE WHEN length(body) > 262144 THEN substr(right(body, 262144), strpos(right(body, 262144), chr(10)) + 1) ELSE body END AS body FROM l),
 u AS (SELECT *, 5242880 - coalesce(sum(length(body)) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM t) SELECT conv_id, length(body) AS n, length(body) <= rest AS taken FROM u""")
def log_bundle(spark, sf_dir):
    """The ends of logs, from their first whole line, as far as a bundle has room; the order of logs is that of their names."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("t")).alias("r"))
    logs = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["t"]), "\n").alias("body"))
    return report.bundle(logs.withColumn("body", report.tail(F.col("body"), report.LOG_TAIL)), "conv_id", "body", report.BUNDLE)


_PACKS = """k AS (SELECT doc_id, doc_id // 10 AS p FROM documents WHERE doc_id IS NOT NULL), o AS (SELECT concat('x/a', p, '.zip') AS key, concat('o', p) AS t FROM k WHERE p % 3 <> 0 GROUP BY p UNION ALL SELECT concat('x/a', p, '.zip!/d', doc_id), '' FROM k WHERE p % 3 <> 0),
 n AS (SELECT concat('x/a', p, '.zip') AS key, concat('n', p) AS t FROM k WHERE p % 3 <> 1 GROUP BY p UNION ALL SELECT concat('x/a', p, '.zip!/d', doc_id), CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END FROM k WHERE p % 3 <> 1),
 d AS (SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NULL THEN 'DELETED' WHEN o.key IS NULL THEN 'ADDED' WHEN o.t = n.t THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status FROM o FULL JOIN n ON o.key = n.key)"""


@query("whole_containers", f"WITH {_PACKS} SELECT key, status FROM d WHERE NOT (contains(key, '!/') AND split_part(key, '!/', 1) IN (SELECT key FROM d WHERE status IN ('ADDED', 'DELETED')))")
def whole_containers(spark, sf_dir):
    """A diff without what lies in archives that were added or deleted whole."""
    docs, i = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id"), F.col("doc_id")
    pack = F.floor(i / 10)

    def side(out: int, mark: str, body):
        own = docs.where(pack % 3 != out)
        archive = F.concat(F.lit("x/a"), pack.cast("string"), F.lit(".zip"))
        rows = own.select(archive.alias("key"), F.concat(F.lit(mark), pack.cast("string")).alias("text")).distinct()
        return snapshot(rows.unionByName(own.select(F.concat(archive, F.lit("!/d"), i).alias("key"), body.alias("text"))), F.col("key"), F.col("text"))

    rows = diff.snapshot_diff(side(0, "o", F.lit("")), side(1, "n", F.when(i % 5 == 0, "x").otherwise("")))
    whole = rows.where(F.col("status").isin("ADDED", "DELETED") & F.col("file_class").isin("ARCHIVE", "JAR")).select("key")
    return diff.outside_containers(rows, whole).select("key", "status")


@query("mojibake")
def mojibake_texts(spark, sf_dir):
    """Texts that are UTF-8 read as GBK."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return own.select("doc_id", mojibake.judged(F.col("text")).alias("j")).select("doc_id", "j.*")
