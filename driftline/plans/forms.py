"""Queries about single values: normal forms, versions, labels, sizes, and filters of the tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import beautify, labels, paths, text, versions
from ..model import KNOWN_TEXT, Options
from ..operators import diff, impact, lines, tree
from .compare import compared
from .inputs import DIFF_SQL, DIFFABLE, TEXT, in_sql, table

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


# ---- texts

#: Every document as a generated property file: a date comment, build numbers in three forms, an assignment, then its own lines.
_GENERATED = rf"""concat('#Mon Jan 02 10:00:00 CST 2023', chr(10), 'Timestamp: ', doc_id, chr(10), 'version = app-', doc_id % 90 + 10, 'M061(20260707-1135)', chr(10),
 'name: web', doc_id % 9, 'M1.20230101.15 tail', chr(10), 'file md5="', md5({TEXT}), '" size="', length({TEXT}), '" MD5 = "ab12"', chr(10), '# kept  ', chr(13), chr(10), {TEXT})"""
_MARK = "concat(chr(0), 'V', chr(0))"
_TOKENS = "regexp_replace(regexp_replace(regexp_replace({x}, '\\d+M\\d*(?:\\.\\d+)?\\(\\d[0-9.\\-]*\\)', {m}, 'g'), '\\d+M\\d*(?:\\.\\d+)?\\.\\d{{8}}\\.\\d+', {m}, 'g'), '\\d+M\\d*(?:\\.\\d+)?', {m}, 'g')".format(x="x", m=_MARK)
_NOISE = f"""g AS (SELECT doc_id, {_GENERATED} AS t FROM documents),
 b AS (SELECT doc_id, regexp_replace(replace(regexp_replace(t, '^' || chr(65279), ''), chr(13) || chr(10), chr(10)), '(?m)[ \\t]+$', '', 'g') AS t FROM g),
 k AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: NOT (starts_with(x, 'Timestamp:') OR (starts_with(trim(x), '#') AND regexp_matches(trim(substr(trim(x), 2)), '^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*\\s+[a-z]+\\s+\\d+.*\\d{{4}}$')))) AS l FROM b),
 v AS (SELECT doc_id, list_transform(l, lambda x: {_TOKENS}) AS l FROM k),
 n AS (SELECT doc_id, array_to_string(list_transform(l, lambda x: concat(CASE WHEN contains(x, {_MARK}) AND regexp_matches(x, concat('^\\s*[^=\\n]+[=:].*', {_MARK}, '.*$'))
   THEN concat(regexp_extract(x, concat('^(\\s*[^=\\n]+[=:]).*', {_MARK}, '.*$'), 1), {_MARK}) ELSE x END, chr(10))), '') AS t FROM v)"""


@query("noise_normal_form", f"WITH {_NOISE} SELECT doc_id, md5(t) AS plain, md5(regexp_replace(regexp_replace(t, 'md5\\s*=\\s*\"[0-9a-f]+\"', 'md5=\"*\"', 'gi'), 'size\\s*=\\s*\"\\d+\"', 'size=\"*\"', 'gi')) AS deployed FROM n")
def noise_normal_form(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_GENERATED} AS t")
    return rows.select("doc_id", F.md5(text.noise_normalized(F.col("t"))).alias("plain"), F.md5(text.deploy_normalized(F.col("t"))).alias("deployed"))


_LINES = f"SELECT doc_id, i, CASE i % 6 WHEN 0 THEN concat('  // ', x) WHEN 1 THEN concat('#', x) WHEN 2 THEN concat('/* ', x, ' */') WHEN 3 THEN concat('<!-- ', x, '-->') WHEN 4 THEN concat('a {{id=', i, '}} ', x) ELSE x END AS x FROM (SELECT doc_id, unnest(string_split({TEXT}, chr(10))) AS x, generate_subscripts(string_split({TEXT}, chr(10)), 1) - 1 AS i FROM documents)".replace("{{", "{").replace("}}", "}")
_BARE = "regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')"
_COMMENT = "(starts_with(trim({0}), '//') OR starts_with(trim({0}), '#') OR (starts_with(trim({0}), '/*') AND ends_with(trim({0}), '*/')) OR (starts_with(trim({0}), '<!--') AND ends_with(trim({0}), '-->')) OR starts_with(trim({0}), '*'))"


@query("rule_normal_form", f"""WITH l AS ({_LINES}), n AS (SELECT doc_id, i, {_BARE} AS bare, CASE WHEN {_COMMENT.format('x')} THEN '' ELSE x END AS code, CASE WHEN {_COMMENT.format(_BARE)} THEN '' ELSE {_BARE} END AS bare_code FROM l)
 SELECT doc_id, md5(string_agg(bare, chr(10) ORDER BY i)) AS bare, md5(string_agg(code, chr(10) ORDER BY i)) AS code, md5(string_agg(regexp_replace(bare_code, '[0-9]+', '', 'g'), chr(10) ORDER BY i)) AS masked FROM n GROUP BY doc_id""")
def rule_normal_form(spark, sf_dir):
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    shaped = F.transform(lines, lambda x, i: F.when(i % 6 == 0, F.concat(F.lit("  // "), x)).when(i % 6 == 1, F.concat(F.lit("#"), x)).when(i % 6 == 2, F.concat(F.lit("/* "), x, F.lit(" */")))
                         .when(i % 6 == 3, F.concat(F.lit("<!-- "), x, F.lit("-->"))).when(i % 6 == 4, F.concat(F.lit("a {id="), i, F.lit("} "), x)).otherwise(x))
    form = lambda *rules: F.md5(F.array_join(F.transform("l", lambda x: text.rule_normalized(x, *rules)), "\n"))
    return table(spark, sf_dir, "documents").select("doc_id", shaped.alias("l")).select("doc_id", form(True).alias("bare"), form(False, True).alias("code"), form(True, True, "[0-9]+").alias("masked"))


_JSP = "concat(replace(html, '<p>', '<% x %><p>'), chr(10), chr(10), ' ', chr(10), '<%= page_id %>')"


@query("jsp_split", f"""WITH s AS (SELECT page_id, string_split(replace(replace(replace(regexp_replace({_JSP}, '[ \\t]*\\n|\\r\\n?', chr(10), 'g'), '><', concat('>', chr(10), '<')), '<%', concat(chr(10), '<%')), '%>', concat('%>', chr(10))), chr(10)) AS l FROM pages)
 SELECT page_id, md5(array_to_string(list_transform(list_filter(l, lambda x, i: NOT (trim(x) = '' AND i > 1 AND trim(coalesce(l[i - 1], 'x')) = '')), lambda x: concat(x, chr(10))), '')) AS pretty FROM s""")
def jsp_split(spark, sf_dir):
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"{_JSP} AS h").select("page_id", F.md5(text.jsp_split(F.col("h"))).alias("pretty"))


@query("crc_text")
def crc_text(spark, sf_dir):
    """CRC-32 of texts as listings show it, dashes where there is none."""
    return table(spark, sf_dir, "documents").select("doc_id", text.crc_text(F.col("text").cast("binary")).alias("crc"))


@query("human_size", f"""WITH s AS (SELECT doc_id, (length({TEXT}) * (CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 97 WHEN 2 THEN 9973 ELSE 10000019 END))::BIGINT AS n FROM documents)
 SELECT doc_id, CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN concat(printf('%.1f', floor(n * 10 / 1024.0 + 0.5) / 10), ' KB')
 WHEN n < 1073741824 THEN concat(printf('%.1f', floor(n * 10 / 1048576.0 + 0.5) / 10), ' MB') ELSE concat(printf('%.1f', floor(n * 10 / 1073741824.0 + 0.5) / 10), ' GB') END AS size FROM s""")
def human_size(spark, sf_dir):
    n = F.length(F.coalesce("text", F.lit(""))) * F.when(F.col("doc_id") % 4 == 0, 1).when(F.col("doc_id") % 4 == 1, 97).when(F.col("doc_id") % 4 == 2, 9973).otherwise(10000019).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", text.human_size(n).alias("size"))


# ---- names and versions

_SEGMENT = "concat('app.', substr(md5(text), 1, CAST(doc_id % 9 AS INT) + 1), CASE WHEN doc_id % 2 = 0 THEN '.js' ELSE '.min.js' END)"


@query("content_hash_stripped", f"SELECT doc_id, regexp_replace({_SEGMENT}, '\\.[0-9a-f]{{6,}}(\\.[A-Za-z0-9]+)$', '\\1') AS segment FROM documents")
def content_hash_stripped(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_SEGMENT} AS s").select("doc_id", text.strip_content_hash(F.col("s")).alias("segment"))


_MANIFEST = "concat('Manifest-Version: 1.0', chr(10), CASE WHEN p_partkey % 3 = 0 THEN concat('Bundle-Version: ', p_size, '.0.1  ', chr(10)) ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN concat('Implementation-Version: ', p_partkey, '.2', chr(10)) ELSE '' END, 'Specification-Version: ', chr(10))"


@query("manifest_version", f"""WITH m AS (SELECT p_partkey, {_MANIFEST} AS t FROM part), v AS (SELECT p_partkey, nullif(trim(regexp_extract(t, '(?m)^Bundle-Version:[ \\t]*(.*)$', 1)), '') AS b, nullif(trim(regexp_extract(t, '(?m)^Implementation-Version:[ \\t]*(.*)$', 1)), '') AS i FROM m)
 SELECT p_partkey, b AS bundle, i AS implementation, CASE WHEN b IS NOT NULL THEN b ELSE i END AS best FROM v""")
def manifest_version(spark, sf_dir):
    """Versions that a manifest states; the one of more parts is the best."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_MANIFEST} AS t")
    own = rows.select("p_partkey", text.manifest_version(F.col("t"), "Bundle-Version").alias("bundle"), text.manifest_version(F.col("t"), "Implementation-Version").alias("implementation"))
    return own.withColumn("best", text.best_version(F.array("bundle", "implementation")))


@query("order_old_new", "SELECT p_partkey, CASE WHEN p_size <= p_partkey % 50 THEN concat('app-1.', p_size, '.zip') ELSE concat('app-1.', p_partkey % 50, '.zip') END AS old, CASE WHEN p_size <= p_partkey % 50 THEN concat('app-1.', p_partkey % 50, '.zip') ELSE concat('app-1.', p_size, '.zip') END AS new FROM part")
def order_old_new(spark, sf_dir):
    name = lambda n: F.concat(F.lit("app-1."), n, F.lit(".zip"))
    return table(spark, sf_dir, "part").select("p_partkey", versions.ordered(name(F.col("p_size")), name(F.col("p_partkey") % 50)).alias("o")).select("p_partkey", "o.old", "o.new")


_NAMES = """concat(CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'src/' ELSE 'a/META-INF/maven/' END, CASE CAST(doc_id % 11 AS INT) WHEN 0 THEN concat('Doc', doc_id, '.java') WHEN 1 THEN 'Makefile' WHEN 2 THEN '.gitignore' WHEN 3 THEN concat('x', doc_id, '.bin')
 WHEN 4 THEN 'pom.properties' WHEN 5 THEN 'META-INF/MANIFEST.MF' WHEN 6 THEN 'META-INF/MANIFEST.xml' WHEN 7 THEN 'note.MD' WHEN 8 THEN 'java' WHEN 9 THEN 'b.tar.lock' ELSE 'README' END)"""


@query("known_text_names", f"""WITH k AS (SELECT doc_id, {_NAMES} AS key FROM documents), f AS (SELECT *, lower(regexp_extract(key, '[^/]*$')) AS name FROM k)
 SELECT doc_id, CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN regexp_extract(name, '[^.]*$') IN {in_sql(KNOWN_TEXT)} ELSE name IN {in_sql(KNOWN_TEXT)} END AS known,
 key LIKE '%/META-INF/MANIFEST.MF' OR key LIKE '%/META-INF/MANIFEST.xml' OR (key LIKE '%/pom.properties' AND key LIKE '%/META-INF/maven/%') AS metadata, key LIKE '%/META-INF/MANIFEST.xml' AS deploy FROM f""")
def known_text_names(spark, sf_dir):
    k = F.col("key")
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_NAMES} AS key").select("doc_id", paths.is_known_text(k).alias("known"), paths.is_build_metadata(k).alias("metadata"), paths.is_deploy_manifest(k).alias("deploy"))


_SOURCE = "concat('package com.p', doc_id % 7, ';', chr(10), 'import java.util.List;', chr(10), '  import static com.q', doc_id % 5, '.Util.run ;', chr(10), 'import java.util.List;', chr(10), 'class Doc', doc_id, ' {}')"
_CLASS_KEY = "concat(CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'WEB-INF/classes/' WHEN 1 THEN 'BOOT-INF/classes/' WHEN 2 THEN 'lib/x.jar/' ELSE '' END, 'com/p', doc_id % 7, '/Doc', doc_id, CASE WHEN doc_id % 2 = 0 THEN '.java' ELSE '.class' END)"


@query("source_names", """SELECT doc_id, concat('com.p', doc_id % 7, '.Doc', doc_id) AS fqn, concat('Doc', doc_id) AS simple, concat('com.p', doc_id % 7) AS pkg, concat('com.p', doc_id % 7) AS stated, concat('java.util.List,com.q', doc_id % 5, '.Util.run') AS imports FROM documents""")
def source_names(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_SOURCE} AS t", f"{_CLASS_KEY} AS k").withColumn("fqn", impact.fqn(F.col("k")))
    return rows.select("doc_id", "fqn", impact.simple_name(F.col("fqn")).alias("simple"), impact.package(F.col("fqn")).alias("pkg"), impact.source_package(F.col("t")).alias("stated"), F.array_join(impact.source_imports(F.col("t")), ",").alias("imports"))


# ---- labels

_SAID = "concat(CASE CAST(turn % 5 AS INT) WHEN 0 THEN '风险 高 ' WHEN 1 THEN 'Low risk, 测试 ' WHEN 2 THEN '风险: medium ' WHEN 3 THEN '兼容性 critical 风险 ' ELSE '' END, coalesce(text, ''))"


@query("stated_labels", f"""WITH s AS (SELECT conv_id, turn, {_SAID} AS t FROM conversations) SELECT conv_id, turn, CASE WHEN contains(upper(trim(t)), 'HIGH') OR contains(t, '高') THEN 'HIGH' WHEN contains(upper(trim(t)), 'LOW') OR contains(t, '低') THEN 'LOW' ELSE 'MEDIUM' END AS risk,
 CASE WHEN NOT contains(t, '风险') THEN NULL {' '.join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for p, n in labels.SEVERITIES)} END AS severity,
 CASE WHEN trim(t) = '' THEN '' {' '.join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in labels.FOCUSES)} ELSE '' END AS focus FROM s""")
def stated_labels(spark, sf_dir):
    t = F.col("t")
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_SAID} AS t").select("conv_id", "turn", labels.normalized_risk(t).alias("risk"), labels.severity(t, t).alias("severity"), labels.focus(t).alias("focus"))


@query("output_tokens", "SELECT p_partkey, least(greatest(p_size * 100, least(greatest(0, p_partkey * 40 - p_size * 9 - 2048), 16384), 1024), greatest(0, p_partkey * 40 - p_size * 9 - 1))::BIGINT AS tokens FROM part")
def output_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", labels.output_tokens(F.col("p_size") * 100, F.col("p_partkey") * 40, F.col("p_size") * 9).cast("long").alias("tokens"))


# ---- filters, orders and totals of a diff

_LABELLED = f"""{DIFF_SQL}, risks AS (SELECT key, CASE length(key) % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'CRITICAL' END AS risk FROM diff WHERE length(key) % 5 <> 0)"""


def risks(rows: DataFrame) -> DataFrame:
    """(key, risk) of the entries that somebody has judged."""
    n = F.length("key")
    return rows.where(n % 5 != 0).select("key", F.when(n % 4 == 0, "HIGH").when(n % 4 == 1, "MEDIUM").when(n % 4 == 2, "LOW").otherwise("CRITICAL").alias("risk"))


@query("risk_filter", f"WITH {_LABELLED} SELECT d.key FROM diff d JOIN risks r ON d.key = r.key WHERE risk IN ('HIGH', 'CRITICAL')")
def risk_filter(spark, sf_dir):
    rows = compared(spark, sf_dir)
    return tree.with_risk(rows, risks(rows), ("HIGH", "CRITICAL")).select("key")


@query("combined_filters", f"WITH {_LABELLED} SELECT d.key FROM diff d JOIN risks r ON d.key = r.key WHERE status IN ('ADDED', 'MODIFIED') AND risk <> 'LOW' AND contains(lower(d.key), 'doc1') AND NOT starts_with(d.key, 'img/') AND d.key <> 'conf/en/doc15.xml'")
def combined_filters(spark, sf_dir):
    rows = compared(spark, sf_dir)
    excluded = spark.createDataFrame([("conf/en/doc15.xml",)], "key string")
    rules = spark.createDataFrame([("prefix", "img")], "type string, value string")
    chosen = tree.Filters(statuses=("ADDED", "MODIFIED"), risks=("HIGH", "MEDIUM", "CRITICAL"), search="Doc1")
    return tree.filtered(rows, chosen, risks(rows), excluded, rules).select("key")


@query("risk_badges", f"WITH {_LABELLED} SELECT d.key, status, risk FROM diff d LEFT JOIN risks r ON d.key = r.key WHERE status <> 'UNCHANGED'")
def risk_badges(spark, sf_dir):
    rows = compared(spark, sf_dir)
    return rows.where("status <> 'UNCHANGED'").select("key", "status").join(risks(rows), "key", "left")


@query("risk_counts", f"WITH {_LABELLED} SELECT count(*) FILTER (risk = 'CRITICAL') AS critical, count(*) FILTER (risk = 'HIGH') AS high, count(*) FILTER (risk = 'MEDIUM') AS medium, count(*) FILTER (risk = 'LOW') AS low, arg_max(risk, CASE risk WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS most FROM risks")
def risk_counts(spark, sf_dir):
    return tree.risk_counts(risks(compared(spark, sf_dir)))


@query("content_changes", f"WITH {DIFF_SQL} SELECT key FROM diff WHERE status = 'MODIFIED' AND string_split(old_text, chr(10)) <> string_split(new_text, chr(10)) AND file_class IN {DIFFABLE} AND old_size <= 4194304 AND new_size <= 4194304")
def content_changes(spark, sf_dir):
    """Entries whose texts differ in a line: those of a size and class that is compared by line."""
    rows = compared(spark, sf_dir)
    return tree.line_diffable(rows, OPTIONS.text_limit).where("status = 'MODIFIED'").select("key")


@query("flattened_descendants", "WITH e AS (SELECT CASE WHEN doc_id % 10 < 3 THEN concat('x/a', doc_id // 10, '.zip') WHEN doc_id % 10 < 7 THEN concat('x/a', doc_id // 10, '.zip!/in/d', doc_id) ELSE concat('y/b', doc_id // 10, '.txt/d', doc_id) END AS key FROM documents) SELECT DISTINCT key FROM e WHERE NOT contains(key, '.zip!/') OR NOT EXISTS (SELECT 1 FROM e c WHERE c.key = split_part(e.key, '!/', 1))")
def flattened_descendants(spark, sf_dir):
    """The tree without what lies in archives that are entries themselves."""
    i = F.col("doc_id")
    pack = F.floor(i / 10).cast("string")
    key = (F.when(i % 10 < 3, F.concat(F.lit("x/a"), pack, F.lit(".zip"))).when(i % 10 < 7, F.concat(F.lit("x/a"), pack, F.lit(".zip!/in/d"), i)).otherwise(F.concat(F.lit("y/b"), pack, F.lit(".txt/d"), i)))
    return tree.without_flattened(table(spark, sf_dir, "documents").select(key.alias("key")).distinct())


_TOP = 200


@query("sorted_by_risk", f"""WITH {_LABELLED} SELECT d.key, row_number() OVER (ORDER BY CASE risk WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, CASE status WHEN 'MODIFIED' THEN 0 WHEN 'ADDED' THEN 1 WHEN 'DELETED' THEN 2 ELSE 3 END, d.key) AS pos
 FROM diff d LEFT JOIN risks r ON d.key = r.key QUALIFY pos <= {_TOP}""")
def sorted_by_risk(spark, sf_dir):
    """A page of the list: the most risky first, then by status and path."""
    rows = compared(spark, sf_dir)
    return tree.page(rows.join(risks(rows), "key", "left"), tree.by_risk("status"), _TOP).select("key", "pos")


@query("sorted_by_name", f"WITH {DIFF_SQL} SELECT key, row_number() OVER (ORDER BY regexp_extract(key, '[^/]*$'), key) AS pos FROM diff QUALIFY pos <= {_TOP}")
def sorted_by_name(spark, sf_dir):
    return tree.page(compared(spark, sf_dir), tree.by_name(), _TOP).select("key", "pos")


@query("tree_order", f"""WITH {DIFF_SQL}, p AS (SELECT key, string_split(key, '/') AS s FROM diff), d AS (SELECT DISTINCT array_to_string(s[1:i], '/') AS key FROM (SELECT s, unnest(range(1, len(s))) AS i FROM p)),
 every AS (SELECT key, 'DIR' AS kind FROM d UNION ALL SELECT key, 'FILE' FROM diff)
 SELECT key, kind, row_number() OVER (ORDER BY list_transform(string_split(key, '/'), lambda x, i: concat(CASE WHEN kind = 'FILE' AND i = len(string_split(key, '/')) THEN '1' ELSE '0' END, x))) AS pos FROM every QUALIFY pos <= {_TOP}""")
def tree_order(spark, sf_dir):
    """A page of the tree: folders before files, each folder's own entries below it."""
    return tree.page(diff.tree(compared(spark, sf_dir)), tree.in_tree(), _TOP).select("key", "kind", "pos")


@query("layer_order", f"WITH {DIFF_SQL} SELECT CASE WHEN key LIKE 'WEB-INF/classes/%' THEN 'L1' ELSE 'L0' END AS layer, count(*) AS n, dense_rank() OVER (ORDER BY CASE WHEN key LIKE 'WEB-INF/classes/%' THEN 1 ELSE 0 END) AS pos FROM diff GROUP BY 1, CASE WHEN key LIKE 'WEB-INF/classes/%' THEN 1 ELSE 0 END")
def layer_order(spark, sf_dir):
    layer = paths.layer(F.col("key"), F.lit("WAR"), F.lit("WEB-INF/classes/"), OPTIONS.internal_prefixes)
    return tree.layers(compared(spark, sf_dir).select(layer.alias("layer")))


_ROWS_OF_CLASSES = "c AS (SELECT l_orderkey % 40 AS jar, l_linenumber AS no, CASE CAST((l_orderkey + l_linenumber) % 4 AS INT) WHEN 0 THEN 'UNCHANGED' WHEN 1 THEN 'ADDED' ELSE 'MODIFIED' END AS status, CASE WHEN (l_partkey % 9) = 0 THEN false WHEN l_partkey % 3 = 0 THEN true END AS read FROM lineitem)"


@query("jar_class_split", f"WITH {_ROWS_OF_CLASSES} SELECT jar, count(*) FILTER (status = 'UNCHANGED') AS unchanged, count(*) FILTER (read = false) AS failed, count(*) - count(*) FILTER (status = 'UNCHANGED') - count(*) FILTER (read = false) - count(*) FILTER (read) AS beyond FROM c GROUP BY jar")
def jar_class_split(spark, sf_dir):
    """What a report says about the classes of a library that it doesn't show."""
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    status = F.when((k + F.col("l_linenumber")) % 4 == 0, "UNCHANGED").when((k + F.col("l_linenumber")) % 4 == 1, "ADDED").otherwise("MODIFIED")
    return tree.class_split(table(spark, sf_dir, "lineitem").select((k % 40).alias("jar"), status.alias("status"), F.when(p % 9 == 0, False).when(p % 3 == 0, True).alias("read")))


@query("api_counts", "WITH c AS (SELECT unnest(CASE WHEN p_partkey % 5 = 0 THEN ['SIGNATURE_CHANGED'] WHEN p_partkey % 7 = 0 THEN ['REMOVED_API', 'ADDED_API'] ELSE [] END) AS level FROM part) SELECT count(*) FILTER (level = 'REMOVED_API') AS removed, count(*) FILTER (level = 'SIGNATURE_CHANGED') AS changed, count(*) FILTER (level = 'ADDED_API') AS added FROM c")
def api_counts(spark, sf_dir):
    from .content import api_changes

    return impact.api_counts(api_changes(spark, sf_dir))


_USAGE = """concat('{"usage": {"prompt_tokens": ', turn * 7 + 3, ', "completion_tokens": ', length(coalesce(text, '')), '}}')"""


@query("token_usage", "SELECT conv_id, sum(turn * 7 + 3)::BIGINT AS prompt_tokens, sum(length(coalesce(text, '')))::BIGINT AS completion_tokens, count(*) AS calls FROM conversations GROUP BY conv_id")
def token_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", f"{_USAGE} AS answer")
    return tree.usage(rows, "answer", "conv_id")


@query("bytes_in_memory", f"WITH {DIFF_SQL} SELECT coalesce(sum(new_size) FILTER (new_size <= 65536), 0)::BIGINT AS held, count(*) FILTER (new_size <= 65536) AS entries FROM diff WHERE status <> 'DELETED'")
def bytes_in_memory(spark, sf_dir):
    return tree.held_bytes(compared(spark, sf_dir).where("status <> 'DELETED'"), "new_size")


# ---- front-end texts

#: By id: a style and a script on one line, a page, a configuration.
_FRONT_CLASS = "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'CSS' WHEN 1 THEN 'JS' WHEN 2 THEN 'HTML' ELSE 'CONFIG' END"
_PIECE = "concat('a', doc_id, '{b:\"x;}\";c:d}')"
_FRONT_TEXT = f"CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN repeat({_PIECE}, 30) WHEN 1 THEN repeat({_PIECE}, 30) WHEN 2 THEN '<p><b>x</b></p>' ELSE concat('k=v  ', chr(13), chr(10), 'l=w') END"
_SPREAD = "concat('a', doc_id, '{', chr(10), '  b:\"x;}\";', chr(10), '  c:d', chr(10), '}')"
_FORM = f"CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN repeat({_SPREAD}, 30) WHEN 1 THEN repeat({_SPREAD}, 30) WHEN 2 THEN concat('<p>', chr(10), '<b>x</b>', chr(10), '</p>') ELSE concat('k=v  ', chr(10), 'l=w') END"


@query("frontend_forms", f"SELECT doc_id, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'css-beautify' WHEN 1 THEN 'js-beautify' WHEN 2 THEN 'html-beautify' ELSE 'text-normalize' END AS engine, md5({_FORM}) AS form FROM documents WHERE doc_id IS NOT NULL")
def frontend_forms(spark, sf_dir):
    """Front-end texts in the form in which they are compared."""
    rows = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").selectExpr("doc_id", f"{_FRONT_CLASS} AS cls", f"{_FRONT_TEXT} AS t")
    return rows.select("doc_id", beautify.engine(F.col("cls")).alias("engine"), F.md5(beautify.beautified(F.col("t"), F.col("cls"))).alias("form"))


@query("frontend_diff", "SELECT doc_id, 2 AS deleted, 2 AS added FROM documents WHERE doc_id IS NOT NULL AND doc_id % 4 < 2 UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE doc_id % 4 >= 2")
def frontend_diff(spark, sf_dir):
    """Minified texts that differ in two places differ in two lines of their forms."""
    rows = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").selectExpr("doc_id", f"{_FRONT_CLASS} AS cls", f"{_FRONT_TEXT} AS t")
    last = f"length(t) - length({_PIECE})"  # the first letter of the first and of the last piece becomes another
    rows = rows.withColumn("u", F.expr(f"CASE WHEN doc_id % 4 < 2 THEN concat('z', substring(t, 2, {last} - 1), 'z', substring(t, {last} + 2)) ELSE t END"))
    form = lambda c: F.split(beautify.beautified(F.col(c), F.col("cls")), "\n")
    both = rows.select("doc_id", form("t").alias("old"), form("u").alias("new"))
    ops = lines.lcs_diff(both, "doc_id", "old", "new").groupBy("doc_id").agg(F.count_if(F.col("op") == "del").alias("deleted"), F.count_if(F.col("op") == "add").alias("added"))
    return ops.select("doc_id", "deleted", "added")
