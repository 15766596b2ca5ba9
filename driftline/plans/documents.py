"""Queries that make documents: Markdown, reports, prompts, answers, projects, tokens of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers, beautify, lexer, paths, text
from ..model import Options
from ..operators import align, diff, document, impact, lines, markdown, projects, report
from ..sources import archives
from ..sources.tables import cut
from .compare import compared, renamed
from .inputs import DIFF_SQL, DIFFABLE, LIB_JAR, TEXT, label_sql, table, versions
from .trees import _FOLDER, shared_folder, two_folders, write_files

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


# ---- Markdown


_MARKED = """CASE CAST((doc_id + i * 5) % 14 AS INT) WHEN 0 THEN concat('## ', l) WHEN 1 THEN concat('- ', l) WHEN 2 THEN concat('  ', l) WHEN 3 THEN concat('> ', l) WHEN 4 THEN '```' WHEN 5 THEN concat('3. ', l) WHEN 6 THEN concat('| ', l, ' |')
 WHEN 7 THEN '|---|' WHEN 8 THEN '' WHEN 9 THEN '- - -' WHEN 10 THEN concat('#', l) ELSE l END"""


@query("markdown_blocks", f"""WITH RECURSIVE t AS (SELECT doc_id, string_split({TEXT}, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL),
 x AS (SELECT doc_id, i, {_MARKED} AS l FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l FROM t)),
 c AS (SELECT doc_id, i, l, regexp_replace(l, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS s, lead(regexp_replace(l, '[\\x00-\\x20]', '', 'g')) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM x WHERE l IS NOT NULL),
 k AS (SELECT *, s = '' AS blank, s LIKE '```%' AS fence, regexp_matches(s, '^#{{1,6}}( |$)') AS heading, s LIKE '#%' AS hashy, contains(s, '|') AND contains(coalesce(nx, ''), '-') AND regexp_full_match(replace(coalesce(nx, ''), '|', ''), '[-:]+') AS grid, contains(s, '|') AS pipe,
   regexp_full_match(replace(s, ' ', ''), '-{{3,}}|\\*{{3,}}|_{{3,}}') AS rule, regexp_matches(s, '^([-*]|[0-9]+\\.)[\\t\\n\\x0b\\f\\r ]') AS item, l LIKE ' %' AS dented, s LIKE '>%' AS cited FROM c),
 r(doc_id, i, state, block, kind) AS (
  SELECT doc_id, 0::BIGINT, 'NONE', 0, '' FROM k GROUP BY doc_id
  UNION ALL SELECT r.doc_id, r.i + 1,
   CASE WHEN r.state = 'CODE' THEN CASE WHEN k.fence THEN 'NONE' ELSE 'CODE' END WHEN r.state = 'TABLE' THEN 'ROWS' WHEN r.state = 'ROWS' AND k.pipe AND NOT k.fence THEN 'ROWS' WHEN r.state = 'LIST' AND NOT k.blank AND (k.item OR k.dented) THEN 'LIST'
    WHEN r.state = 'QUOTE' AND k.cited THEN 'QUOTE' WHEN r.state = 'PARAGRAPH' AND NOT (k.blank OR k.hashy OR k.rule OR k.fence OR k.item OR k.cited OR k.grid) THEN 'PARAGRAPH'
    WHEN k.blank THEN 'NONE' WHEN k.fence THEN 'CODE' WHEN k.heading THEN 'NONE' WHEN k.grid THEN 'TABLE' WHEN k.rule THEN 'NONE' WHEN k.item THEN 'LIST' WHEN k.cited THEN 'QUOTE' ELSE 'PARAGRAPH' END,
   r.block + CASE WHEN r.state IN ('CODE', 'TABLE') OR r.state = 'ROWS' AND k.pipe AND NOT k.fence OR r.state = 'LIST' AND NOT k.blank AND (k.item OR k.dented) OR r.state = 'QUOTE' AND k.cited
    OR r.state = 'PARAGRAPH' AND NOT (k.blank OR k.hashy OR k.rule OR k.fence OR k.item OR k.cited OR k.grid) OR k.blank THEN 0 ELSE 1 END,
   CASE WHEN r.state IN ('CODE', 'TABLE') OR r.state = 'ROWS' AND k.pipe AND NOT k.fence OR r.state = 'LIST' AND NOT k.blank AND (k.item OR k.dented) OR r.state = 'QUOTE' AND k.cited
    OR r.state = 'PARAGRAPH' AND NOT (k.blank OR k.hashy OR k.rule OR k.fence OR k.item OR k.cited OR k.grid) OR k.blank THEN r.kind
    WHEN k.fence THEN 'CODE' WHEN k.heading THEN 'HEADING' WHEN k.grid THEN 'TABLE' WHEN k.rule THEN 'HR' WHEN k.item THEN 'LIST' WHEN k.cited THEN 'QUOTE' ELSE 'PARAGRAPH' END
  FROM r JOIN k ON k.doc_id = r.doc_id AND k.i = r.i + 1),
 p AS (SELECT r.doc_id, r.block, r.kind, r.i, k.s, r.state FROM r JOIN k USING (doc_id, i) WHERE NOT (k.blank AND r.state = 'NONE') AND r.block > 0),
 b AS (SELECT doc_id, block AS block_no, any_value(kind) AS type, string_agg(s, ' ' ORDER BY i) AS joined, min_by(s, i) AS first, count(*) AS n FROM p GROUP BY doc_id, block)
 SELECT doc_id, block_no, type, CASE WHEN type = 'PARAGRAPH' THEN md5(joined) WHEN type = 'HEADING' THEN md5(regexp_replace(regexp_replace(first, '^#+', ''), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')) END AS text FROM b""")
def markdown_blocks(spark, sf_dir):
    """Documents marked up line by line, as blocks."""
    own = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").selectExpr("doc_id", f"array_join(transform(split({TEXT}, '\\n'), (l, j) -> {_MARKED.replace('i * 5', '(j + 1) * 5')}), '\\n') AS text")
    found = markdown.blocks(own, "doc_id", "text")
    return found.select("doc_id", "block_no", "type", F.when(F.col("type").isin("PARAGRAPH", "HEADING"), F.md5("text")).alias("text"))


@query("inline_marks", f"""WITH c AS (SELECT doc_id, replace(replace({TEXT}, '*', ''), '`', '') AS c FROM documents WHERE doc_id IS NOT NULL), t AS (SELECT doc_id, replace(c, '. ', '** ') AS s, (length(c) - length(replace(c, '. ', ''))) // 2 AS n FROM c)
 SELECT doc_id, (n // 2)::BIGINT AS bold, length(replace(s, '**', '')) + 2 * (n % 2) AS characters FROM t""")
def inline_marks(spark, sf_dir):
    """Texts whose sentences end in a mark: every second one is bold, one that nothing closes stays a mark."""
    own = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").selectExpr("doc_id", f"replace(replace(replace({TEXT}, '*', ''), '`', ''), '. ', '** ') AS s")
    tokens = own.select("doc_id", markdown.inline_tokens(F.col("s")).alias("t"))
    return tokens.select("doc_id", F.size(F.filter("t", lambda x: x["kind"] == "BOLD")).cast("long").alias("bold"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.length(x["value"])).alias("characters"))


# ---- answers, logs


_JSON = """concat('{"overallRisk": "', CASE WHEN turn % 2 = 0 THEN 'HIGH' ELSE 'LOW' END, '", "impactScope": ["m', turn, '", "n }]"], "fileRisks": [{"file": "f', conv_id, '", "risk": "LOW"}, {"key": "g"}], "suggestions": {"a": "b', turn, '", "c": ["d", "e"]}, "rollbackPlan": "back to ', conv_id, '"}')"""


@query("cut_answers", f"""WITH a AS (SELECT conv_id, turn, CASE CAST(turn % 3 AS INT) WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 40 END AS cut FROM conversations)
 SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS risk, concat('m', turn, chr(10), 'n }}]') AS scope, concat('f', conv_id, '=LOW;g=MEDIUM') AS files,
  CASE WHEN cut < 40 THEN concat('- a：b', turn, chr(10), '- c：', chr(10), '  d', chr(10), '  e') ELSE concat('{{"a": "b', turn, '"') END AS suggestions,
  CASE WHEN cut = 0 THEN concat('back to ', conv_id) WHEN cut = 4 THEN concat('"', rtrim(substr(concat('back to ', conv_id), 1, length(concat('back to ', conv_id)) - 2))) ELSE '' END AS rollback FROM a""")
def cut_answers(spark, sf_dir):
    """Fields of answers of which some are cut inside their last text, and some inside an object."""
    own = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_JSON} AS a")
    size = F.length("a") - F.when(F.col("turn") % 3 == 1, 4).otherwise(0)
    # The longest cut ends inside the second item of the object's list, whatever the numbers' lengths.
    size = F.when(F.col("turn") % 3 == 2, F.instr("a", '"e"]}') + 1).otherwise(size)
    read = own.select("conv_id", "turn", answers.parsed(F.substring("a", F.lit(1), size.cast("int"))).alias("p"))
    files = F.array_join(F.transform("p.files", lambda f: F.concat_ws("=", f["key"], f["risk"])), ";")
    return read.select("conv_id", "turn", "p.risk", F.col("p.impact_scope").alias("scope"), files.alias("files"), "p.suggestions", "p.rollback")


@query("load_log_xml", """WITH r AS (SELECT CASE WHEN event_id % 30 = 0 THEN 'ALL' ELSE event_type END AS label, CAST(floor(value) AS BIGINT) AS e, epoch_ms(ts) AS t, event_type <> 'error' AS ok FROM events WHERE event_id % 50 <> 0), d AS (SELECT (max(t + e) - min(t)) / 1000.0 AS seconds FROM r)
 SELECT label, count(*) AS n, round(avg(e), 4) AS mean, min(e) AS least, max(e) AS most, count(*) FILTER (NOT ok) AS errors, round(100.0 * count(*) FILTER (NOT ok) / count(*), 4) AS error_rate, round(count(*) / any_value(seconds), 6) AS per_second FROM r, d GROUP BY label""")
def load_log_xml(spark, sf_dir):
    """A load test's logs in XML, a file for every thousand samples."""
    i, kind, root = F.col("event_id"), F.col("event_type"), shared_folder(spark)
    sample = F.concat(F.lit('<httpSample t="'), F.when(i % 50 == 0, "x").otherwise(F.floor("value").cast("string")), F.lit('" ts="'), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.lit('" s="'), F.when(kind == "error", "FALSE").otherwise("true"),
                      F.lit('" lb="'), F.when(i % 30 == 0, "").otherwise(kind), F.lit('"><x>&lt;</x></httpSample>\n'))
    rows = table(spark, sf_dir, "events").groupBy(F.floor(i / 1000).alias("part")).agg(F.array_join(F.collect_list(sample), "").alias("samples"))
    write_files(rows.select(F.concat(F.lit("log"), "part", F.lit(".xml")).alias("path"), F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<testResults version="1.2">\n'), "samples", F.lit("</testResults>\n")).alias("text"), F.lit(0).alias("time")), root)
    return report.load_summary(report.load_xml(spark, f"file://{root}"))


# ---- projects


_FILES = """SELECT concat(coalesce(source, 'none'), '/', CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN 'pom.xml' WHEN 1 THEN concat('m', doc_id % 5, '/pom.xml') WHEN 2 THEN concat('m', doc_id % 5, '/src/main/java/com/', coalesce(lang, 'none'), '/p', doc_id % 3, '/D', doc_id, 'Service.java')
  WHEN 3 THEN concat('ui', doc_id % 2, '/package.json') WHEN 4 THEN concat('ui', doc_id % 2, '/index.html') WHEN 5 THEN concat('m', doc_id % 5, '/src/main/java/com/Shop', doc_id, 'Application.java') WHEN 6 THEN concat('m', doc_id % 5, '/target/pom.xml') WHEN 7 THEN concat('conf/c', doc_id, '.conf') ELSE concat('doc/d', doc_id, '.md') END) AS path,
  CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN '<packaging>pom</packaging><module>m0</module><module>m1</module><module>m2</module><artifactId>spring-x</artifactId>' WHEN 3 THEN '{}' WHEN 5 THEN 'public static void main' ELSE '' END AS text, doc_id FROM documents WHERE doc_id IS NOT NULL"""


def _project_tree(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs.createOrReplaceTempView("driftline_documents")
    return spark.sql(_FILES.replace("FROM documents", "FROM driftline_documents")).groupBy("path").agg(F.min("text").alias("text"))


_ROOTS = f"""f AS ({_FILES}), d AS (SELECT DISTINCT path, split_part(path, '/', 1) AS top FROM f),
 roots AS (SELECT top AS root FROM d WHERE path = concat(top, '/pom.xml') UNION SELECT regexp_extract(path, '^(.*)/', 1) FROM d WHERE regexp_matches(path, '/m[0-4]/pom\\.xml$') AND (NOT regexp_matches(path, '/m[0-2]/pom\\.xml$') OR top NOT IN (SELECT top FROM d WHERE path = concat(top, '/pom.xml')))
  UNION SELECT regexp_extract(path, '^(.*)/', 1) FROM d WHERE path LIKE '%/package.json')"""


@query("project_roots", f"WITH {_ROOTS} SELECT root FROM roots")
def project_roots(spark, sf_dir):
    """Where projects begin in a tree of files."""
    return projects.roots(_project_tree(spark, sf_dir))


@query("project_contexts", f"""WITH {_ROOTS}, o AS (SELECT DISTINCT root, path, substr(path, length(root) + 2) AS rel FROM roots JOIN d ON path LIKE concat(root, '/%') WHERE NOT contains(path, '/target/')),
 g AS (SELECT root, bool_or(rel = 'pom.xml') AS maven, list(DISTINCT rel) FILTER (rel LIKE '%Application.java' OR rel LIKE '%index.html') AS entry, list(DISTINCT rel) FILTER (rel LIKE '%.conf') AS conf, count(*) FILTER (rel LIKE '%Service.java') AS services FROM o GROUP BY root)
 SELECT root, CASE WHEN maven THEN 'Maven' ELSE 'npm' END AS build_system, CASE WHEN maven AND NOT contains(root, '/') THEN 'm0,m1,m2' WHEN maven THEN '' ELSE '' END AS modules, CASE WHEN maven AND NOT contains(root, '/') THEN 'spring-x' ELSE '' END AS dependencies,
  array_to_string(list_sort(coalesce(entry, []))[:20], ',') AS entry_points, array_to_string(list_sort(coalesce(conf, []))[:20], ',') AS configs, CASE WHEN maven AND NOT contains(root, '/') THEN 'Maven,Spring' WHEN maven THEN 'Maven' ELSE 'npm' END AS tech_stack, services FROM g""")
def project_contexts(spark, sf_dir):
    """What each project's files say about it."""
    files = cut(_project_tree(spark, sf_dir))
    found = projects.contexts(files, cut(projects.roots(files)))
    listed = [F.array_join(c, ",").alias(c) for c in ("modules", "dependencies", "entry_points", "configs", "tech_stack")]
    services = F.coalesce(F.regexp_extract(F.array_join("conventions", ";"), r"\*Service（(\d+) 个", 1).try_cast("long"), F.lit(0).cast("long")).alias("services")
    return found.select("root", "build_system", *listed, services)


# ---- reports and prompts


def changed_texts(spark, sf_dir) -> DataFrame:
    """(key, status, engine, error, old_lines, new_lines) of the changed texts of the documents' two versions."""
    old, new = versions(spark, sf_dir)
    cls = paths.file_class(F.col("key"))
    wanted = compared(spark, sf_dir).where("status <> 'UNCHANGED'").where(paths.is_text_diffable(F.col("file_class"))).select("key", "status")
    side = lambda df, c: df.where(paths.is_text_diffable(cls)).select("key", F.split(beautify.beautified(F.col("text"), cls), "\n").alias(c))
    none = F.array().cast("array<string>")
    rows = wanted.join(side(old, "o"), "key", "left").join(side(new, "n"), "key", "left")
    return rows.select("key", "status", beautify.engine(cls).alias("engine"), F.lit(None).cast("string").alias("error"), F.coalesce("o", none).alias("old_lines"), F.coalesce("n", none).alias("new_lines"))


_ORDER = "CASE status WHEN 'MODIFIED' THEN 0 WHEN 'ADDED' THEN 1 WHEN 'DELETED' THEN 2 ELSE 3 END"
_MARK = "CASE status WHEN 'ADDED' THEN '新增 +' WHEN 'DELETED' THEN '删除 -' ELSE '修改 ~' END"


@query("full_report", f"""WITH {DIFF_SQL}, c AS (SELECT *, {_ORDER} AS rank, {label_sql('file_class')} AS label FROM diff WHERE status <> 'UNCHANGED'),
 s AS (SELECT count(*) FILTER (status = 'ADDED') AS a, count(*) FILTER (status = 'DELETED') AS d, count(*) FILTER (status = 'MODIFIED') AS m, count(*) FILTER (status = 'UNCHANGED') AS u, count(*) FILTER (status <> 'UNCHANGED' AND NOT {LIB_JAR}) AS b, count(*) FILTER (status <> 'UNCHANGED' AND {LIB_JAR}) AS j FROM diff),
 t AS (SELECT label, count(*) FILTER (status = 'ADDED') AS a, count(*) FILTER (status = 'DELETED') AS d, count(*) FILTER (status = 'MODIFIED') AS m FROM c GROUP BY label),
 x AS (SELECT 0 AS p, 0 AS a, '' AS b, unnest(['# 差异分析报告（Java 端口 / 真实包比对）', '', '- 老包：`old`（版本 N/A）', '- 新包：`new`（版本 N/A）', '', '## 一、差异统计']) AS line, unnest(range(0, 6)) AS k
  UNION ALL SELECT 1, 0, '', unnest([concat('- 新增 **', a, '** · 删除 **', d, '** · 修改 **', m, '** · 未变 ', u), concat('- 业务/类级变更(非jar)：', b, ' · jar 级变更：', j), '', '### 按文件类型分布', '| 文件类型 | 新增 | 删除 | 修改 |', '|---|---|---|---|']), unnest(range(0, 6)) FROM s
  UNION ALL SELECT 2, 0, label, concat('| ', label, ' | ', a, ' | ', d, ' | ', m, ' |'), 0 FROM t
  UNION ALL SELECT 3, 0, '', unnest([concat('| **合计** | **', a, '** | **', d, '** | **', m, '** |'), '', '## 二、差异文件树（全量清单）']), unnest(range(0, 3)) FROM s
  UNION ALL SELECT 4, rank, key, concat('- `', {_MARK}, '` ', key), 0 FROM c
  UNION ALL SELECT 5, 0, '', unnest(['', '## 三、反编译源码级差异（Top-12 修改/新增/删除 Java 类）', '> 共 0 个类已反编译（本处仅展示前 Top-K 条，且每条仅列变更行）。', '', '## 四、文本类文件内容差异（Top-12 修改/新增/删除 配置文件/JSP/JS/HTML/CSS）', '- 无文本类文件（配置文件/JSP/前端源码）变动。', '',
    '## 五、差异依赖 JAR 内部源码对比（Top-12 内部 class 反编译源码级 diff）', '- 无差异依赖 JAR（本次比对未检出 JAR 级依赖变动）。', '', '## 六、破坏性变更清单（删除类/删除前端资源）']), unnest(range(0, 11))
  UNION ALL SELECT 6, 0, key, concat('- `', key, '`（潜在对外 API / 行为移除，需重点回归）'), 0 FROM c WHERE status = 'DELETED' UNION ALL SELECT 6, 0, '', '- 无删除类。', 0 FROM s WHERE d = 0
  UNION ALL SELECT 7, 0, '', unnest(['', '## 七、审计摘要（基础）', '- 比对时间：t', '- 老包标识：N/A', '- 新包标识：N/A', '- AI 分析：未接入，本报告不含 AI 章节。']), unnest(range(0, 6)))
 SELECT row_number() OVER (ORDER BY p, a, b, k) AS line_no, line FROM x""")
def full_report(spark, sf_dir):
    """The report of a comparison, without the sections that read contents."""
    none = spark.createDataFrame([], "key string, status string, engine string, error string, old_lines array<string>, new_lines array<string>")
    return document.report(compared(spark, sf_dir), none, none, spark.createDataFrame([], "jar string, jar_status string, inner string, status string"), "old", "new", "t")


@query("text_digests", f"""WITH {DIFF_SQL}, c AS (SELECT key, status, {_ORDER} AS rank, old_text, new_text FROM diff WHERE status <> 'UNCHANGED' AND file_class IN {DIFFABLE} AND file_class NOT IN ('JS', 'CSS', 'HTML', 'JSP')),
 l AS (SELECT *, CASE WHEN old_text IS NULL THEN [] ELSE string_split(regexp_replace(old_text, '[ \\t]*\\n|\\r\\n?', chr(10), 'g'), chr(10)) END AS o, CASE WHEN new_text IS NULL THEN [] ELSE string_split(regexp_replace(new_text, '[ \\t]*\\n|\\r\\n?', chr(10), 'g'), chr(10)) END AS n FROM c),
 h AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(o), len(n)) + 1), lambda i: o[i] <> n[i])) - 1, least(len(o), len(n))) AS head FROM l),
 g AS (SELECT *, o[head + 1:] AS od, n[head + 1:] AS nd, CASE WHEN head + 1 = len(o) THEN concat('L', len(o)) ELSE concat('L', head + 1, '-', len(o)) END AS os, CASE WHEN head + 1 = len(n) THEN concat('L', len(n)) ELSE concat('L', head + 1, '-', len(n)) END AS ns FROM h),
 q AS (SELECT key, concat('- [', CASE status WHEN 'MODIFIED' THEN '修改' WHEN 'ADDED' THEN '新增' ELSE '删除' END, '] ', CASE status WHEN 'MODIFIED' THEN concat('老 ', os, ' → 新 ', ns) WHEN 'ADDED' THEN concat('新 ', ns) ELSE concat('老 ', os) END, '：', chr(10),
   array_to_string(list_concat([concat('-   ', CASE WHEN length(z) > 120 THEN concat(substr(z, 1, 120), '…') ELSE z END) FOR z IN od[:40]], CASE WHEN len(od) > 40 THEN [concat('    … 老侧其余 ', len(od) - 40, ' 行省略')] ELSE [] END,
    [concat('+   ', CASE WHEN length(z) > 120 THEN concat(substr(z, 1, 120), '…') ELSE z END) FOR z IN nd[:40]], CASE WHEN len(nd) > 40 THEN [concat('    … 新侧其余 ', len(nd) - 40, ' 行省略')] ELSE [] END), chr(10))) AS digest FROM g)
 SELECT key, md5(regexp_replace(digest, '^[ \\n\\t]+|[ \\n\\t]+$', '', 'g')) AS digest FROM q""")
def text_digests(spark, sf_dir):
    """What a digest shows of every changed configuration text; edits touch the last line only."""
    own = changed_texts(spark, sf_dir).where(paths.file_class(F.col("key")) == "CONFIG")
    return document.digests(cut(own)).select("key", F.md5("digest").alias("digest"))


@query("overview_prompt")
def overview_prompt(spark, sf_dir):
    """The prompt that gives an overview of the documents' changes."""
    units = cut(changed_texts(spark, sf_dir))
    return document.overview_prompt(compared(spark, sf_dir), lines.lcs_diff(units, "key", "old_lines", "new_lines"))


@query("close_prompts")
def close_prompts(spark, sf_dir):
    """The prompts that read the first changed texts closely."""
    return document.close_prompts(cut(changed_texts(spark, sf_dir)))


_SHOWN_SIZE = "CASE WHEN {0} < 1024 THEN concat({0}, ' B') WHEN {0} < 1048576 THEN concat(printf('%.1f', floor({0} * 10 / 1024.0 + 0.5) / 10), ' KB') ELSE concat(printf('%.1f', floor({0} * 10 / 1048576.0 + 0.5) / 10), ' MB') END"
_SHOWN_TIME = "strftime(make_timestamp({0} * 1000000), '%Y-%m-%d %H:%M:%S.000')"


@query("folder_tree_lines", f"""WITH {_FOLDER}, e AS (SELECT path, 1 AS leaf, CASE WHEN NOT in_new THEN '<' WHEN NOT in_old THEN '>' WHEN o <> n OR touched THEN '*' ELSE '=' END AS mark, strlen(o) <> strlen(n) AS sized, touched, o <> n AS content, strlen(o) AS l, strlen(n) AS r, CAST(regexp_extract(path, '(\\d+)\\.txt$', 1) AS BIGINT) + 1600000000 AS t FROM f WHERE in_old OR in_new),
 x AS (SELECT path, bool_or(in_old) AS in_old, bool_or(in_new) AS in_new FROM d WHERE in_old OR in_new GROUP BY path),
 below AS (SELECT DISTINCT x.path FROM x JOIN e ON e.path LIKE concat(x.path, '/%') WHERE e.mark <> '=' UNION SELECT DISTINCT x.path FROM x JOIN x y ON y.path LIKE concat(x.path, '/%') WHERE NOT (y.in_old AND y.in_new)),
 rows AS (SELECT path, concat('- [', mark, '] ', regexp_extract(path, '[^/]*$'), CASE WHEN mark = '*' THEN concat(' [', array_to_string(list_filter([CASE WHEN sized THEN concat('大小 ', {_SHOWN_SIZE.format('l')}, '→', {_SHOWN_SIZE.format('r')}) END,
    CASE WHEN touched THEN concat('修改时间 ', {_SHOWN_TIME.format('t')}, '→', {_SHOWN_TIME.format('(t + 60)')}) END, CASE WHEN content THEN '内容不同' END], lambda z: z IS NOT NULL), ', '), ']') ELSE '' END) AS line, 1 AS leaf FROM e
  UNION ALL SELECT x.path, concat('- [', CASE WHEN NOT in_new THEN '<' WHEN NOT in_old THEN '>' WHEN below.path IS NOT NULL THEN '*' ELSE '=' END, '] ', regexp_extract(x.path, '[^/]*$'), '/', CASE WHEN in_old AND in_new AND below.path IS NOT NULL THEN ' (子树含差异)' ELSE '' END), 0 FROM x LEFT JOIN below ON x.path = below.path)
 SELECT row_number() OVER (ORDER BY array_to_string([concat(CASE WHEN i < len(string_split(path, '/')) OR leaf = 0 THEN '0' ELSE '1' END, string_split(path, '/')[i]) FOR i IN range(1, len(string_split(path, '/')) + 1)], chr(1))) AS line_no, concat(repeat('  ', (len(string_split(path, '/')) - 1)::INT), line) AS line FROM rows""")
def folder_tree_lines(spark, sf_dir):
    """The tree of a folder report over files that tasks have written, with marks and what changed."""
    return document.assembled([report.folder_tree(diff.folder_diff(*two_folders(spark, sf_dir)))])


@query("cost_modes")
def cost_modes(spark, sf_dir):
    """What each kind of call would send, in tokens, and whether that has to be confirmed."""
    return document.costs(overview_prompt(spark, sf_dir), close_prompts(spark, sf_dir))


# ---- names and tokens


_MANIFEST = "concat('Manifest-Version: 1.0', chr(10), 'Bundle-Version: 2.', doc_id % 5, CASE WHEN doc_id % 2 = 0 THEN '.1' ELSE '' END, chr(13), chr(10), ' Version: 9.9.9.9', chr(10), 'Implementation-Version:3.', doc_id % 7, chr(10))"
_PROPERTIES = "concat('#x', chr(10), 'groupId=g', chr(10), 'version=1.2.', doc_id % 3, CASE WHEN doc_id % 4 = 0 THEN '.4' ELSE '' END, chr(10))"


@query("package_versions", f"""SELECT concat('p', doc_id) AS snapshot_id, CASE WHEN doc_id % 3 = 0 THEN concat('1.2.', doc_id % 3, CASE WHEN doc_id % 4 = 0 THEN '.4' ELSE '' END) WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN concat('2.', doc_id % 5, '.1') ELSE concat('2.', doc_id % 5) END
  WHEN doc_id % 4 = 0 THEN concat('1.2.', doc_id % 3, '.4') WHEN doc_id % 2 = 0 THEN concat('2.', doc_id % 5, '.1') ELSE concat('1.2.', doc_id % 3) END AS version FROM documents WHERE doc_id IS NOT NULL""")
def package_versions(spark, sf_dir):
    """Versions of packages from manifests, build files, or the better of both."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    name = "concat('p', doc_id) AS snapshot_id"
    return archives.package_versions(docs.where("doc_id % 3 <> 0").selectExpr(name, "'META-INF/MANIFEST.MF' AS key", f"{_MANIFEST} AS text")
                                     .unionByName(docs.where("doc_id % 3 <> 1").selectExpr(name, "'META-INF/maven/g/a/pom.properties' AS key", f"{_PROPERTIES} AS text")).unionByName(docs.selectExpr(name, "'META-INF/other' AS key", "'version=9.9.9.9.9' AS text")))




@query("rename_lookup", f"""WITH m AS (SELECT CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN concat('core-036M059(20260101-0900)/src/doc', doc_id, '.js') WHEN 1 THEN concat('pkg/bundle_', coalesce(source, 'none'), '-1.2.zip!/doc', doc_id, '.txt') ELSE concat('plain/doc', doc_id, '.xml') END AS o,
  CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN concat('core-036M061(20260707-1135)/src/doc', doc_id, '.js') WHEN 1 THEN concat('pkg/bundle_', coalesce(source, 'none'), '-1.3.zip!/doc', doc_id, '.txt') ELSE concat('plain/doc', doc_id, '.xml') END AS n, doc_id FROM documents WHERE doc_id IS NOT NULL)
 SELECT doc_id, o AS asked, CASE WHEN doc_id % 3 < 2 THEN n END AS new_key, NULL AS old_key FROM m UNION ALL SELECT doc_id, n, NULL, o FROM m WHERE doc_id % 3 < 2""")
def rename_lookup(spark, sf_dir):
    """Keys of either version by the names of the other: where a key has gone, and where it came from."""
    from .compare import _NEW_NAME, _OLD_NAME

    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    asked = docs.selectExpr("doc_id", f"{_OLD_NAME} AS asked").unionByName(docs.where("doc_id % 3 < 2").selectExpr("doc_id", f"{_NEW_NAME} AS asked"))
    return align.looked_up(cut(renamed(spark, sf_dir)), asked, "asked").select("doc_id", "asked", "new_key", "old_key")


@query("impact_targets", """SELECT doc_id, concat('com.p', doc_id % 7, '.D', doc_id) AS target FROM documents WHERE doc_id IS NOT NULL AND doc_id % 4 <> 1""")
def impact_targets(spark, sf_dir):
    """Changed classes without those that are only new."""
    name = F.concat(F.lit("com.p"), F.col("doc_id") % 7, F.lit(".D"), "doc_id")
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", name.alias("target"))
    return impact.without_added(docs, docs.where("doc_id % 4 = 1").select(F.col("target").alias("fqn")).distinct()).select("doc_id", "target")


_LINE = f"CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN concat('// ', t) WHEN 1 THEN concat('s = \"', t) WHEN 2 THEN concat('/* a */ ', t) WHEN 3 THEN concat('x(\"//\") + ', t) ELSE t END"


@query("token_kinds", f"""WITH l AS (SELECT doc_id, substr(replace(replace(replace(replace(replace({TEXT}, chr(10), ' '), '"', ''), '''', ''), '`', ''), '/', ''), 1, 200) AS t FROM documents WHERE doc_id IS NOT NULL), x AS (SELECT doc_id, t, {_LINE} AS l FROM l), c AS (SELECT *, (doc_id * 7 % 90)::INT AS k, length(l) AS n, length(l) - length(t) AS lead FROM x),
 k AS (SELECT *, substr(l, k + 1, 1) AS ch, concat(regexp_extract(substr(l, 1, k), '[\\w$]*$'), regexp_extract(substr(l, k + 1), '^[\\w$]*')) AS word FROM c)
 SELECT doc_id, CASE WHEN n = 0 THEN 'blank' WHEN k >= n THEN 'eol' WHEN doc_id % 5 = 0 THEN 'comment' WHEN doc_id % 5 = 1 AND k >= 4 THEN 'string' WHEN doc_id % 5 = 2 AND k < 6 THEN 'comment' WHEN doc_id % 5 = 2 AND k = 6 THEN 'op' WHEN doc_id % 5 = 3 AND k BETWEEN 2 AND 4 THEN 'string'
  WHEN regexp_matches(ch, '^\\s$') THEN 'ws' WHEN regexp_matches(ch, '^[0-9]$') OR ch = '.' AND regexp_matches(substr(l, k + 2, 1), '^[0-9]$') THEN 'number' WHEN regexp_matches(ch, '^[A-Za-z_$]$') THEN CASE WHEN word IN {lexer.KEYWORDS} THEN 'keyword' ELSE 'ident' END
  WHEN regexp_matches(ch, '^[-+*/%=!<>&|^~?:.,;()\\[\\]{{}}@$#\\\\]$') THEN 'op' ELSE 'other' END AS kind FROM k""".replace("WHEN doc_id % 5 = 2 AND k < 6 THEN 'comment' WHEN doc_id % 5 = 2 AND k = 6 THEN 'op'", "WHEN doc_id % 5 = 2 AND k < 5 THEN 'comment' WHEN doc_id % 5 = 2 AND k IN (5, 6) THEN 'op'"))
def token_kinds(spark, sf_dir):
    """What stands at a column of a line of each document: behind a comment's mark, in a string, after either, or in plain text."""
    plain = f"""substring(replace(replace(replace(replace(replace({TEXT}, '\\n', ' '), '"', ''), "'", ''), '`', ''), '/', ''), 1, 200)"""
    own = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").selectExpr("doc_id", f"{plain} AS t").selectExpr("doc_id", f"{_LINE} AS l")
    return own.select("doc_id", lexer.token_at(F.col("l"), (F.col("doc_id") * 7 % 90).cast("int")).alias("kind"))


# ---- lines by rules, and inside lines


@query("rule_diff", f"""WITH l AS (SELECT doc_id, len(string_split({TEXT}, chr(10))) AS n FROM documents WHERE doc_id IS NOT NULL)
 SELECT doc_id, n - (doc_id % 5 = 0)::INT AS same, (doc_id % 5 = 0)::INT AS deleted, (doc_id % 5 = 0)::INT AS added FROM l""")
def rule_diff(spark, sf_dir):
    """Differences of lines that are compared without their blanks: new indentation is none, a changed last line is."""
    own = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").selectExpr("doc_id", f"split({TEXT}, '\\n') AS old")
    moved = F.transform("old", lambda x, i: F.concat(F.lit("   "), x, F.lit(" "), F.when((F.col("doc_id") % 5 == 0) & (i == F.size("old") - 1), "x").otherwise("")))
    plain = lambda c: F.transform(c, lambda x: text.rule_normalized(x, True, False, ""))
    rows = own.withColumn("new", moved).withColumns({"o": plain("old"), "n": plain("new")})
    ops = lines.lcs_diff(rows, "doc_id", "old", "new", "o", "n").groupBy("doc_id")
    return ops.agg(*[F.count_if(F.col("op") == op).alias(name) for op, name in (("ctx", "same"), ("del", "deleted"), ("add", "added"))])


@query("inline_characters", f"""WITH l AS (SELECT doc_id, unnest(string_split({TEXT}, chr(10))) AS l, unnest(range(1, len(string_split({TEXT}, chr(10))) + 1)) AS line_no FROM documents WHERE doc_id IS NOT NULL),
 c AS (SELECT doc_id, line_no, length(l) AS n, length(l) - length(replace(l, 'a', '')) AS k FROM l WHERE contains(l, 'a'))
 SELECT doc_id, line_no, n - k AS same, k AS deleted, k AS added FROM c""")
def inline_characters(spark, sf_dir):
    """Characters that are the same, deleted and added in lines of which one letter has become another."""
    own = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").selectExpr("doc_id", f"posexplode(split({TEXT}, '\\n')) AS (at, l)").where("contains(l, 'a')")
    pieces = own.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), lines.inline(F.col("l"), F.replace("l", F.lit("a"), F.lit("e"))).alias("s"))
    size = lambda kind: F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.when(x["t"] == kind, F.length(x["s"])).otherwise(0))
    return pieces.select("doc_id", "line_no", size("eq").alias("same"), size("del").alias("deleted"), size("add").alias("added"))
