"""Queries about contents: lines, normal forms, labels, references, budgets and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels, text, versions
from ..model import Options
from ..operators import impact, lines
from ..operators.quantiles import quantiles
from .compare import compared
from .inputs import DIFF_SQL, LINES_TEXT, TEXT, FRONT, table

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


def line_arrays(spark, sf_dir) -> DataFrame:
    """(doc_id, old, new): the lines of two versions of every document."""
    own = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{TEXT} AS a", f"{LINES_TEXT} AS b")
    return own.select("doc_id", F.split("a", "\n").alias("old"), F.split("b", "\n").alias("new"))


_ENDS = f"""l AS (SELECT doc_id, string_split({TEXT}, chr(10)) AS o, string_split({LINES_TEXT}, chr(10)) AS n FROM documents),
 h AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(o), len(n)) + 1), lambda i: o[i] <> n[i])) - 1, least(len(o), len(n))) AS head FROM l),
 e AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(o), len(n)) - head + 1), lambda i: o[len(o) - i + 1] <> n[len(n) - i + 1])) - 1, least(len(o), len(n)) - head) AS tail FROM h),
 d AS (SELECT *, len(o) - head - tail AS dels, len(n) - head - tail AS adds FROM e)"""


@query("line_linear_diff", f"""WITH {_ENDS} SELECT doc_id, 'ctx' AS op, i AS old_no, i AS new_no, md5(o[i]) AS line FROM (SELECT *, unnest(range(1, head + 1)) AS i FROM d)
  UNION ALL SELECT doc_id, 'del', i, NULL, md5(o[i]) FROM (SELECT *, unnest(range(head + 1, head + dels + 1)) AS i FROM d)
  UNION ALL SELECT doc_id, 'add', NULL, i, md5(n[i]) FROM (SELECT *, unnest(range(head + 1, head + adds + 1)) AS i FROM d)
  UNION ALL SELECT doc_id, 'ctx', i, i + len(n) - len(o), md5(o[i]) FROM (SELECT *, unnest(range(len(o) - tail + 1, len(o) + 1)) AS i FROM d)""")
def line_linear_diff(spark, sf_dir):
    rows = lines.linear_diff(line_arrays(spark, sf_dir), "doc_id", "old", "new")
    return rows.select("doc_id", "op", F.col("old_no").cast("long").alias("old_no"), F.col("new_no").cast("long").alias("new_no"), F.md5("text").alias("line"))


_ROWS = f"""{_ENDS}, x AS (SELECT doc_id, 'ctx' AS op, i AS old_no, i AS new_no, o[i] AS text FROM (SELECT *, unnest(range(1, head + 1)) AS i FROM d)
  UNION ALL SELECT doc_id, 'del', i, NULL, o[i] FROM (SELECT *, unnest(range(head + 1, head + dels + 1)) AS i FROM d)
  UNION ALL SELECT doc_id, 'add', NULL, i, n[i] FROM (SELECT *, unnest(range(head + 1, head + adds + 1)) AS i FROM d)
  UNION ALL SELECT doc_id, 'ctx', i, i + len(n) - len(o), o[i] FROM (SELECT *, unnest(range(len(o) - tail + 1, len(o) + 1)) AS i FROM d))"""


@query("find_in_diff", f"WITH {_ROWS} SELECT doc_id, old_no, new_no, CASE op WHEN 'ctx' THEN 'left,right' WHEN 'del' THEN 'left' ELSE 'right' END AS sides FROM x WHERE contains(lower(text), 'on t')")
def find_in_diff(spark, sf_dir):
    """Lines of a difference that hold a text, and the sides they are on."""
    found = lines.search_lines(lines.linear_diff(line_arrays(spark, sf_dir), "doc_id", "old", "new"), "On T")
    return found.select("doc_id", F.col("old_no").cast("long").alias("old_no"), F.col("new_no").cast("long").alias("new_no"), F.array_join("sides", ",").alias("sides"))


@query("group_quotas")
def group_quotas(spark, sf_dir):
    """What each source's documents may say of a prompt: sources in order share what is left evenly, and leave what they don't need."""
    need = F.sum(F.length(F.coalesce("text", F.lit("")))).alias("need")
    groups = table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(need)
    return impact.group_quotas(groups, OPTIONS.total_budget, ["source"], "source", "need")


def blocks(spark, sf_dir, diff=lines.linear_diff) -> DataFrame:
    return lines.change_blocks(diff(line_arrays(spark, sf_dir), "doc_id", "old", "new"), "doc_id")


def folded(spark, sf_dir, diff) -> DataFrame:
    rows, fold = lines.fold_context(diff(line_arrays(spark, sf_dir), "doc_id", "old", "new"), "doc_id"), F.col("op") == "fold"
    return rows.groupBy("doc_id").agg(F.count_if(~fold).alias("shown"), F.count_if(fold).alias("folds"), F.coalesce(F.sum(F.when(fold, F.col("count"))), F.lit(0)).alias("folded"))


@query("change_blocks", f"""WITH {_ENDS} SELECT doc_id, CASE WHEN dels > 0 AND adds > 0 THEN 'MODIFIED' WHEN dels > 0 THEN 'DELETED' ELSE 'ADDED' END AS type,
  CASE WHEN dels > 0 THEN head + 1 ELSE 0 END AS old_start, CASE WHEN dels > 0 THEN head + dels ELSE 0 END AS old_end, CASE WHEN adds > 0 THEN head + 1 ELSE 0 END AS new_start, CASE WHEN adds > 0 THEN head + adds ELSE 0 END AS new_end
  FROM d WHERE dels + adds > 0""")
def change_blocks(spark, sf_dir):
    return blocks(spark, sf_dir).select("doc_id", "type", *[F.col(c).cast("long").alias(c) for c in ("old_start", "old_end", "new_start", "new_end")])


@query("digest_caps", f"WITH {_ENDS} SELECT doc_id, greatest(dels - 40, 0) AS old_omitted, greatest(adds - 40, 0) AS new_omitted FROM d WHERE dels + adds > 0")
def digest_caps(spark, sf_dir):
    return lines.capped_blocks(blocks(spark, sf_dir), "doc_id").select("doc_id", F.col("old_omitted").cast("long").alias("old_omitted"), F.col("new_omitted").cast("long").alias("new_omitted"))


@query("context_fold", f"""WITH {_ENDS}, f AS (SELECT doc_id, dels + adds AS c, head, tail FROM d) SELECT doc_id,
  CASE WHEN c = 0 THEN 0 ELSE c + CASE WHEN head <= 3 THEN head ELSE 0 END + least(tail, 3) END AS shown, CASE WHEN c = 0 THEN 1 ELSE (head > 3)::INT + (tail > 3)::INT END AS folds,
  CASE WHEN c = 0 THEN head + tail ELSE CASE WHEN head > 3 THEN head ELSE 0 END + greatest(tail - 3, 0) END AS folded FROM f""")
def context_fold(spark, sf_dir):
    return folded(spark, sf_dir, lines.linear_diff)


@query("line_lcs_diff")
def line_lcs_diff(spark, sf_dir):
    return lines.lcs_diff(line_arrays(spark, sf_dir), "doc_id", "old", "new")


@query("lcs_change_blocks")
def lcs_change_blocks(spark, sf_dir):
    return blocks(spark, sf_dir, lines.lcs_diff).select("doc_id", "change_no", "type", *[F.col(c).cast("long").alias(c) for c in ("old_start", "old_end", "new_start", "new_end")])


@query("lcs_digest_caps")
def lcs_digest_caps(spark, sf_dir):
    return lines.capped_blocks(blocks(spark, sf_dir, lines.lcs_diff), "doc_id").select("doc_id", "change_no", F.col("old_omitted").cast("long").alias("old_omitted"), F.col("new_omitted").cast("long").alias("new_omitted"))


@query("lcs_context_fold")
def lcs_context_fold(spark, sf_dir):
    return folded(spark, sf_dir, lines.lcs_diff)


@query("aligned_pairs")
def aligned_pairs(spark, sf_dir):
    return lines.aligned(line_arrays(spark, sf_dir), "doc_id", "old", "new")


@query("inline_segments")
def inline_segments(spark, sf_dir):
    rows = aligned_pairs(spark, sf_dir).where("type = 'rep'")
    return rows.select("doc_id", "change_no", "pos", F.to_json(lines.inline(F.col("left"), F.col("right"), "word")).alias("segments"))


_WINDOWS = r"""l AS (SELECT doc_id, unnest(t) AS text, generate_subscripts(t, 1) AS line_no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents)),
 v AS (SELECT doc_id, line_no, array_to_string(k, ' ') AS norm FROM (SELECT *, regexp_extract_all(text, '[A-Za-z0-9_$]+|[^\s]') AS k FROM l) WHERE len(k) > 1 OR (len(k) = 1 AND regexp_matches(k[1], '^[A-Za-z0-9_$]'))),
 w AS (SELECT doc_id, row_number() OVER o AS n, line_no, md5(string_agg(norm, chr(10)) OVER f) AS h, max(line_no) OVER f AS stop, count(*) OVER f AS k FROM v
  WINDOW o AS (PARTITION BY doc_id ORDER BY line_no), f AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
 r AS (SELECT doc_id, h, min(n) AS n, min(line_no) AS first, max(stop) AS last, max(n) - min(n) + 10 AS size FROM (SELECT *, n - row_number() OVER (PARTITION BY doc_id, h ORDER BY n) AS g FROM w WHERE k = 10) GROUP BY doc_id, h, g)"""


def text_lines(spark, sf_dir) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))
    return own.withColumn("line_no", F.col("line_no") + 1)


@query("duplicate_blocks", f"""WITH {_WINDOWS}, t AS (SELECT h, count(*) AS places FROM r GROUP BY h HAVING count(*) > 1),
 s AS (SELECT * FROM r JOIN t USING (h)),
 x AS (SELECT a.h AS h, b.h AS after, count(*) AS times FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.n = a.n + a.size - 9 GROUP BY 1, 2),
 y AS (SELECT x.after AS h FROM x JOIN t p ON p.h = x.h JOIN t q ON q.h = x.after WHERE times = p.places AND times = q.places),
 z AS (SELECT *, sum((h NOT IN (SELECT h FROM y))::INT) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM s)
 SELECT doc_id, arg_min(h, n) AS passage, min(first)::INTEGER AS first, max(last)::INTEGER AS last, (max(n + size) - min(n))::BIGINT AS size, max(places) AS places FROM z GROUP BY doc_id, g""")
def duplicate_blocks(spark, sf_dir):
    return lines.duplicate_windows(text_lines(spark, sf_dir), "doc_id")


@query("duplicate_total", f"""WITH {_WINDOWS} SELECT count(*) AS blocks, coalesce(sum(least(a.size, b.size)), 0)::BIGINT AS total FROM r a JOIN r b ON a.h = b.h AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.n < b.n))""")
def duplicate_total(spark, sf_dir):
    return lines.duplicate_total(text_lines(spark, sf_dir), "doc_id")


_SPLIT = "replace(regexp_replace(html, '[ \\t]*\\n|\\r\\n?', chr(10), 'g'), '><', concat('>', chr(10), '<'))"


@query("html_split", f"""SELECT page_id, md5({_SPLIT}) AS pretty, html <> '' AND list_max(list_transform(string_split(html, chr(10)), lambda x: length(x))) > 400
  AND (len(string_split(html, chr(10))) < 6 OR length(html) / len(string_split(html, chr(10))) > 200) AS minified FROM pages""")
def html_split(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_split(h)).alias("pretty"), text.looks_minified(h).alias("minified"))


@query("short_hash", "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN '0000000' ELSE substr(sha1(text), 1, 7) END AS short_hash FROM documents")
def short_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.short_hash(F.col("text")).alias("short_hash"))


@query("redact_log", r"""SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(text, '(bearer\s+)([A-Za-z0-9._~+/\-]+=*)', '\1<redacted>', 'gi'),
  '((?:api[_-]?key|apikey|authorization|token|bearer|secret|password)\s*[:=]\s*)(\S+)', '\1<redacted>', 'gi'), 'sk-[A-Za-z0-9_\-]{8,}', 'sk-<redacted>', 'g')) AS redacted FROM conversations""")
def redact_log(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.redact_log(F.col("text"))).alias("redacted"))


@query("redact_prompt")
def redact_prompt(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.redact_prompt(F.col("text")).alias("redacted"))


@query("cost_gate", "SELECT coalesce(source, 'none') AS source, sum(length(coalesce(text, ''))) / 2.0 AS tokens, sum(length(coalesce(text, ''))) / 2.0 > 8000 AS over FROM documents GROUP BY 1")
def cost_gate(spark, sf_dir):
    t = F.sum(text.token_estimate(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(t.alias("tokens"), (t > 8000).alias("over"))


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(lower(key), '{w}')" for w in words) + ")"


@query("smart_classify", f"""WITH {DIFF_SQL} SELECT key, CASE WHEN file_class = 'CONFIG' OR file_class IN {FRONT} THEN 'LOW' WHEN {_has(labels.HIGH_RISK)} THEN 'HIGH' ELSE 'MEDIUM' END AS risk,
  CASE {' '.join(f"WHEN file_class = '{c}' THEN '{v}'" for c, v in labels.BY_CLASS)} {' '.join(f"WHEN {_has(w)} THEN '{v}'" for v, w, _ in labels.BY_WORD)} ELSE '业务代码' END AS category,
  concat(CASE status WHEN 'ADDED' THEN '新增' WHEN 'DELETED' THEN '删除' ELSE '修改' END, CASE WHEN file_class = 'CONFIG' THEN '{labels.REASONS["config"]}' WHEN file_class IN {FRONT} THEN '{labels.REASONS["frontend"]}' ELSE '{labels.REASONS["other"]}' END) AS reason
  FROM diff WHERE status <> 'UNCHANGED'""")
def smart_classify(spark, sf_dir):
    k, c = F.col("key"), F.col("file_class")
    return compared(spark, sf_dir).where("status <> 'UNCHANGED'").select("key", labels.heuristic_risk(k, c).alias("risk"), labels.heuristic_category(k, c).alias("category"), labels.reason(c, F.col("status")).alias("reason"))


@query("api_changes", """SELECT concat('com.P', p_partkey) AS cls, unnest(CASE WHEN p_partkey % 5 = 0 THEN ['SIGNATURE_CHANGED'] WHEN p_partkey % 7 = 0 THEN ['REMOVED_API', 'ADDED_API'] ELSE [] END) AS level,
  unnest(CASE WHEN p_partkey % 5 = 0 THEN [concat('run(', p_size, '):void → run(', p_size + 1, '):void')] WHEN p_partkey % 7 = 0 THEN [concat('run(', p_size, '):void'), 'go():int'] ELSE [] END) AS api FROM part""")
def api_changes(spark, sf_dir):
    parts, i, size = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    run = lambda n: F.concat(F.lit("run("), n, F.lit("):void"))
    side = lambda api: parts.select(F.concat(F.lit("com.P"), i).alias("cls"), api.alias("api"), i.alias("ordinal"))
    return impact.api_changes(side(run(size)), side(F.when(i % 5 == 0, run(size + 1)).when(i % 7 == 0, "go():int").otherwise(run(size))))


_SOURCES = """s AS (SELECT concat('s', doc_id) AS key, concat('com.x.Doc', doc_id) AS fqn, CASE WHEN doc_id % 2 = 0 THEN 'com.x' ELSE 'com.y' END AS pkg, concat('com.x.Doc', doc_id % 50) AS imported,
  concat(coalesce(text, ''), ' Doc', (doc_id * 7) % 97, ' com.x.Doc', doc_id % 31) AS text FROM documents),
 t AS (SELECT concat('com.x.Doc', k) AS target, concat('Doc', k) AS word, k FROM (SELECT DISTINCT doc_id AS k FROM documents WHERE doc_id IS NOT NULL)),
 w AS (SELECT s.*, unnest(list_distinct(regexp_extract_all(text, '\\w+'))) AS word FROM s),
 r AS (SELECT DISTINCT target, w.key AS source_key FROM w JOIN t ON w.word = t.word WHERE target <> fqn AND (pkg = 'com.x' OR imported = target OR contains(w.text, target)))"""


@query("impact_risk", f"""WITH {_SOURCES} SELECT t.target, CASE WHEN k % 3 = 0 THEN 'DELETED' ELSE 'MODIFIED' END AS status, count(source_key) AS n_refs,
  CASE WHEN count(source_key) = 0 THEN 'LOW' WHEN k % 3 = 0 THEN 'CRITICAL' WHEN k % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM t LEFT JOIN r ON t.target = r.target GROUP BY t.target, k""")
def impact_risk(spark, sf_dir):
    i = F.col("doc_id")
    name = lambda n: F.concat(F.lit("com.x.Doc"), n)
    sources = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s"), i).alias("key"), name(i).alias("fqn"), F.when(i % 2 == 0, "com.x").otherwise("com.y").alias("pkg"), F.array(name(i % 50)).alias("imports"),
        F.concat(F.coalesce("text", F.lit("")), F.lit(" Doc"), (i * 7) % 97, F.lit(" com.x.Doc"), i % 31).alias("text"))
    targets = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(i).distinct().select(name(i).alias("target"), (i % 3 == 0).alias("deleted"), (i % 2 == 0).alias("signature_changed"))
    return impact.impact(targets, impact.references(sources, targets)).select("target", "status", "n_refs", "risk")


@query("project_lookup", """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
 x AS (SELECT DISTINCT unnest([split_part(path, '/', 1), concat(split_part(path, '/', 1), '/', split_part(path, '/', 2))]) AS prefix FROM p)
 SELECT page_id, coalesce(max_by(prefix, length(prefix)), 'root') AS project FROM p LEFT JOIN x ON starts_with(path, concat(prefix, '/')) GROUP BY page_id""")
def project_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    parts = F.split("path", "/")
    prefixes = rows.select(F.explode(F.array(F.get(parts, 0), F.concat_ws("/", F.get(parts, 0), F.coalesce(F.get(parts, 1), F.lit(""))))).alias("prefix")).distinct().withColumn("project", F.col("prefix"))
    return impact.longest_prefix(rows, prefixes, "path", "prefix", "project", "root").select("page_id", "project")


@query("prompt_budget", f"""WITH {DIFF_SQL}, c AS (SELECT key, CASE status WHEN 'MODIFIED' THEN 0 WHEN 'ADDED' THEN 1 ELSE 2 END AS rank, coalesce(new_size, old_size) AS size FROM diff WHERE status <> 'UNCHANGED'),
 u AS (SELECT *, {OPTIONS.total_budget} - coalesce(sum(least(size, {OPTIONS.file_budget})) OVER (ORDER BY rank, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM c)
 SELECT key, least(size, {OPTIONS.file_budget}, rest)::BIGINT AS given FROM u WHERE size > 0 AND rest >= {OPTIONS.least_budget}""")
def prompt_budget(spark, sf_dir):
    """What each changed entry may say. Whoever says anything takes one character or more, so only the first total_budget entries can; these alone are ordered together."""
    rows = compared(spark, sf_dir).where("status <> 'UNCHANGED'").select("key", labels.status_rank(F.col("status")).alias("rank"), F.coalesce("new_size", "old_size").alias("size")).where("size > 0")
    first = rows.orderBy("rank", "key").limit(OPTIONS.total_budget)
    return impact.running_budget(first, [], ["rank", "key"], F.col("size"), OPTIONS.file_budget, OPTIONS.total_budget, OPTIONS.least_budget).where("given > 0").select("key", "given")


@query("latency_percentiles", """SELECT event_type AS label, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99,
  min(value) AS least, max(value) AS most, round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 4) AS error_rate, round(count(*) * 1000000.0 / (epoch_us(max(ts)) - epoch_us(min(ts))), 6) AS per_second
  FROM events GROUP BY ROLLUP (event_type)""")
def latency_percentiles(spark, sf_dir):
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), "value", "ts", (F.col("event_type") == "error").alias("failed"))
    # A row counts under its label and under all of them.
    each = rows.withColumn("group", F.explode(F.array(F.struct(F.lit(False).alias("all"), "label"), F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("label")))))
    sums = each.groupBy("group").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(100.0 * F.count_if("failed") / F.count("*"), 4).alias("error_rate"),
                                     F.round(F.count("*") * 1000000.0 / (micros(F.max("ts")) - micros(F.min("ts"))), 6).alias("per_second")).withColumnRenamed("group", "of")
    found = quantiles(each, "group", "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    return sums.join(found, F.col("group") == F.col("of"), "left").select(F.col("of.label").alias("label"), "n", *[F.round(p, 4).alias(p) for p in ("p50", "p90", "p95", "p99")], "least", "most", "error_rate", "per_second")


@query("column_search", "SELECT 'c_name' AS col, count(*) AS hits FROM customer WHERE contains(lower(c_name), '12') HAVING count(*) > 0 UNION ALL SELECT 'c_mktsegment', count(*) FROM customer WHERE contains(lower(c_mktsegment), '12') HAVING count(*) > 0")
def column_search(spark, sf_dir):
    """Text columns that hold a text, and in how many rows."""
    rows = table(spark, sf_dir, "customer")
    names = [c for c, t in rows.dtypes if t == "string"]
    return rows.select(*names).unpivot([], names, "col", "value").where(F.contains(F.lower("value"), F.lit("12"))).groupBy("col").agg(F.count("*").alias("hits"))


@query("version_compare", "SELECT p_partkey, sign(p_size - p_partkey % 10)::INTEGER AS order_of FROM part")
def version_compare(spark, sf_dir):
    v = lambda c: F.concat(F.lit("1."), c, F.lit("-rc"))
    return table(spark, sf_dir, "part").select("p_partkey", versions.compare(v(F.col("p_size")), v(F.col("p_partkey") % 10)).alias("order_of"))
