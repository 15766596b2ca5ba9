"""Quality rules with adaptive thresholds (native DataFrame operations only).

Every document gets counts (see measure()). Each rule turns them into one integer ratio; lines and words that repeat are divided by
their number and a prior, as one repeated line of three says little. Per language and source the ratios
go into a mergeable quantile sketch: bins that are exact below 1000 and keep three significant digits above (relative error
under 1 %), with one count per bin. Sketches merge by adding counts, so those of a language and of the whole corpus come from
adding up those of its sources. The upper fence of a rule is  q75 + SPREAD * (q75 - q50) + margin  of the sketch of the
document's language and source; a group of fewer than MIN_GROUP documents uses its language's, else the corpus' sketch. The
fences are joined to the documents, which are kept if the fixed floor (base_failed) and all fences let them pass.

Defined results: null and empty texts count no words and fail the floor; null language or source is a group of its own; equal
rows get equal verdicts; an empty table gives no rows; other columns are carried along untouched, and a new column whose name is
taken has underscores in front, as many as it takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BLANKS, WORD, let, materialize, one_column_of, words

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPREAD = 4
MIN_GROUP = 200
#: Rule: (ratio as an SQL expression of the counts, margin over the sketch's fence).
RULES = {
    "symbols": ("1000 * n_symbols div greatest(n_words, 1)", 150),
    "dup_lines": ("1000 * n_dup_lines div (n_lines + 10)", 250),
    "repeats": ("1000 * n_repeat_words div (n_words + 50)", 250),
    "upper": ("1000 * n_upper div greatest(word_chars, 1)", 300),
    "length": ("10 * word_chars div greatest(n_words, 1)", 40),
}


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window which occurs twice or more; w is an array of words."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(pairs, lambda s: F.transform(
            F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])), lambda x: x["i"]))
        spans = let(F.sort_array(again), lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.size(w) - 2)
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default) and, last, `rule_counts`, a struct of what the rules count."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(BLANKS)) != "")
    counts = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    ))
    more = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    whole = F.struct(
        counts.alias("a"), more.alias("b"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        _without(text, SYMBOLS).cast("long").alias("n_symbols"),
        _without(text, UPPER).cast("long").alias("n_upper"),
    )
    flat = let(whole, lambda x: F.struct(
        x["a"]["n_words"].alias("n_words"), x["word_chars"].alias("word_chars"), x["n_symbols"].alias("n_symbols"), x["b"]["n_dup_lines"].alias("n_dup_lines"),
        x["a"]["n_repeat_words"].alias("n_repeat_words"), x["b"]["n_lines"].alias("n_lines"), x["n_upper"].alias("n_upper")))
    own = docs.select(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)], flat.alias("_"))
    return own.toDF(*own.columns[:-1], one_column_of(own, "rule_counts"))


def base_failed(counts: str = "rule_counts") -> Column:
    n, r = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def _ratio(rule: str, counts: str = "rule_counts") -> Column:
    sql = RULES[rule][0]
    for c in ("n_words", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "word_chars"):
        sql = sql.replace(f"{c}", f"{counts}.{c}")
    return F.expr(sql)


def sketch(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Bins of every rule's sketch by language and source: (lang, source, rule, bin, n). Documents under the fixed floor are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _ratio(r).alias("v")) for r in RULES]))
    step = F.pow(F.lit(10), F.length(F.col("e.v").cast("string")) - 3).cast("long")
    bin_ = F.when(F.col("e.v") < 1000, F.col("e.v")).otherwise(F.expr("e.v div 1") - F.col("e.v") % step)
    return (measured.where(~base_failed())
            .select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), each.alias("e"))
            .groupBy("lang", "source", F.col("e.rule").alias("rule"), bin_.alias("bin")).agg(F.count("*").alias("n")))


def fences(bins: DataFrame) -> DataFrame:
    """One row by language and source with the upper fence of each rule, from its own, its language's or the corpus' merged sketch."""

    def quantiles(keys: list[str]) -> DataFrame:
        own = bins.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
        upto = W.partitionBy(*keys, "rule").orderBy("bin")
        own = own.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(W.partitionBy(*keys, "rule")))
        q = own.groupBy(*keys, "rule").agg(
            F.max("total").alias("total"),
            F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("bin"))).alias("q50"),
            F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bin"))).alias("q75"))
        return q.select(*keys, "rule", "total", ((1 + SPREAD) * F.col("q75") - SPREAD * F.col("q50")).alias("fence"))

    own, lang, whole = (quantiles(k).withColumnRenamed("fence", f"fence_{i}").withColumnRenamed("total", f"total_{i}") for i, k in enumerate((["lang", "source"], ["lang"], [])))
    lang = lang.withColumnRenamed("lang", "lang_1").withColumnRenamed("rule", "rule_1")
    merged = (own.join(lang, F.col("lang").eqNullSafe(F.col("lang_1")) & (F.col("rule") == F.col("rule_1")))
              .join(whole, "rule"))
    fence = F.when(F.col("total_0") >= MIN_GROUP, F.col("fence_0")).when(F.col("total_1") >= MIN_GROUP, F.col("fence_1")).otherwise(F.col("fence_2"))
    return merged.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == r, fence + RULES[r][1])).alias(f"fence_{r}") for r in RULES])


def judge(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """measured, its counts last, with base_failed and kept. The fences are written first: their true size decides whether the join broadcasts them."""
    row = F.struct(*[F.col(f"`{c}`") for c in measured.columns])
    own = measured.select(row.alias("row"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{measured.columns[-1]}`").alias("rule_counts"))
    spots = materialize(fences(sketch(own)), "rule-fences")
    spots = spots.withColumnsRenamed({"lang": "fence_lang", "source": "fence_source"})
    joined = own.join(spots, F.col("lang").eqNullSafe(F.col("fence_lang")) & F.col("source").eqNullSafe(F.col("fence_source")), "left")
    passes = ~base_failed()
    for r in RULES:
        passes = passes & (_ratio(r) <= F.coalesce(F.col(f"fence_{r}"), F.lit(0)))
    return joined.select("row.*", base_failed().alias(one_column_of(measured, "base_failed")), passes.alias(one_column_of(measured, "kept")))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, all columns as they were."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("lang").alias("lang"), F.col("source").alias("source"), F.col("text").alias("text"))
    measured = materialize(measure(own, carry=["doc", "lang", "source"]), "rule-counts")
    return judge(measured).where("kept").select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    measured = materialize(measure(docs, carry=["doc_id", "lang", "source"]), "rule-counts")
    judged = judge(measured)
    return judged.select("doc_id", *[f"rule_counts.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


_SPLIT = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"
SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {_SPLIT} AS w FROM documents
), grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1
), reps AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid
), lines AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM base
), counts AS (
  SELECT b.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{{SPACE_}}', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper
  FROM base b JOIN lines USING (rid) LEFT JOIN reps USING (rid)
), flagged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
), ratios AS (
  SELECT rid, lang, source, base_failed, unnest([
    {{'rule': 'symbols', 'v': 1000 * n_symbols // greatest(n_words, 1), 'margin': 150}}, {{'rule': 'dup_lines', 'v': 1000 * n_dup_lines // (n_lines + 10), 'margin': 250}},
    {{'rule': 'repeats', 'v': 1000 * n_repeat_words // (n_words + 50), 'margin': 250}}, {{'rule': 'upper', 'v': 1000 * n_upper // greatest(word_chars, 1), 'margin': 300}},
    {{'rule': 'length', 'v': 10 * word_chars // greatest(n_words, 1), 'margin': 40}}]) AS e FROM flagged
), binned AS (
  SELECT lang, source, e.rule AS rule, e.margin AS margin, CASE WHEN e.v < 1000 THEN e.v ELSE e.v - e.v % (10 ** (length(e.v::VARCHAR) - 3))::BIGINT END AS bin, count(*) AS n
  FROM ratios WHERE NOT base_failed GROUP BY ALL
), q0 AS (
  SELECT lang, source, rule, max(total) AS total, 5 * min(bin) FILTER (4 * upto >= 3 * total) - 4 * min(bin) FILTER (2 * upto >= total) AS fence
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, rule ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, source, rule) AS total FROM binned) GROUP BY ALL
), q1 AS (
  SELECT lang, rule, max(total) AS total, 5 * min(bin) FILTER (4 * upto >= 3 * total) - 4 * min(bin) FILTER (2 * upto >= total) AS fence
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang, rule ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, rule) AS total
        FROM (SELECT lang, rule, bin, sum(n) AS n FROM binned GROUP BY ALL)) GROUP BY ALL
), q2 AS (
  SELECT rule, max(total) AS total, 5 * min(bin) FILTER (4 * upto >= 3 * total) - 4 * min(bin) FILTER (2 * upto >= total) AS fence
  FROM (SELECT *, sum(n) OVER (PARTITION BY rule ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY rule) AS total
        FROM (SELECT rule, bin, sum(n) AS n FROM binned GROUP BY ALL)) GROUP BY ALL
), fence AS (
  SELECT q0.lang, q0.source, q0.rule, CASE WHEN q0.total >= 200 THEN q0.fence WHEN q1.total >= 200 THEN q1.fence ELSE q2.fence END AS fence
  FROM q0 JOIN q1 ON q0.rule = q1.rule AND q0.lang IS NOT DISTINCT FROM q1.lang JOIN q2 ON q0.rule = q2.rule
), bad AS (
  SELECT DISTINCT rid FROM ratios r LEFT JOIN fence f ON f.rule = r.e.rule AND f.lang IS NOT DISTINCT FROM r.lang AND f.source IS NOT DISTINCT FROM r.source
  WHERE r.e.v > coalesce(f.fence + r.e.margin, 0)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM flagged
""".replace("{SPACE_}", r"[\x20\x09-\x0D]+")
