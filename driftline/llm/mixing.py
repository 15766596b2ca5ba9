"""Mixing sources to target weights by Efraimidis-Spirakis sampling (native DataFrame operations only).

Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share all words; a target stops at MOST times its
source's words and the excess is reshared by weight until none is above. A source first gives as many complete epochs as its
target holds; what is left is taken from its documents in the order of the exponential keys  -ln(u) / quality weight,  where u
comes from a hash of seed, doc_id, text and an ordinal among equal rows, so reruns agree and equal rows, even a third of all, go
their own ways. Their words are prefix-summed up to the budget; the document across it is taken in part. A document's quality
weight can be any column over 0, such as a classifier's score; without one it is the share of its characters that are no symbols.

The order is never made in one task: keys are cut into ranges of about RANGE documents, the ranges' words are summed, prefix-summed
inside runs of RUN ranges and over the runs, and only documents of one range are ordered together. Ranges come from counts: a
source's keys are counted in BINS bins for each doubling of the key, and a bin is cut evenly into as many ranges as its count
calls for. Keys of whatever weights are a mixture of exponentials, whose density hardly changes over a hundredth of a key, so the
ranges of a bin are alike for any weights. Equal rows are counted first, then numbered in runs that are dealt over tasks. Only
sources, one small row each, are ranked as a whole.

Defined results: null and empty texts have no words and are taken for none; null is a source of its own; equal rows can be taken
differently but their multiset is the same; an empty table gives no rows; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, materialize, numbered

MOST = 3
RANGE = 500
RUN = 1000
BINS = 64
SEED = "mix-1"


def source_targets(sized: DataFrame) -> DataFrame:
    """(mix_source, source_size, target, epochs, budget) by source from rows with (mix_source, mix_size)."""
    by = sized.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"))
    order = W.orderBy(F.col("mix_source").asc_nulls_last())
    weighed = by.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
    # Sources fill up in the order of size by weight: whoever would get more than MOST sizes from what is left stops there.
    fill = W.orderBy((F.col("source_size").cast("double") / F.col("weight")).asc(), F.col("mix_source").asc_nulls_last())
    upto = fill.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    total = F.sum("source_size").over(whole)
    ranked = weighed.select(
        "*", total.alias("total"),
        (total - MOST * F.coalesce(F.sum("source_size").over(upto), F.lit(0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0))).alias("left_weight"))
    level = F.col("left").cast("double") / F.col("left_weight")
    # The first source that is not above its stop sets the level for all that follow.
    under = MOST * F.col("source_size") >= F.col("weight") * level
    first = F.max(F.when(under, F.col("left_weight"))).over(whole)
    ranked = ranked.withColumn("stops", F.col("left_weight") > first).withColumn("first_level", F.max(F.when(F.col("left_weight") == first, level)).over(whole))
    target = F.when(F.col("stops"), (MOST * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("first_level"))
    epochs = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.round("target") / F.col("source_size"))).cast("long")
    return (ranked.withColumn("target", target).withColumn("epochs", epochs)
            .withColumn("budget", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
            .select("mix_source", "source_size", "target", "epochs", "budget"))


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weight: Column | None = None, fingerprint: Column | None = None) -> DataFrame:
    """(mix_id, mix_f, mix_source, mix_size, mix_ordinal, mix_key) of each row. weight: a document's quality weight over 0, the share of its characters that are no symbols by default; fingerprint: what tells rows of one id apart, the text's md5 by default."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if weight is None:
        symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
        weight = 1.0 - 0.9 * symbols / F.greatest(F.length(text), F.lit(1))
    rows = docs.select(F.col(id_col).alias("mix_id"), (F.md5(text) if fingerprint is None else fingerprint).alias("mix_f"), F.col(source_col).alias("mix_source"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("mix_size"), weight.cast("double").alias("mix_weight"))
    same = rows.groupBy(*rows.columns).agg(F.count("*").alias("mix_copies"))
    each = numbered(same, "mix_copies", "mix_ordinal")
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("mix_id").cast("string"), F.lit("")), "mix_f", F.col("mix_ordinal").cast("string"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4503599627370496.0
    return each.withColumn("mix_key", -F.log(u) / F.col("mix_weight")).drop("mix_weight")


def ranged(keyed: DataFrame) -> DataFrame:
    """keyed rows with mix_range, which grows with mix_key: its bin's first range, and where in the bin the key lies."""
    bin_ = F.floor(F.log2("mix_key") * BINS).cast("long")
    counts = keyed.groupBy("mix_source", bin_.alias("bin")).agg(F.ceil(F.count("*") / RANGE).alias("cuts"))
    upto = W.partitionBy("mix_source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # a few thousand bins
    bins = counts.select(F.col("mix_source").alias("of_source"), F.col("bin").alias("of_bin"), "cuts", F.coalesce(F.sum("cuts").over(upto), F.lit(0)).alias("first"))
    bins = materialize(bins, "mix-bins")
    low, high = (F.pow(F.lit(2.0), (F.col("bin") + k) / BINS) for k in (0, 1))
    inside = F.least(F.col("cuts") - 1, F.greatest(F.lit(0), F.floor((F.col("mix_key") - low) / (high - low) * F.col("cuts"))))
    return (keyed.withColumn("bin", bin_).join(bins, F.col("mix_source").eqNullSafe(F.col("of_source")) & (F.col("bin") == F.col("of_bin")))
            .withColumn("mix_range", (F.col("first") + inside).cast("long")).drop("bin", "of_source", "of_bin", "cuts", "first"))


def _before(sums: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """sums with `before`, the sum of value over smaller `at`: inside runs of RUN, and over the runs' sums."""
    run = F.floor(F.col(at) / RUN)
    runs = sums.groupBy(*by, run.alias("run")).agg(F.sum(value).alias("run_size"))
    upto = lambda keys, order: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("earlier", F.coalesce(F.sum("run_size").over(upto(by, "run")), F.lit(0))).drop("run_size").withColumnsRenamed({c: f"run_{c}" for c in [*by, "run"]})
    sums = sums.withColumn("run", run).withColumn("inside", F.coalesce(F.sum(value).over(upto([*by, "run"], at)), F.lit(0)))
    same = F.col("run") == F.col("run_run")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"run_{c}"))
    return sums.join(runs, same).withColumn("before", F.col("earlier") + F.col("inside")).drop("run", "inside", "earlier", *[f"run_{c}" for c in [*by, "run"]])


def mix(keyed: DataFrame) -> DataFrame:
    """keyed rows (with_keys, materialised) with source_size, target and taken: the words that the mix takes, repeats counted."""
    targets = materialize(source_targets(keyed.select("mix_source", "mix_size")), "mix-targets").withColumnRenamed("mix_source", "of_source")
    placed = ranged(keyed)
    sums = materialize(placed.groupBy("mix_source", "mix_range").agg(F.sum("mix_size").alias("range_size")), "mix-sums")
    sums = _before(sums, ["mix_source"], "mix_range", "range_size")
    sums = (sums.join(targets, F.col("mix_source").eqNullSafe(F.col("of_source"))).drop("of_source", "range_size")
            .withColumnsRenamed({"mix_source": "of_source", "mix_range": "of_range"}))
    sums = materialize(sums, "mix-ranges")
    inside = W.partitionBy("mix_source", "mix_range").orderBy("mix_key", "mix_id", "mix_size", "mix_ordinal").rowsBetween(W.unboundedPreceding, -1)
    done = F.col("before") + F.coalesce(F.sum("mix_size").over(inside), F.lit(0))
    part = F.least(F.col("mix_size"), F.greatest(F.lit(0), F.col("budget") - done))
    return (placed.join(sums, F.col("mix_source").eqNullSafe(F.col("of_source")) & (F.col("mix_range") == F.col("of_range")))
            .withColumn("taken", F.col("epochs") * F.col("mix_size") + part).drop("of_source", "of_range", "before", "epochs", "budget", "mix_range"))


def mixed_documents(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """The mix as documents: each as often as it is taken, the one across a source's budget if half of it or more is. Rows equal in every column are one row on the way, taken as often as they are together."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    row = F.md5(F.to_json(doc, {"ignoreNullFields": "false"}))
    keyed = materialize(with_keys(docs, weight=weight, fingerprint=row), "mix-keyed")
    copies = F.floor((2 * F.col("taken") + F.col("mix_size")) / (2 * F.col("mix_size"))).cast("long")
    wanted = (mix(keyed).where(F.col("mix_size") > 0).groupBy("mix_id", "mix_f")
              .agg(F.count("*").alias("rows"), F.sum(copies).alias("mix_copies")).where("mix_copies > 0"))
    wanted = materialize(wanted, "mix-wanted")
    own = docs.select(doc.alias("doc"), F.col("doc_id").alias("own_id"), row.alias("own_f"))

    def of(ids: DataFrame) -> DataFrame:
        """ids are as many as documents: sorted and merged at every size."""
        return own.join(ids.hint("merge"), F.col("own_id").eqNullSafe(F.col("mix_id")) & (F.col("own_f") == F.col("mix_f")))

    found, repeated = of(wanted.where("rows = 1")).select("doc", "mix_copies"), wanted.where("rows > 1")
    if not repeated.isEmpty():  # only rows that are there more than once have to meet
        once = own.groupBy("own_id", "own_f").agg(F.first("doc").alias("doc"), F.count("*").alias("n")).where("n > 1").drop("n")
        found = found.union(once.join(repeated, F.col("own_id").eqNullSafe(F.col("mix_id")) & (F.col("own_f") == F.col("mix_f"))).select("doc", "mix_copies"))
    return numbered(found, "mix_copies", "copy").select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    keyed = materialize(with_keys(docs), "mix-keyed")
    return mix(keyed).select(F.col("mix_id").alias("doc_id"), F.col("mix_size").alias("size"), "source_size", "target", "taken")


SQL = rf"""
WITH rows AS (
  SELECT doc_id, source, text, row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) AS ordinal FROM documents
), sized AS (
  SELECT doc_id, source, ordinal, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    -ln((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' || ordinal), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / (1.0::DOUBLE - 0.9::DOUBLE * (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g'))) / greatest(length(coalesce(text, '')), 1)) AS key
  FROM rows
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1) AS weight FROM sized GROUP BY source
), ranked AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER f, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS rest_weight
  FROM sources WINDOW f AS (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), first AS (
  SELECT max(rest_weight) AS w, arg_max(rest::DOUBLE / rest_weight::DOUBLE, rest_weight) AS level FROM ranked WHERE 3 * source_size >= weight * (rest::DOUBLE / rest_weight::DOUBLE)
), targets AS (
  SELECT source, source_size, CASE WHEN rest_weight > w THEN (3 * source_size)::DOUBLE ELSE weight * level END AS target FROM ranked, first
), plans AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(round(target) / source_size)::BIGINT END AS epochs FROM targets
), ordered AS (
  SELECT s.*, p.source_size, p.target, p.epochs, round(p.target)::BIGINT - p.epochs * p.source_size AS budget,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM sized s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, budget - done)))::BIGINT AS taken FROM ordered
"""
