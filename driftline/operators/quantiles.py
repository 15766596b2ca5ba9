"""Exact quantiles of values too many to keep in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Ranges that the values of a group are cut into, before ranks are looked for inside one of them.
RANGES = 256
#: Cuts of a run.
STEP = 16


def ranged(counts: DataFrame) -> DataFrame:
    """counts (g, v, c) with n, the rows of its group, and r, the range of its value.

    Ranges end at quantiles of the distinct values, from a mergeable sketch, so each has about as many of them wherever the values
    lie; outliers, infinite values and NaN, which is above all others, don't widen any.
    """
    shares = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    cuts = counts.groupBy(F.col("g").alias("of")).agg(F.array_distinct(F.percentile_approx("v", shares, F.lit(40 * RANGES))).alias("cuts"), F.sum("c").alias("n"))
    # A value is looked for among runs of cuts first, then inside one.
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("cuts") - 1) / STEP).cast("int")), lambda i: F.slice("cuts", i * STEP + 1, F.lit(STEP)))
    cuts = cuts.select("of", "n", runs.alias("runs")).select("of", "n", "runs", F.transform("runs", lambda x: F.element_at(x, -1)).alias("ends"))
    cuts = cut(cuts)  # sketches merge in the order in which tasks end, so made twice they would end ranges elsewhere
    below = lambda x: F.size(F.filter(x, lambda y: y < F.col("v")))
    placed = counts.join(cuts, F.col("g").eqNullSafe(F.col("of"))).withColumn("run", below("ends"))
    return placed.select("g", "v", "c", "n", (F.col("run") * STEP + F.coalesce(below(F.get("runs", F.col("run"))), F.lit(0))).alias("r"))


def quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column a share): quantiles of value by group, with linear interpolation between neighbours.

    Equal values are counted once. Counts of a group's ranges are summed up, and values are ordered only inside their range, so
    neither a hot group nor one of many values is in one task.
    """
    counts = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).groupBy("g", "v").agg(F.count("*").alias("c"))
    placed = ranged(counts)
    sums = placed.groupBy("g", "r").agg(F.sum("c").alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("g").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("g").alias("of"), F.col("r").alias("of_r"), before.alias("before"))
    inside = F.coalesce(F.sum("c").over(W.partitionBy("g", "r").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.join(sums, F.col("g").eqNullSafe(F.col("of")) & (F.col("r") == F.col("of_r"))).withColumn("first", F.col("before") + inside)

    def at_rank(k):
        return F.max(F.when((F.col("first") <= k) & (k < F.col("first") + F.col("c")), F.col("v")))

    picks = []
    for name, share in shares.items():
        spot = F.lit(share) * (F.col("n") - 1)
        picks += [at_rank(F.floor(spot)).alias(f"{name}_low"), at_rank(F.ceil(spot)).alias(f"{name}_high"), F.max(spot - F.floor(spot)).alias(f"{name}_part")]
    found = ranked.groupBy("g").agg(*picks)
    return found.select(F.col("g").alias(by), *[(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")).alias(n) for n in shares])
