import numpy as np
from pyspark.sql import functions as F

from driftline.operators import quantiles


def test_outliers_leave_ranges_even(spark):
    """One outlier, one infinite value and one that is no number don't bring the others together."""
    for odd in (1e12, float("inf"), float("nan")):
        rows = spark.range(20_000).select(F.lit("a").alias("g"), F.when(F.col("id") == 7, F.lit(odd)).otherwise(F.col("id") * 0.37).alias("v"))
        counts = rows.groupBy("g", "v").agg(F.count("*").alias("c"))
        sizes = [r["count"] for r in quantiles.ranged(counts).groupBy("g", "r").count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 10 * 20_000 / quantiles.RANGES


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    data = {"heavy": rng.pareto(0.4, 3000), "few": rng.integers(0, 5, 4000).astype(float), "one": np.array([3.0]), "two": np.array([1.0, 2.0]), "below": -rng.lognormal(0, 4, 999), "wide": np.array([0.0] * 500 + [1e300, -1e300])}
    rows = spark.createDataFrame([(g, float(v)) for g, x in data.items() for v in x] + [("few", None), (None, 4.0)], "g string, v double")
    shares = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in quantiles.quantiles(rows, "g", "v", shares).collect()}
    assert set(got) == {*data, None} and got[None].p50 == 4.0
    for g, x in data.items():
        assert np.allclose([got[g][n] for n in shares], np.quantile(x, list(shares.values())), rtol=1e-9)


def test_ranges_end_where_they_were_counted_to_end(spark):
    """Sketches of many values merge in another order each time, so the ends of ranges, read twice, are made once: no sketch is left in the plan."""
    rows = spark.range(1000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"), F.lit(1).alias("c"))
    assert "percentile_approx" not in quantiles.ranged(rows)._jdf.queryExecution().toString()
