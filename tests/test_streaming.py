from pyspark.sql import functions as F

from driftline.sources.tables import snapshot
from driftline.streaming.changes import changes


def test_changes_as_they_come(spark, tmp_path):
    known = snapshot(spark.createDataFrame([("a", "1"), ("b", "2"), ("z", "9")], "key string, text string"), F.col("key"), F.col("text"))
    for n, rows in enumerate(([("a", "1"), ("b", "x")], [("c", "3"), ("b", "2"), ("n", None)])):
        spark.createDataFrame(rows, "key string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = changes(stream, known).writeStream.format("memory").queryName("changed").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = sorted((r.key, r.status) for r in spark.table("changed").collect())
    assert got == [("a", "UNCHANGED"), ("b", "MODIFIED"), ("b", "UNCHANGED"), ("c", "ADDED"), ("n", "ADDED")]
