"""A stream of files gives the levels that the batch gives, for windows that the watermark has passed."""

from pyspark.sql import functions as F

from nocturne.streaming import window_levels


def test_levels(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 2).alias("rec"), F.timestamp_seconds(F.col("id")).alias("ts"), F.when(F.col("id") % 50 == 7, float("nan")).otherwise(F.col("id") * 1.0).alias("x"))
    source = str(tmp_path / "in")
    for i in range(3):
        rows.where(F.floor(F.unix_seconds("ts") / 100) == i).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = window_levels(stream, "ts", ["rec"], "x").writeStream.format("memory").queryName("levels").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    got = {(r.rec, r.start): (r.n, r.missing, r.mean, r.highest) for r in spark.table("levels").collect()}
    batch = {(r.rec, r.start): (r.n, r.missing, r.mean, r.highest) for r in window_levels(rows, "ts", ["rec"], "x").collect()}
    assert len(got) >= 10 and all(batch[k] == v for k, v in got.items())
