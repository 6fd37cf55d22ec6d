"""Streams give what batches give."""

from pyspark.sql import functions as F

from chronolith.streaming.windows import first_writes, timed, to_folders, windowed


def test_windows_and_repeats(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    points = spark.range(400).select((F.col("id") % 3).cast("string").alias("host"), F.timestamp_add("SECOND", F.col("id") * 30, F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"), F.col("id").cast("double").alias("v"))
    points.unionByName(points.where("v < 50")).write.parquet(source)
    stream = timed(spark.readStream.schema("host string, ts timestamp_ntz, v double").parquet(source), "ts", "10 minutes")
    q = to_folders(windowed(first_writes(stream, ["host", "time"]), "5 minutes", ["host"], F.sum("v").alias("total"), F.count("v").alias("n")), out, str(tmp_path / "check"))
    q.awaitTermination(120)
    got = {(r["host"], r["time"]): (r["total"], r["n"]) for r in spark.read.parquet(out).collect()}
    want = {(r["host"], r["time"]): (r["total"], r["n"]) for r in windowed(points.withColumn("time", F.col("ts").cast("timestamp")).drop("ts"), "5 minutes", ["host"], F.sum("v").alias("total"), F.count("v").alias("n")).collect()}
    # the watermark holds back what could still change
    assert got and got.items() <= want.items() and len(got) >= len(want) - 3 * 4
