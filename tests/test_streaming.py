"""Windows on batch and stream give the same."""

from pyspark.sql import functions as F

from tributary.streaming.windows import gap_filled, sessions, tumbling


def test_tumbling_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    count = [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v")]
    query = tumbling(stream, "ts", "1 hour", ["event_type"], count, "1 day").writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    query.processAllAvailable()
    query.stop()
    want = tumbling(events, "ts", "1 hour", ["event_type"], count)
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, want.collect()))


def test_sessions_and_gaps(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:00:00', 1.0), (1, TIMESTAMP '2024-01-01 00:04:00', 2.0), (1, TIMESTAMP '2024-01-01 01:00:00', 3.0) AS t(k, ts, v)")
    assert sorted(r["n"] for r in sessions(rows, "ts", "10 minutes", ["k"], [F.count("*").alias("n")]).collect()) == [1, 2]
    filled = gap_filled(rows, "ts", "2 minutes", ["k"], ["v"]).orderBy("ts").collect()
    assert len(filled) == 31 and [r["v"] for r in filled[:4]] == [1.0, 1.0, 2.0, 2.0]
