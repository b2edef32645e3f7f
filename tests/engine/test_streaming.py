"""The streaming windows, run as streams, against the same windows in batch."""

from tarnwick.streaming import windows


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = windows.tumbling(windows.read_events(spark, f"file://{tmp_path}/in", 10), late="3650 days")
    q = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    batch = windows.tumbling(events.withColumn("ts", events.ts.cast("timestamp")))
    key = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.total, 4)) for r in df.collect())
    assert key(spark.table("tumbled")) == key(batch)


def test_sliding_counts_every_window(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    out = windows.sliding(events.withColumn("ts", events.ts.cast("timestamp")))
    assert out.groupBy().sum("n").first()[0] == 4 * events.count()
