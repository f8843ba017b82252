from pyspark.sql import functions as F

from tidemark.streaming import windows


def test_stream_gives_the_batch_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = windows.read_events(spark, f"{tmp_path}/in", events.schema.simpleString()[7:-1].replace(":", " "))
    q = windows.write(windows.window_counts(stream, "2 hours", "1 hour", "60 days"), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert q.exception() is None
    mem = windows.window_counts(stream, "2 hours", "1 hour", "60 days").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    mem.awaitTermination(120)
    got = sorted((r["window_start"], r["event_type"], r["n"]) for r in spark.table("counted").collect())
    want = events.groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    assert got == sorted((r["w"]["start"], r["event_type"], r["n"]) for r in want.collect())
    s = windows.session_counts(stream, "30 minutes", "60 days").writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert spark.table("sessions").agg(F.sum("n")).first()[0] == events.count()
