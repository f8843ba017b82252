"""Windowed counts over a stream of events: the batch operators' counting with event time and a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def window_counts(events: DataFrame, size: str, slide: str, late: str, time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """``window_start, key, n, total`` of sliding event-time windows; events more than ``late`` behind are dropped by the watermark."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counted = timed.groupBy(F.window(time, size, slide).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), key, "n", "total")


def session_counts(events: DataFrame, gap: str, late: str, time: str = "ts", key: str = "user_id") -> DataFrame:
    """``session_start, session_end, key, n`` of sessions that end after a pause of ``gap``."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counted = timed.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Starts the query; it stops after what is there now and goes on from its checkpoint when started again."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
