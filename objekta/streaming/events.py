"""Extension: the events table as a stream, with watermarks and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """New Parquet files of a folder, as they come."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def watermarked(events: DataFrame, late: str | None) -> DataFrame:
    """late None: the stream has a watermark already (a second one is not allowed)."""
    return events.withWatermark("ts", late) if late else events


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str | None = "2 hours") -> DataFrame:
    """Tumbling or sliding windows by kind of event. Events that come later than late are left out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    sums = watermarked(events, late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    """A user's events with less than gap between them."""
    found = watermarked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str | None = "2 hours") -> DataFrame:
    """Each event id once; state is kept as long as the watermark asks for."""
    return watermarked(events, late).dropDuplicatesWithinWatermark(["event_id"])


def append_to(df: DataFrame, path: str, checkpoint: str):
    """Exactly once to Parquet: finished windows only."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
