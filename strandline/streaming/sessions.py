"""The inactivity rule as a stream: sessions that end after a gap without events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n_events of each session; works on batches and on streams.

    On a stream the watermark bounds the state: events later than ``late`` are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)
