"""Structured Streaming over growing movies: an extension, beyond the batch operators.

Per-frame operators keep no state, so they apply to a streaming DataFrame as they are; running summaries
aggregate with a watermark on event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_frames(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """A stream of Parquet files of frames (frame, height, width, px)."""
    reader = spark.readStream.schema("frame long, height int, width int, px array<double>")
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


def windowed_summary(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts", value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, min, max of value by event-time window; rows later than the watermark are dropped."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, window), *by)
    out = grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "mean", "low", "high")


def write(df: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Start writing a stream as Parquet, through what is there now."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
