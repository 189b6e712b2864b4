"""Contact matrices over streams of contact events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweave.operators.matrix import PIXEL, binned


def streaming_pixels(events: DataFrame, bin_size: int, nrows: int, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Events (ts, chrom, pos1, pos2) counted by time window and pixel. Works on streams, where events more than ``late``
    behind are dropped and windows are final once the watermark passes them, and on tables."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    inside = binned(stamped, bin_size).where(F.col("bin2") - F.col("bin1") < nrows)
    return inside.groupBy(F.window("ts", window).alias("window"), *PIXEL).agg(F.count("*").alias("count")).select(F.col("window.start").alias("from"), F.col("window.end").alias("to"), *PIXEL, "count")


def write_pixels(pixels: DataFrame, path: str, checkpoint: str):
    """Appends finished windows to a Parquet table; the query resumes from ``checkpoint``."""
    return pixels.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
