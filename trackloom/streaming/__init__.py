"""Streaming form of the per-frame counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "2 hours", size: str = "1 hour") -> DataFrame:
    """Observations per window and label; works on streams (with a watermark) and on tables alike."""
    held = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if held.isStreaming:
        held = held.withWatermark("ts", late)
    return held.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("start"), F.col("event_type").alias("label"), "n")
