"""Running counts over streams of events or hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, by: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum per window and class; rows later than the watermark are dropped. Works on streams and tables alike."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    g = e.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), by, "n", "total")
