"""Label shares over event-time windows, as a stream or a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, key: str, time: str = "ts", window: str = "1 hour", watermark: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """start, key, n per window; late rows are dropped after the watermark in a stream."""
    rows = events.withWatermark(time, watermark)
    at = F.window(time, window, slide) if slide else F.window(time, window)
    return rows.groupBy(at.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
