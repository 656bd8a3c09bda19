"""Event-time windows over a stream or a table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, window: str = "1 day", late: str = "2 hours", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events and their total value by window and kind; on a stream, later ones than ``late`` are dropped."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", "total")
