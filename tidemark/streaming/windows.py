"""An extension: event counts and sums by sliding windows over a stream, with late data dropped behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, at: str = "ts", by: str = "event_type", value: str = "value", length: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """(window_start, by, n, total) of a stream or a table; nulls in ``value`` add nothing."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    events = events.withColumn(at, F.col(at).cast("timestamp"))
    return events.withWatermark(at, lateness).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")
