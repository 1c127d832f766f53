"""Live metric windows; the same functions run on a closed batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp; the given event times are UTC without a zone."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def windowed(
    events: DataFrame,
    by: Sequence[str],
    value: str,
    length: str = "5 minutes",
    slide: str | None = None,
    watermark: str | None = "10 minutes",
) -> DataFrame:
    """(window, by, n, total, mean, largest) per tumbling or sliding window."""
    timed = events.withWatermark("ts", watermark) if watermark else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return timed.groupBy(window, *by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
        F.max(value).alias("largest"),
    )
