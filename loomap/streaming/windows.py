"""Windowed aggregates that run the same on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame) -> DataFrame:
    """(window_start, event_type, n, total) by hour of ts."""
    out = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def hourly_stream(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """The same on a stream: each event once, state dropped when the watermark has passed."""
    return hourly(events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]))
