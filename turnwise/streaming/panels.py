"""Windowed counts of an event stream; the same frames work on a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counts(events: DataFrame, window: Column, late: str) -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    total = F.sum(F.col("value").cast("decimal(18,4)")).cast("double")
    return events.groupBy(window, "event_type").agg(F.count("*").alias("n"), total.alias("total"))


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events by hour and type; on a stream, rows later than `late` are left out."""
    return _counts(events, F.window("ts", "1 hour"), late)


def sliding(events: DataFrame, length: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return _counts(events, F.window("ts", length, step), late)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users by gaps in their events."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
