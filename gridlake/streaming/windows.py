"""Event-time windows that work on batches and streams alike; on a stream the caller sets a watermark first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, keys: list[str], length: str, value: str, slide: str | None = None) -> DataFrame:
    """start, n and total of each window; sliding if a slide is given."""
    grouped = df.groupBy(*keys, F.window(ts, length, slide) if slide else F.window(ts, length))
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*keys, F.col("window.start").alias("start"), "n", "total")


def sessions(df: DataFrame, ts: str, keys: list[str], gap: str) -> DataFrame:
    """start, end and n of each session; it ends once no event came for the gap."""
    grouped = df.groupBy(*keys, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return grouped.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
