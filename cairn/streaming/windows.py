"""Event-time aggregations that run on streams and on tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, ts: str, lateness: str | None) -> DataFrame:
    return df.withWatermark(ts, lateness) if df.isStreaming and lateness else df


def tumbling(df: DataFrame, ts: str, size: str, key: str, value: str, lateness: str | None = "1 hour") -> DataFrame:
    out = _late(df, ts, lateness).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), key, "n", "total")


def sliding(df: DataFrame, ts: str, size: str, slide: str, key: str, value: str, lateness: str | None = "1 hour") -> DataFrame:
    out = _late(df, ts, lateness).groupBy(F.window(ts, size, slide), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), key, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, key: str, lateness: str | None = "1 hour") -> DataFrame:
    out = _late(df, ts, lateness).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("session_start"), "n")


def first_deliveries(df: DataFrame, keys: list[str], ts: str, lateness: str = "1 hour") -> DataFrame:
    """Each key once: within the watermark on a stream, overall on a table."""
    return df.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
