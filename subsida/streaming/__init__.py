"""Structured Streaming forms of the daily means and the gap sessions, for stations that keep on measuring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_means(stream: DataFrame, key: str = "pnt", ts: str = "ts", value: str = "value", lateness: str = "1 day", least: int = 1) -> DataFrame:
    """(key, day, mean, n) of a stream, once a day is complete; samples later than the lateness are dropped by the watermark."""
    g = stream.withWatermark(ts, lateness).groupBy(key, F.window(ts, "1 day")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return g.where(F.col("n") >= least).select(key, F.col("window.start").alias("day"), "mean", "n")


def gap_sessions(stream: DataFrame, gap: str, key: str = "pnt", ts: str = "ts", lateness: str = "1 day") -> DataFrame:
    """(key, first, last, n): runs of samples with no gap of the given length."""
    s = stream.withWatermark(ts, lateness).groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return s.select(key, "first", "last", "n")
