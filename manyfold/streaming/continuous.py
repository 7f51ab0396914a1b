"""Continuous aggregates over streams of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import timeseries


def continuous(points: DataFrame, ts: str, value: str, width_ms: int, late: str = "1 hour") -> DataFrame:
    """Buckets of a stream of points (ts: timestamp): start, n, total, low, high, mean. A point counts in the bucket of
    its own time however late it comes, up to `late` after the latest time seen; older state is dropped."""
    v = F.col(value).cast("double")
    window = F.window(F.col(ts), f"{width_ms} milliseconds")
    out = points.withWatermark(ts, late).groupBy(window).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"))
    return out.select(timeseries.millis(F.col("window.start")).alias("bucket_start"), "n", "total", "low", "high", (F.col("total") / F.nullif(F.col("n"), F.lit(0))).alias("mean"))


def sessions(points: DataFrame, ts: str, gap: str, by: tuple[str, ...] = (), late: str = "1 hour") -> DataFrame:
    """Sessions that end when a key is silent for gap."""
    out = points.withWatermark(ts, late).groupBy(*by, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, timeseries.millis(F.col("session_window.start")).alias("session_start"), timeseries.millis(F.col("session_window.end")).alias("session_end"), "n")
