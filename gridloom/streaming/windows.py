"""Reductions over event time: what merges (counts, sums, extremes, moments, fixed bins) as a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reduce


def windowed(df: DataFrame, ts: str, value: str, width: str, slide: str | None = None, by: list[str] | None = None, late: str | None = None) -> DataFrame:
    """count, sum, mean, std, min and max of each window (tumbling, or sliding by ``slide``) and group.

    The same plan works on a table and on a stream; a stream needs ``late`` to drop its state."""
    if late:
        df = df.withWatermark(ts, late)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    got = df.groupBy(window.alias("w"), *(by or [])).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), reduce.mean(value).alias("mean"), reduce.std(value).alias("std"),
        F.min(value).alias("low"), F.max(value).alias("high"),
    )
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *(by or []), "n", "total", "mean", "std", "low", "high")


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    if late:
        df = df.withWatermark(ts, late)
    got = df.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *by, "n")


def binned(df: DataFrame, ts: str, value: str, edges: list[float], width: str, late: str | None = None) -> DataFrame:
    """A histogram with fixed edges per window."""
    if late:
        df = df.withWatermark(ts, late)
    got = df.groupBy(F.window(ts, width).alias("w"), reduce.bin_of(value, edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("w.start").alias("start"), "bin", "n")
