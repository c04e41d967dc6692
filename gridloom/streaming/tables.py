"""Structured Streaming forms of aggregation, segments and deduplication. Event-time columns need a watermark, up to
which late rows count; state older than it is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_aggregate(stream: DataFrame, time: str, groups: list[str], target: str, window: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """rows, sum and mean of a column in windows of time and groups."""
    at = F.window(time, window, slide) if slide else F.window(time, window)
    out = stream.withWatermark(time, late).groupBy(at.alias("w"), *groups)
    return out.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(target), 4).alias("sum"), F.round(F.avg(target), 4).alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *groups, "rows", "sum", "mean")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's rows without a gap."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows")


def deduplicated(stream: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key that arrives within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
