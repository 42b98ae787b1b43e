"""Tumbling, sliding and session windows and gap filling, the same on batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(frame: DataFrame, time: str, width: str, keys: list[str], aggregates: list[Column], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates for each window of `width` (every `slide`, if given) and key. On a stream `late` is the watermark's delay."""
    source = frame.withWatermark(time, late) if late and frame.isStreaming else frame
    window = F.window(time, width, slide) if slide else F.window(time, width)
    told = source.groupBy(window.alias("window"), *keys).agg(*aggregates)
    return told.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in told.columns if c != "window"])


def sessions(frame: DataFrame, time: str, gap: str, keys: list[str], aggregates: list[Column], late: str | None = None) -> DataFrame:
    """Aggregates for each session: rows of a key of which none comes later than `gap` after the one before."""
    source = frame.withWatermark(time, late) if late and frame.isStreaming else frame
    told = source.groupBy(F.session_window(time, gap).alias("session"), *keys).agg(*aggregates)
    return told.select(F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), *[c for c in told.columns if c != "session"])


def gap_filled(frame: DataFrame, time: str, step: str, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each step between a key's first and last time; missing values are carried on from the row before. Batch only."""
    from pyspark.sql import Window

    ends = frame.groupBy(*keys).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    grid = ends.select(*keys, F.explode(F.sequence("first", "last", F.expr(f"INTERVAL {step}"))).alias(time))
    order = Window.partitionBy(*keys).orderBy(time)
    joined = grid.join(frame, [*keys, time], "left")
    return joined.select(*keys, time, *(F.last(v, ignorenulls=True).over(order).alias(v) for v in values))
