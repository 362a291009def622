"""Thin helpers for event-time streams: windows, sessions, deduplication. Extensions of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, every: str, keys: list[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    """Aggregates by event-time window; ``late`` is the watermark of a stream."""
    df = df.withWatermark(time, late) if late else df
    out = df.groupBy(F.window(time, every).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("start"), *[c for c in out.columns if c != "w"])


def sliding(df: DataFrame, time: str, width: str, every: str, keys: list[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    df = df.withWatermark(time, late) if late else df
    out = df.groupBy(F.window(time, width, every).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("start"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    df = df.withWatermark(time, late) if late else df
    out = df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def once(df: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
