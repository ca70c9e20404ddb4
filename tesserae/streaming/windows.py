"""Streaming forms of the sequence operators. An extension: bounded forms are in operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_argmax(events: DataFrame, keys: list[str], time: str, score: str, tie: str, width: str, late: str) -> DataFrame:
    """The best row of each tumbling window, the first of equals by tie; rows later than the
    watermark are left out."""
    best = F.min_by(F.struct(score, tie), F.struct(-F.col(score), tie))
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), best.alias("b")).select(F.col("window.start").alias("start"), *keys, "n", "b.*")


def sessions(events: DataFrame, keys: list[str], time: str, value: str, gap: str, late: str) -> DataFrame:
    """Sessions that end after a gap: bounds, number of rows, sum of values."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n", "total")
