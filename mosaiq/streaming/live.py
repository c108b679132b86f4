"""The operators that also make sense on streams of assets; the batch forms are in mosaiq.operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(stream: DataFrame, time: str, gap: str, late: str, by: list[str]) -> DataFrame:
    """Moments as session windows: start, end and number of rows; rows may come late by so much."""
    return stream.withWatermark(time, late).groupBy(*by, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def buckets(stream: DataFrame, time: str, late: str, size: str = "1 day") -> DataFrame:
    """Counts per tumbling window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sliding(stream: DataFrame, time: str, late: str, size: str, step: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, size, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def distinct(stream: DataFrame, time: str, late: str, key: list[str]) -> DataFrame:
    """The first row of each key within the time that rows may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
