"""Exposure of links from a stream of intensity readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_exposure(readings: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, e_id, n, intensity (largest) of readings (ts, e_id, intensity), on a stream or a table.

    Readings later than ``late`` behind the newest are left out on a stream; state is one row a link and open window.
    """
    grouped = readings.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "e_id")
    return grouped.agg(F.count("*").alias("n"), F.max("intensity").alias("intensity")).select(F.col("w.start").alias("window_start"), "e_id", "n", "intensity")
