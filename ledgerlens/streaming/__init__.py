"""Extensions for streams of audit rows; the batch operators are the reference point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh_rows(stream: DataFrame, time: str, keys: list[str], lateness: str = "14 days") -> DataFrame:
    """Rows whose keys were not seen within the lateness."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_totals(stream: DataFrame, time: str, by: str, value: str, width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Count and sum by tumbling window."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
