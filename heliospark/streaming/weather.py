"""Weather as it arrives: the latest reading of each hour, late ones within the watermark included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.constants import WEATHER_TTL_S


def latest(readings: DataFrame, late: str = f"{WEATHER_TTL_S} seconds") -> DataFrame:
    """(hour, feels, cloud, rain) of readings(ts, fetched_at, feels, cloud, rain): per hour of ts the reading fetched last. Works on streams and tables."""
    d = readings.withWatermark("ts", late) if readings.isStreaming else readings
    best = d.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.max_by(F.struct("feels", "cloud", "rain"), "fetched_at").alias("r"))
    return best.select(F.col("w.start").alias("hour"), "r.*")
