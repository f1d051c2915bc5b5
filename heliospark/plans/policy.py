"""The preference of a day or an hour, with forecasts held for a while."""

from __future__ import annotations

import datetime as dt
import threading
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospark.constants import WEATHER_DATES, WEATHER_FAILED_TTL_S, WEATHER_TTL_S, WEATHER_WINDOW_DAYS
from heliospark.functions.exposure import preference, public_preference

HOUR = "hour int, feels double, cloud double, rain double"


class WeatherDays:
    """fetch(date) gives rows of HOUR or fails. A day is held for WEATHER_TTL_S, a failure for less; of more than WEATHER_DATES days the one longest unused goes. Dates outside the forecast's window are not asked for."""

    def __init__(self, fetch: Callable[[dt.date], list[tuple]], today: Callable[[], dt.date], clock: Callable[[], float] = time.monotonic):
        self.fetch, self.today, self.clock = fetch, today, clock
        self.held: OrderedDict[dt.date, tuple[float, list[tuple]]] = OrderedDict()
        self.lock = threading.Lock()

    def day(self, date: dt.date) -> list[tuple]:
        low, high = WEATHER_WINDOW_DAYS
        if not low <= (date - self.today()).days <= high:
            return []
        with self.lock:
            now = self.clock()
            if date in self.held and self.held[date][0] > now:
                self.held.move_to_end(date)
                return self.held[date][1]
            try:
                rows, keep = self.fetch(date), WEATHER_TTL_S
            except (OSError, ValueError):
                rows, keep = [], WEATHER_FAILED_TTL_S
            self.held[date] = (now + keep, rows)
            self.held.move_to_end(date)
            while len(self.held) > WEATHER_DATES:
                self.held.popitem(last=False)
            return rows


def for_day(spark: SparkSession, weather: WeatherDays, date: dt.date, stamps: list[str]) -> DataFrame:
    """(stamp, preference) for each stamp of a day, noon included, as clients see it."""
    times = list(dict.fromkeys([*stamps, "12:00"]))
    asked = spark.createDataFrame([(t, int(t[:2])) for t in times], "stamp string, hour int")
    hours = spark.createDataFrame(weather.day(date), HOUR)
    p = preference(F.lit(date), F.col("feels"), F.col("cloud"), F.col("rain"))
    return asked.join(hours, "hour", "left").select("stamp", public_preference(p).alias("preference"))
