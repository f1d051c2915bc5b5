"""A day to walk in: all its stamps, or one that stands for them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospark.constants import MINUTES_IN_DAY
from heliospark.operators.walks import clock_table
from heliospark.sources import scorestore


@dataclass
class Day:
    """stamps in order, shade(stamp_idx, edge_id, shade), clock(minute, stamp_idx): what search.opened takes."""

    stamps: list[str]
    shade: DataFrame
    clock: DataFrame


def across(stamps: list[str], shade: DataFrame) -> Day:
    """A day of stamps with night after the last of them. Without a stamp there is no day."""
    if not stamps:
        raise ValueError("a day without daylight has no walks")
    rows = [(i, int(s[:2]) * 60 + int(s[3:])) for i, s in enumerate(stamps)]
    return Day(stamps, shade, clock_table(shade.sparkSession.createDataFrame(rows, "stamp_idx int, minute int")))


def at_one_stamp(edges: DataFrame, scored: DataFrame, stamp: str) -> Day:
    """scored(edge_id, shade) at every minute, night included; edges without a score have 0."""
    shade = edges.select("edge_id").join(scored.select("edge_id", F.col("shade").cast("float").alias("shade")), "edge_id", "left")
    minutes = edges.sparkSession.range(MINUTES_IN_DAY + 1).select(F.col("id").cast("int").alias("minute"), F.lit(0).alias("stamp_idx"))
    return Day([stamp], shade.select(F.lit(0).alias("stamp_idx"), "edge_id", F.coalesce("shade", F.lit(0.0).cast("float")).alias("shade")), minutes)


def assemble(spark: SparkSession, root: str, radius_m: int, date: dt.date, edges: DataFrame, stamps: list[str], at: str, score: Callable[[str], DataFrame] | None = None) -> Day:
    """The day from the score store; if a stamp of it is absent or covers too little, the stamp nearest to `at` (of two as near the earlier) for the whole day: from the store, else as score(stamp) gives (edge_id, shade)."""
    if not stamps:
        raise ValueError("a day without daylight has no walks")
    whole = scorestore.day_scores(spark, root, radius_m, date, stamps, edges)
    if whole is not None:
        return across(stamps, whole)
    minute = lambda s: int(s[:2]) * 60 + int(s[3:])
    nearest = min(stamps, key=lambda s: abs(minute(s) - minute(at)))
    one = scorestore.load(spark, root, radius_m, date, nearest, edges)
    if one is None and score is None:
        raise FileNotFoundError(f"{date} has no scores at {nearest}")
    return at_one_stamp(edges, score(nearest) if one is None else one, nearest)
