"""Lengths of unions of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_length(rows: DataFrame, keys: list[str], start: str = "t0", end: str = "t1", name: str = "covered") -> DataFrame:
    """Per key the length that intervals cover together: each adds what lies beyond the farthest end before it."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(end).over(w), F.col(start))
    grown = rows.where(F.col(end) >= F.col(start)).withColumn("__more", F.greatest(F.col(end) - F.greatest(F.col(start), before), F.col(end) - F.col(end)))
    return grown.groupBy(*keys).agg(F.sum("__more").alias(name))
