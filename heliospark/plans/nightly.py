"""A date's shade for the whole network, and its release."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospark.functions.clock import to_hhmm
from heliospark.functions.solar import daylight_minutes, sun_position
from heliospark.operators.shade import score_streets
from heliospark.sources import files, scorestore


def stamps_of(spark: SparkSession, date: dt.date) -> DataFrame:
    """(stamp_idx, minute, stamp, altitude, azimuth) of the day's daylight; at most 72 rows."""
    d = F.lit(date)
    m = spark.range(1).select(F.posexplode(daylight_minutes(d)).alias("stamp_idx", "minute"))
    return m.withColumn("s", sun_position(d, F.col("minute"))).select("stamp_idx", "minute", to_hhmm(F.col("minute")).alias("stamp"), "s.altitude", "s.azimuth")


def score_date(casters: DataFrame, shapes: DataFrame, edges: DataFrame, date: dt.date, radius_m: int) -> DataFrame:
    """Rows for the score store: all stamps are one job, partitioned by stamp and place."""
    stamps = stamps_of(edges.sparkSession, date)
    shade = score_streets(shapes, casters, stamps)
    out = shade.join(edges.select("edge_id", "u", "v", "key"), "edge_id")
    return out.select(F.lit(radius_m).alias("radius_m"), F.lit(date).alias("date"), "stamp", "u", "v", "key", F.col("shade").alias("shade_fraction"))


def release(spark: SparkSession, casters: DataFrame, shapes: DataFrame, edges: DataFrame, date: dt.date, radius_m: int, root: str, generated_at: str, scores_only: bool = False, tilesets: list[str] | None = None) -> list[dt.date]:
    """Scores first, then tilesets in {root}/tiles that this run did not write go, then the manifest; other dates' scores are deleted last, and only once the manifest names this one. With scores_only nothing is deleted and no manifest written."""
    scorestore.save(score_date(casters, shapes, edges, date, radius_m), f"{root}/scores")
    stamps = [r["stamp"] for r in stamps_of(spark, date).orderBy("stamp_idx").collect()]
    wrong = scorestore.validate(spark, f"{root}/scores", radius_m, date, stamps, edges)
    if wrong:
        raise ValueError("; ".join(wrong))
    if scores_only:
        return []
    files.drop_stale(spark, f"{root}/tiles", tilesets or [])
    files.write_manifest(spark, f"{root}/manifest.json", date.isoformat(), stamps, "shadows", generated_at)
    return scorestore.prune(spark, f"{root}/scores", date)


def stale(spark: SparkSession, on_disk: list[str], written: list[str]) -> DataFrame:
    """Names on disk that were not written, in order."""
    a, b = spark.createDataFrame([(x,) for x in on_disk], "name string"), spark.createDataFrame([(x,) for x in written], "name string")
    return a.join(b, "name", "left_anti").orderBy("name")
