"""The queue of buildings to count storeys of, and the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.constants import SURVEY_TOP
from heliospark.sources.tables import upsert

KEY = ["osm_element", "osm_id"]


def queue(buildings: DataFrame, top: int = SURVEY_TOP) -> DataFrame:
    """Of buildings without storeys the ones that cast most: (osm_element, osm_id, area_m2, lat, lon, shadow_mass, url)."""
    b = buildings.where("levels is null").orderBy(F.desc("shadow_mass"), "osm_element", "osm_id").limit(top)
    url = F.concat(F.lit("https://www.openstreetmap.org/"), F.col("osm_element"), F.lit("/"), F.col("osm_id"))
    return b.select(*KEY, F.bround("area_m2", 0).alias("area_m2"), F.bround("lat", 6).alias("lat"), F.bround("lon", 6).alias("lon"), F.bround("shadow_mass", 1).alias("shadow_mass"), url.alias("url"))


def payload(queue_rows: DataFrame, footprints: DataFrame, priors: DataFrame, answered: DataFrame, skipped: DataFrame) -> DataFrame:
    """The queue with its footprints (rows without one are left out), what a prior would say, and whether it is done."""
    out = queue_rows.join(footprints.select(*KEY, "rings", "tag", "bin"), KEY, "left").where("rings is not null")
    out = out.join(priors, ["tag", "bin"], "left")
    return out.join(answered.select(*KEY, F.col("levels").alias("answer")), KEY, "left").join(skipped.select(*KEY, F.lit(True).alias("skipped")), KEY, "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)))


def answer(answers: DataFrame, skips: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, skips) after new(osm_element, osm_id, levels, source) rows: 1 to 80 storeys replace an answer, null is a skip; either clears the other table's row."""
    bad = new.where(~(F.col("levels").isNull() | F.col("levels").between(1, 80))).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['levels']} storeys are outside 1 to 80")
    counted, passed = new.where("levels is not null"), new.where("levels is null")
    return upsert(answers, counted, KEY).join(passed, KEY, "left_anti"), upsert(skips, passed.select(*skips.columns), KEY).join(counted, KEY, "left_anti")


def progress(queue_rows: DataFrame, answers: DataFrame, skips: DataFrame) -> DataFrame:
    """One row: counted, skipped, left, and the share of shadow mass that is counted."""
    q = queue_rows.join(answers.select(*KEY, F.lit(1).alias("a")), KEY, "left").join(skips.select(*KEY, F.lit(1).alias("s")), KEY, "left")
    return q.agg(F.count("a").alias("counted"), F.count("s").alias("skipped"), F.sum(F.when(F.coalesce("a", "s").isNull(), 1).otherwise(0)).alias("left"), F.try_divide(F.coalesce(F.sum(F.when(F.col("a") == 1, F.col("shadow_mass"))), F.lit(0.0)), F.sum("shadow_mass")).alias("mass_share"))


def resume_at(queue_rows: DataFrame, done: DataFrame) -> DataFrame:
    """The position of the first row that is neither answered nor skipped."""
    return queue_rows.join(done, KEY, "left_anti").agg(F.min("pos").alias("pos"))
