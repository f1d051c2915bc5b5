"""Heights of buildings from overrides, tags, storeys, neighbours and priors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.constants import LEVEL_HEIGHT, MIN_GROUP, NEIGHBOURS
from heliospark.operators.near import nearest_k, sided, small


def level_priors(known: DataFrame, least: int = MIN_GROUP) -> tuple[DataFrame, DataFrame]:
    """From (tag, bin, levels): medians by (tag, bin) of groups with `least` members, and by tag alone. Storeys outside 1 to 60 are typos."""
    ok = known.where(F.col("levels").between(1, 60))
    by_group = ok.groupBy("tag", "bin").agg(F.median("levels").alias("group_levels"), F.count("*").alias("n")).where(F.col("n") >= least).where(F.col("bin").isNotNull()).drop("n")
    return by_group, ok.groupBy("tag").agg(F.median("levels").alias("tag_levels"))


def neighbour_levels(buildings: DataFrame, k: int = NEIGHBOURS, size: float | None = None) -> DataFrame:
    """(id, neighbour_levels) for rows (id, x, y, bin, levels) without levels: the median of the k nearest of their size class, else of any."""
    have = buildings.where("levels is not null").select(F.col("id").alias("source_id"), F.col("x").alias("sx"), F.col("y").alias("sy"), "bin", "levels")
    want = buildings.where("levels is null").select(F.col("id").alias("query_id"), "x", "y", "bin")

    def medians(q: DataFrame, s: DataFrame, on: list[str]) -> DataFrame:
        near = nearest_k(q, s.drop("levels"), k, size, on)
        return near.join(sided(s.select("source_id", "levels"), s.count()), "source_id").groupBy("query_id").agg(F.median("levels").alias("neighbour_levels"))

    same = medians(want.where("bin is not null"), have.where("bin is not null"), ["bin"])
    left = want.join(same, "query_id", "left_anti").drop("bin")
    return same.unionByName(medians(left, have.drop("bin"), [])).withColumnRenamed("query_id", "id")


def with_overrides(buildings: DataFrame, overrides: DataFrame) -> DataFrame:
    """buildings(element, id, ...) with override_levels, from overrides(osm_element, osm_id, levels), whose keys are unique."""
    o = overrides.select(F.col("osm_element").alias("element"), F.col("osm_id").alias("id"), F.col("levels").alias("override_levels"))
    return buildings.join(small(o), ["element", "id"], "left")


def with_height(buildings: DataFrame) -> DataFrame:
    """buildings(id, tag, bin, x, y, tag_height, tag_levels_text, override_levels) with height_m and height_source.

    `levels` is the parsed tag. An override stands before everything; the height tag is metres, everything else storeys."""
    b = buildings.withColumn("__known", F.coalesce("override_levels", "levels"))
    by_group, by_tag = level_priors(b.select("tag", "bin", "levels"))
    near = neighbour_levels(b.select("id", "x", "y", "bin", F.col("__known").alias("levels")))
    out = b.join(near, "id", "left").join(small(by_group), ["tag", "bin"], "left").join(small(by_tag), "tag", "left")
    return chain(out, F.coalesce("group_levels", "tag_levels")).select(*buildings.columns, "height_m", "height_source")


def chain(df: DataFrame, prior) -> DataFrame:
    """override, tag, levels, neighbour, prior, fallback: the first that is there."""
    steps = [
        ("override", F.col("override_levels") * LEVEL_HEIGHT), ("tag", F.col("tag_height")), ("levels", F.col("levels") * LEVEL_HEIGHT),
        ("neighbour", F.col("neighbour_levels") * LEVEL_HEIGHT), ("prior", prior * LEVEL_HEIGHT), ("fallback", F.lit(LEVEL_HEIGHT)),
    ]
    source = F.coalesce(*[F.when(v.isNotNull(), name) for name, v in steps])
    return df.withColumn("height_m", F.coalesce(*[v for _, v in steps])).withColumn("height_source", source)
