"""Buffers of lines and polygons: what lies within a distance of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospark.functions import geo
from heliospark.operators import overlay
from heliospark.operators import rings as R


def _round(x: Column, y: Column, radius: float, quarter: int) -> Column:
    """A closed ring of 4 * quarter corners around a point, the first due east."""
    n = 4 * quarter
    at = [F.struct((x + radius * round(math.cos(2 * math.pi * k / n), 12)).alias("x"), (y + radius * round(math.sin(2 * math.pi * k / n), 12)).alias("y")) for k in range(n)]
    return F.array(*at, at[0])


def buffered(shapes: DataFrame, radius: float, quarter: int = 4, closed: bool = False) -> DataFrame:
    """(id, rings) within the radius of shapes(id, coords), lines of one or more points, or with closed of shapes(id, rings), polygons: outer rings with their holes.

    Along each straight piece there is a strip to both sides, at each corner and end a round join of 4 * quarter corners; strips, joins and the
    polygon itself overlap, and their union is the buffer. A shape without points has none."""
    lines = shapes.select("id", F.explode("rings").alias("coords")) if closed else shapes.select("id", "coords")
    s = lines.select("id", F.explode(geo.segments(F.col("coords"))).alias("s")).select("id", F.col("s.a").alias("a"), F.coalesce("s.b", "s.a").alias("b"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    size = F.nullif(geo.hypot(dx, dy), F.lit(0.0))
    nx, ny = -dy / size * radius, dx / size * radius
    corner = lambda p, k: F.struct((F.col(f"{p}.x") + k * nx).alias("x"), (F.col(f"{p}.y") + k * ny).alias("y"))
    strips = s.where("a != b").select("id", F.array(corner("a", 1), corner("a", -1), corner("b", -1), corner("b", 1), corner("a", 1)).alias("ring"))
    joins = lines.select("id", F.explode("coords").alias("p")).distinct().select("id", _round(F.col("p.x"), F.col("p.y"), radius, quarter).alias("ring"))
    parts = strips.unionByName(joins).select(F.col("id").alias("stamp"), F.lit(False).alias("soft"), F.array("ring").alias("rings"))
    if closed:
        parts = parts.unionByName(shapes.select(F.col("id").alias("stamp"), F.lit(False).alias("soft"), "rings"))
    merged = overlay.layers_each(parts).select("stamp", "ring", "area")
    return R.polygons(merged, ["stamp"]).select(F.col("stamp").alias("id"), "rings")
