"""Rings out of directed pieces of boundary, by joins: each piece's next one, and then pointer jumping.

Coordinates are whole numbers here, so that ends meet exactly. A region lies to the left of its boundary: outer rings run
against the clock and have a positive area, holes a negative one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospark.functions import geo
from heliospark.operators.near import grid_join
from heliospark.sources.tables import dropped, stored

PATH = "array<struct<x:bigint,y:bigint>>"


def link(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path): closed rings, the first point again at the end, of pieces(keys, path) that begin where others end.

    Where several begin, the one that turns most to the left is next, so rings that touch in a point stay apart. Every round of
    jumping doubles how far each piece looks for the least number of its ring and how many steps away that is; rounds grow as the
    logarithm of the longest ring's pieces. A ring is put together as one value."""
    p = stored(pieces.select(*keys, "path").withColumn("id", F.monotonically_increasing_id()))
    first, last = F.element_at("path", 1), F.element_at("path", -1)
    open_ = p.where(first != last)
    way = lambda a, b: F.atan2((b["y"] - a["y"]).cast("double"), (b["x"] - a["x"]).cast("double"))
    ends = open_.select(*keys, F.col("id"), last.alias("at"), way(last, F.element_at("path", -2)).alias("back"))
    starts = open_.select(*keys, F.col("id").alias("next"), first.alias("at"), way(first, F.element_at("path", 2)).alias("on"))
    turn = F.pmod(F.col("back") - F.col("on"), F.lit(2 * math.pi))
    met = ends.join(starts, [*keys, "at"]).groupBy("id").agg(F.min_by("next", F.struct(F.when(turn > 1e-12, turn).otherwise(7.0), F.col("next"))).alias("next"))
    now = stored(met.select("id", F.col("next").alias("to"), F.col("id").alias("least"), F.lit(0).cast("long").alias("steps"), F.lit(True).alias("changed")))
    reach = 1

    def farther(t: DataFrame, reach: int) -> DataFrame:
        far = t.select(F.col("id").alias("to"), F.col("to").alias("then"), F.col("least").alias("seen"), F.col("steps").alias("more"))
        nearer = F.col("seen") < F.col("least")
        return t.join(far, "to").select("id", F.col("then").alias("to"), F.least("seen", "least").alias("least"), F.when(nearer, F.col("more") + reach).otherwise(F.col("steps")).alias("steps"), nearer.alias("changed"))

    while now.where("changed").limit(1).count():
        new = stored(farther(farther(now, reach), 2 * reach))
        dropped(now)
        now, reach = new, 4 * reach
    # the least one is first, then those that are farthest from meeting it again
    order = F.struct(F.when(F.col("steps") == 0, F.lit(-(1 << 62))).otherwise(-F.col("steps")).alias("k"), "path")
    tied = open_.join(now.select("id", "least", "steps"), "id").groupBy(*keys, "least").agg(F.array_sort(F.collect_list(order)).alias("ps"))
    whole = F.flatten(F.transform("ps", lambda x: F.slice(x["path"], 1, F.size(x["path"]) - 1)))
    out = tied.select(*keys, whole.alias("path")).select(*keys, F.concat("path", F.slice("path", 1, 1)).alias("path"))
    return stored(out.unionByName(p.where(first == last).select(*keys, "path")))


def signed_area(path: Column) -> Column:
    """Of a closed path, in its own units; positive against the clock."""
    o = F.element_at(path, 1)
    at = F.sequence(F.lit(2), F.size(path) - 1)
    off = lambda p, k: (p[k] - o[k]).cast("double")
    cross = lambda a, b: off(a, "x") * off(b, "y") - off(b, "x") * off(a, "y")
    return F.when(F.size(path) < 4, F.lit(0.0)).otherwise(F.aggregate(at, F.lit(0.0), lambda acc, i: acc + cross(F.element_at(path, i), F.element_at(path, i + 1))) / 2)


def straightened(path: Column) -> Column:
    """A closed path without corners that lie on the straight line between their neighbours, to the unit: so none goes that a neighbour's going would make a corner."""
    n = F.size(path) - 1
    at = lambda i: F.element_at(path, (F.pmod(i, n) + 1).cast("int"))
    bend = lambda i: (at(i)["x"] - at(i - 1)["x"]) * (at(i + 1)["y"] - at(i)["y"]) - (at(i)["y"] - at(i - 1)["y"]) * (at(i + 1)["x"] - at(i)["x"])
    kept = F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: bend(i) != 0), at)
    return geo.let(kept, lambda k: F.concat(k, F.slice(k, 1, 1)))


def in_metres(path: Column, unit: float) -> Column:
    return F.transform(path, lambda p: F.struct((p["x"] * unit).alias("x"), (p["y"] * unit).alias("y")))


def polygons(rings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rings): each outer ring of rings(keys, ring, area) with the holes that lie in it and in no smaller outer ring, the outer one first."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    r = stored(rings.where("area != 0").select(*keys, "ring", "area", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")).withColumn("rid", F.monotonically_increasing_id()))
    outer = r.where("area > 0").select(*keys, F.col("rid").alias("outer"), F.col("ring").alias("shell"), F.col("area").alias("size"), *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    # a point just right of a hole's boundary: in the region, so in the shell, and in no other outer ring that the hole is not in
    a, b = F.element_at("ring", 1), F.element_at("ring", 2)
    holes = r.where("area < 0").select(*keys, "rid", "ring", ((a["x"] + b["x"]) / 2).alias("x0"), ((a["y"] + b["y"]) / 2).alias("y0")).withColumn("x1", F.col("x0")).withColumn("y1", F.col("y0"))
    span = r.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0
    met = grid_join(holes, outer, max(2 * span, 1e-3), keys)
    size = F.greatest(geo.hypot(b["x"] - a["x"], b["y"] - a["y"]), F.lit(1e-12))
    eps = 1e-6
    px, py = F.col("x0") - (b["y"] - a["y"]) / size * eps, F.col("y0") + (b["x"] - a["x"]) / size * eps  # to the left: the region
    inside = met.where(geo.in_ring(F.col("shell"), px, py))
    owner = inside.groupBy("rid").agg(F.min_by("outer", F.struct("size", "outer")).alias("outer"))
    own = r.where("area < 0").join(owner, "rid").groupBy("outer").agg(F.sort_array(F.collect_list("ring")).alias("holes"))
    return outer.join(own, "outer", "left").select(*keys, F.concat(F.array("shell"), F.coalesce("holes", F.array().cast(geo.RINGS))).alias("rings"))
