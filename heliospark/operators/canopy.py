"""Crowns from rasters and lattices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliospark.constants import CANOPY_SOURCES, CELL, MIN_CROWN_AREA, MIN_CROWN_HEIGHT, TREE_HEIGHT
from heliospark.functions import geo
from heliospark.functions.clock import leaf_on
from heliospark.operators import quality
from heliospark.operators import rings as R
from heliospark.operators.near import cells
from heliospark.sources.files import simplified
from heliospark.sources.tables import stored


def composite(tiles: DataFrame) -> DataFrame:
    """Overlapping tiles (row, col, value) as one raster: the highest counts."""
    return tiles.groupBy("row", "col").agg(F.max("value").alias("value"))


def overlay(burnt: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels of burnt that mask does not cover."""
    return burnt.join(mask.select("row", "col").distinct(), ["row", "col"], "left_anti")


def label(pixels: DataFrame, keys: list[str] = (), diagonal: bool = True) -> DataFrame:
    """pixels(row, col, ...) with label: the least pixel number of the connected patch, found by handing on labels and jumping to labels' labels; rounds grow as the logarithm of a patch's width."""
    keys = list(keys)
    wide = 1 << 31
    p = stored(pixels.withColumn("pid", F.col("row").cast("long") * wide + F.col("col")))
    ids = p.select(*keys, "pid", "row", "col")
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if diagonal or not a or not b]
    around = F.explode(F.array(*[F.lit(a * wide + b) for a, b in steps]))
    near = stored(ids.select(*keys, "pid", around.alias("d")).withColumn("other", F.col("pid") + F.col("d")).drop("d").join(ids.select(*keys, F.col("pid").alias("other")), [*keys, "other"]))
    now = stored(near.groupBy(*keys, "pid").agg(F.min("other").alias("label")))
    while True:
        jump = now.join(now.select(*keys, F.col("pid").alias("label"), F.col("label").alias("far")), [*keys, "label"]).select(*keys, "pid", F.col("far").alias("label"))
        spread = near.join(jump.select(*keys, F.col("pid").alias("other"), "label"), [*keys, "other"]).groupBy(*keys, "pid").agg(F.min("label").alias("label"))
        new = stored(spread)
        changed = new.join(now.withColumnRenamed("label", "old"), [*keys, "pid"]).where("label != old").limit(1).count()
        now = new
        if not changed:
            return p.join(now, [*keys, "pid"]).drop("pid")


def crowns(pixels: DataFrame, least_height: float = MIN_CROWN_HEIGHT, least_area: float = MIN_CROWN_AREA, pixel_area: float = 1.0) -> DataFrame:
    """(label, height_m, area, rows and columns of the box) of patches that are high and large enough; the height is the median of a patch."""
    found = label(pixels.where(F.col("value") >= least_height))
    out = found.groupBy("label").agg(F.median("value").alias("height_m"), (F.count("*") * pixel_area).alias("area"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))
    return out.where(F.col("area") >= least_area).withColumn("height_source", F.lit("chm_height"))


def outlines(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, area): rings around the pixels(keys, row, col) of each key, in columns and rows, holes with a negative area.

    A pixel puts down its four sides with a sign; sides that two pixels of a key share cancel. Sides in a line become one piece,
    and pieces are joined to rings. Pixels that touch in a corner only are in different rings."""
    side = lambda upright, line, pos, sign: F.struct(F.lit(upright).alias("upright"), line.cast("long").alias("line"), pos.cast("long").alias("pos"), F.lit(sign).alias("sign"))
    r, c = F.col("row"), F.col("col")
    sides = pixels.select(*keys, F.explode(F.array(side(False, r, c, 1), side(False, r + 1, c, -1), side(True, c + 1, r, 1), side(True, c, r, -1))).alias("s"))
    rim = sides.groupBy(*keys, "s.upright", "s.line", "s.pos").agg(F.sum("s.sign").alias("sign")).where("sign != 0")
    w = Window.partitionBy(*keys, "upright", "line", "sign").orderBy("pos")
    runs = rim.withColumn("run", F.col("pos") - F.row_number().over(w)).groupBy(*keys, "upright", "line", "sign", "run").agg(F.min("pos").alias("a"), (F.max("pos") + 1).alias("b"))
    at = lambda v: F.struct(F.when(F.col("upright"), F.col("line")).otherwise(F.col(v)).alias("x"), F.when(F.col("upright"), F.col(v)).otherwise(F.col("line")).alias("y"))
    pieces = runs.select(*keys, F.when(F.col("sign") > 0, F.array(at("a"), at("b"))).otherwise(F.array(at("b"), at("a"))).alias("path"))
    return R.link(pieces, keys).select(*keys, R.in_metres(F.col("path"), 1.0).alias("ring"), R.signed_area(F.col("path")).alias("area"))


def placed(rings, left: float, top: float, size: float):
    """Rings in columns and rows as rings in metres, for a raster whose rows run south from the top."""
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct((left + p["x"] * size).alias("x"), (top - p["y"] * size).alias("y"))))


def traced(pixels: DataFrame, keys: list[str], left: float, top: float, size: float, least_area: float) -> DataFrame:
    """(keys, rings, area): the patches of pixels(keys, row, col) as simplified polygons that are large enough before and after."""
    found = R.polygons(outlines(pixels, keys), keys)
    whole = found.withColumn("rings", placed(F.col("rings"), left, top, size)).where(geo.polygon_area(F.col("rings")) >= least_area)
    plain = whole.withColumn("rings", F.transform("rings", lambda r: simplified(r)))
    return plain.withColumn("area", geo.polygon_area(F.col("rings"))).where(F.col("area") >= least_area)


def crown_polygons(pixels: DataFrame, left: float = 0.0, top: float = 0.0, size: float = 1.0, least_height: float = MIN_CROWN_HEIGHT, least_area: float = MIN_CROWN_AREA) -> DataFrame:
    """(rings, height_m, area, height_source) of the canopy in pixels(row, col, value): patches, joined at corners too, have one height, their median; each patch joined at sides is a polygon."""
    found = stored(label(pixels.where(F.col("value") >= least_height)))
    tall = found.groupBy("label").agg(F.median("value").cast("double").alias("height_m"))
    shapes = traced(found.select("label", "row", "col"), ["label"], left, top, size, least_area)
    return shapes.join(tall, "label").select("rings", "height_m", "area", F.lit("chm_height").alias("height_source"))


def burnt_in_chunks(polygons: DataFrame, left: float, top: float, size: float, chunk: int = 512) -> DataFrame:
    """(row, col) of the pixels whose centre lies in one of polygons(rings): each polygon meets the chunks of a raster that its box touches, and asks for its pixels there."""
    xs, ys = F.transform(F.flatten("rings"), lambda p: p["x"]), F.transform(F.flatten("rings"), lambda p: p["y"])
    at = lambda v, by: F.floor(v / by).cast("long")
    box = polygons.select("rings", *[at((v - left) / size, 1).alias(n) for v, n in ((F.array_min(xs), "c0"), (F.array_max(xs), "c1"))], *[at((top - v) / size, 1).alias(n) for v, n in ((F.array_max(ys), "r0"), (F.array_min(ys), "r1"))])
    met = box.withColumn("chunk", F.explode(cells(F.col("c0"), F.col("r0"), F.col("c1"), F.col("r1"), chunk)))
    span = lambda low, high, k: F.explode(F.sequence(F.greatest(low, F.col(f"chunk.{k}") * chunk), F.least(high, (F.col(f"chunk.{k}") + 1) * chunk - 1)))
    grid = met.withColumn("col", span(F.col("c0"), F.col("c1"), "cx")).withColumn("row", span(F.col("r0"), F.col("r1"), "cy"))
    return grid.where(geo.in_rings(F.col("rings"), left + (F.col("col") + 0.5) * size, top - (F.col("row") + 0.5) * size)).select("row", "col").distinct()


def measured_and_filled(pixels: DataFrame, blobs: DataFrame, left: float = 0.0, top: float = 0.0, size: float = 1.0, least_height: float = MIN_CROWN_HEIGHT, least_area: float = MIN_CROWN_AREA) -> DataFrame:
    """(rings, height_m, area, height_source): measured crowns of pixels(row, col, value), and what blobs(rings) cover and no measured pixel does, at the height that half of the measured area lies below."""
    measured = stored(crown_polygons(pixels, left, top, size, least_height, least_area))
    left_over = overlay(burnt_in_chunks(blobs, left, top, size), pixels.where(F.col("value") >= least_height))
    shapes = traced(label(left_over, diagonal=False).select("label", "row", "col"), ["label"], left, top, size, least_area)
    height = quality.weighted_median(measured, [], "height_m", "area").first()[0]
    return measured.unionByName(shapes.select("rings", F.lit(height).alias("height_m"), "area", F.lit("canopy_model").alias("height_source")))


def cell_centres(polygons: DataFrame, size: float = CELL) -> DataFrame:
    """(polygon_id, x, y): the lattice points inside each polygon(polygon_id, rings)."""
    xs, ys = F.transform(F.flatten("rings"), lambda p: p["x"]), F.transform(F.flatten("rings"), lambda p: p["y"])
    steps = lambda v: F.explode(F.sequence(F.floor(F.array_min(v) / size).cast("long"), F.ceil(F.array_max(v) / size).cast("long")))
    grid = polygons.withColumn("i", steps(xs)).withColumn("j", steps(ys))
    return grid.withColumn("x", (F.col("i") + 0.5) * size).withColumn("y", (F.col("j") + 0.5) * size).where(geo.in_rings(F.col("rings"), F.col("x"), F.col("y"))).select("polygon_id", "x", "y")


def round_cells(polygons: DataFrame, size: float = CELL) -> DataFrame:
    """Each lattice cell of canopy as a round crown of the cell's area."""
    return cell_centres(polygons, size).select(F.array(geo.crown(F.col("x"), F.col("y"))).alias("rings"), F.lit(TREE_HEIGHT).alias("height_m"), F.lit("canopy_model").alias("height_source"))


def tree_crowns(trees: DataFrame, radius: float) -> DataFrame:
    """Points and rows of trees as crowns: a crown at every corner, and every two radii along a row."""
    s = trees.select(F.posexplode(geo.segments(F.col("coords"))).alias("i", "s"), "coords")
    size = F.coalesce(geo.hypot(F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y")), F.lit(0.0))
    at = F.explode(F.sequence(F.lit(0), F.ceil(size / (2 * radius)).cast("int")))
    n = F.greatest(F.ceil(size / (2 * radius)), F.lit(1))
    p = s.select("s", at.alias("k"), n.alias("n"))
    share = F.col("k") / F.col("n")
    on = lambda c: F.col(f"s.a.{c}") + F.coalesce(share * (F.col(f"s.b.{c}") - F.col(f"s.a.{c}")), F.lit(0.0))
    return p.select(F.array(geo.crown(on("x"), on("y"), radius)).alias("rings"), F.lit(TREE_HEIGHT).alias("height_m"), F.lit("tree_default").alias("height_source"))


def burn(polygons: DataFrame, size: float) -> DataFrame:
    """(row, col) of pixels whose centre lies in a polygon(polygon_id, rings)."""
    c = cell_centres(polygons, size)
    return c.select(F.floor(F.col("y") / size).cast("int").alias("row"), F.floor(F.col("x") / size).cast("int").alias("col")).distinct()


def casters(buildings: DataFrame, trees: DataFrame, canopy: DataFrame, date) -> DataFrame:
    """What casts shadows on a date: buildings always, trees and canopy in leaf."""
    cols = ["rings", "height_m", "height_source"]
    green = trees.select(cols).unionByName(canopy.select(cols)).where(leaf_on(F.lit(date).cast("date")))
    return buildings.select(cols).unionByName(green)


def is_soft(source) -> F:
    return source.isin(CANOPY_SOURCES)


def best_scene(scenes: DataFrame, most_cloud: float = 5.0) -> DataFrame:
    """The clearest scene below a share of cloud."""
    return scenes.where(F.col("cloud") < most_cloud).agg(F.min_by("scene", F.struct("cloud", "scene")).alias("scene"))
