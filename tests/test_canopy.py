"""Canopy as polygons."""

import pytest

from heliospark.functions import geo
from heliospark.operators import canopy

PIXELS = "row int, col int, value double"


def pixels(spark, cells):
    return spark.createDataFrame([(r, c, float(v)) for (r, c), v in cells.items()], PIXELS)


def block(r0, c0, n, v):
    return {(r, c): v for r in range(r0, r0 + n) for c in range(c0, c0 + n)}


def shapes(df):
    return sorted((r["height_m"], r["area"], r["height_source"], len(r["rings"])) for r in df.collect())


def test_one_height_for_a_crown_and_none_for_specks(spark):
    cells = block(2, 3, 4, 4) | {(3, 4): 30} | {(9, 9): 12}
    got = canopy.crown_polygons(pixels(spark, cells), left=100.0, top=50.0, size=1.0)
    assert shapes(got) == [(4.0, 16.0, "chm_height", 1)]
    ring = got.first()["rings"][0]
    assert {(p["x"], p["y"]) for p in ring} == {(103.0, 48.0), (107.0, 48.0), (107.0, 44.0), (103.0, 44.0)}


def test_crowns_that_touch_in_a_corner_share_a_height(spark):
    got = canopy.crown_polygons(pixels(spark, block(0, 0, 3, 4) | block(3, 3, 3, 10)))
    assert shapes(got) == [(7.0, 9.0, "chm_height", 1)] * 2


def test_clearings_are_holes(spark):
    cells = {k: v for k, v in block(0, 0, 9, 5).items() if not (3 <= k[0] <= 5 and 3 <= k[1] <= 5)}
    got = canopy.crown_polygons(pixels(spark, cells | {(4, 4): 8.0}), least_area=1.0)
    assert shapes(got) == [(5.0, 72.0, "chm_height", 2), (8.0, 1.0, "chm_height", 1)]


def test_low_pixels_and_empty_rasters(spark):
    assert canopy.crown_polygons(pixels(spark, block(0, 0, 4, 1.9))).count() == 0
    assert canopy.crown_polygons(pixels(spark, {})).count() == 0


def test_fill_is_what_was_not_measured(spark):
    square = lambda x0, y0, x1, y1: [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]
    blobs = spark.createDataFrame([(square(0.0, 0.0, 10.0, 10.0),), (square(40.0, 0.0, 41.0, 1.0),), (square(1000.0, -600.0, 1010.0, -590.0),)], f"rings {geo.RINGS}")
    # measured: the upper half of the first blob at 8, and far away a small crown at 2
    cells = {(r, c): 8 for r in range(0, 5) for c in range(10)} | block(100, 100, 3, 2)
    got = canopy.measured_and_filled(pixels(spark, cells), blobs, top=10.0)
    assert shapes(got) == [(2.0, 9.0, "chm_height", 1), (8.0, 50.0, "canopy_model", 1), (8.0, 50.0, "chm_height", 1), (8.0, 100.0, "canopy_model", 1)]


@pytest.mark.parametrize("chunk", [4, 7, 512])
def test_chunks_join_again_at_their_borders(spark, chunk):
    star = [[(3.2, 1.1), (30.7, 8.3), (12.4, 25.9), (3.2, 1.1)]]
    blob = spark.createDataFrame([(star,)], f"rings {geo.RINGS}")
    got = {(r["row"], r["col"]) for r in canopy.burnt_in_chunks(blob, 0.0, 30.0, 1.0, chunk).collect()}
    want = {(r["row"], r["col"]) for r in canopy.burn(blob.selectExpr("0 as polygon_id", "rings"), 1.0).collect()}
    assert {(29 - r, c) for r, c in got} == want
    assert canopy.outlines(canopy.label(blob.sparkSession.createDataFrame(sorted(got), "row int, col int"), diagonal=False), ["label"]).count() == 1
