"""Unions, differences and rings against areas and points that are known otherwise."""

import math
import random

import pytest

from heliospark.functions import geo
from heliospark.operators import overlay, shade

RINGS = geo.RINGS


def ring(*points):
    return [(float(x), float(y)) for x, y in (*points, points[0])]


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def frame(spark, rows):
    return spark.createDataFrame(rows, f"stamp int, soft boolean, rings {RINGS}")


def inside(rings, x, y):
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:], strict=False):
            if (ay > y) != (by > y) and x < (ax - bx) * (y - by) / (ay - by) + bx:
                odd = not odd
    return odd


def met(spark, rows, **how):
    out = overlay.layers(frame(spark, rows), **how).collect()
    by = {}
    for r in out:
        by.setdefault((r["stamp"], r["kind"]), []).append(([(p["x"], p["y"]) for p in r["ring"]], r["area"]))
    return by


def areas(by, stamp=0):
    return {k: round(sum(a for _, a in v), 6) for (s, k), v in by.items() if s == stamp}


def agree(by, rows, points, stamp=0):
    """Each point is in the region that the parts say."""
    for x, y in points:
        solid = any(inside(r, x, y) for s, soft, r in rows if s == stamp and not soft)
        soft = any(inside(r, x, y) for s, soft, r in rows if s == stamp and soft)
        got = {k: inside([r for r, _ in by.get((stamp, k), [])], x, y) for k in ("solid", "soft")}
        assert got == {"solid": solid, "soft": soft and not solid}, (x, y)


def test_boxes(spark):
    rows = [(0, False, [box(0, 0, 10, 10)]), (0, False, [box(5, 5, 15, 15)]), (0, False, [box(15, 0, 20, 15)]), (0, True, [box(-5, 2, 30, 4)]), (1, True, [box(0, 0, 200, 1)]), (1, True, [box(0, 0, 200, 1)])]
    by = met(spark, rows, tile=8.0)
    assert areas(by) == {"solid": 250.0, "soft": 2 * 5 + 2 * 5 + 2 * 10} and areas(by, 1) == {"soft": 200.0}
    assert sorted(len(v) for v in by.values()) == [1, 1, 3]
    assert len(by[(1, "soft")][0][0]) == 5  # corners on straight lines are gone


def test_a_frame_keeps_its_hole(spark):
    rows = [(0, False, [box(0, 0, 30, 5)]), (0, False, [box(0, 25, 30, 30)]), (0, False, [box(0, 5, 5, 25)]), (0, False, [box(25, 5, 30, 25)]), (0, False, [box(10, 10, 12, 12)])]
    by = met(spark, rows)
    assert sorted(round(a, 6) for _, a in by[(0, "solid")]) == [-400.0, 4.0, 900.0]
    got = overlay.union(frame(spark, rows).select("rings")).collect()
    assert sorted(len(r["rings"]) for r in got) == [1, 2]


def test_corners_that_touch_stay_apart(spark):
    by = met(spark, [(0, False, [box(0, 0, 5, 5)]), (0, False, [box(5, 5, 9, 9)])])
    assert sorted(round(a, 6) for _, a in by[(0, "solid")]) == [16.0, 25.0]


@pytest.mark.parametrize("seed,tile,most", [(1, 64.0, 96), (2, 16.0, 20), (3, 7.3, 10**9)])
def test_random_polygons(spark, seed, tile, most):
    r = random.Random(seed)
    rows = []
    for _ in range(60):
        x, y = r.uniform(-60, 60) + 671000, r.uniform(-60, 60) + 5665700
        n = r.randrange(3, 8)
        star = ring(*((x + r.uniform(2, 25) * math.cos(2 * math.pi * k / n), y + r.uniform(2, 25) * math.sin(2 * math.pi * k / n)) for k in range(n)))
        rows.append((0, r.random() < 0.5, [star]))
    by = met(spark, rows, tile=tile, most=most)
    agree(by, rows, [(r.uniform(-80, 80) + 671000, r.uniform(-80, 80) + 5665700) for _ in range(1500)])
    for v in by.values():
        for path, _ in v:
            assert path[0] == path[-1]
    solid, soft = areas(by)["solid"], areas(by)["soft"]
    both = areas(met(spark, [(0, False, x) for _, _, x in rows], tile=tile, most=most))["solid"]
    assert solid + soft == pytest.approx(both, abs=0.02)


#: A canopy outline with two holes, where it lies, its height and the sun, and the area that its shadow sweeps.
OUTLINE = [
    (50, 25), (46, 22), (45, 18), (56, 17), (58, 15), (57, 12), (59, 11), (59, 9), (56, 8), (56, 6), (60, 3), (64, 4), (65, 6), (67, 6), (70, 3), (74, 4), (75, 6), (82, 3),
    (87, 8), (84, 15), (87, 16), (88, 14), (92, 13), (97, 18), (96, 22), (92, 25), (88, 24), (87, 22), (85, 22), (82, 25), (78, 24), (77, 22), (75, 22), (72, 25), (68, 24), (67, 22),
    (65, 22), (62, 25), (58, 24), (57, 22),
]
HOLES = [[(65, 16), (68, 15), (67, 12), (64, 13)], [(75, 16), (78, 15), (77, 12), (74, 13)]]
AT, HEIGHT, ALTITUDE, AZIMUTH, SWEPT = (671000.8530857915, 5665700.725593821), 4.0, 16.24558934808859, 134.30158825956164, 1323.34


def canopy(dx=0.0):
    return [ring(*((x + AT[0] + dx, y + AT[1]) for x, y in r)) for r in (OUTLINE, *HOLES)]


def field(spark, casters, stamps):
    c = spark.createDataFrame(casters, f"rings {RINGS}, height_m double, height_source string")
    s = spark.createDataFrame(stamps, "stamp string, altitude double, azimuth double")
    return shade.shadow_layers(c, s).collect()


def total(rows, kind):
    return sum(r["area"] for r in rows if r["kind"] == kind)


def test_swept_canopy(spark):
    rows = field(spark, [(canopy(), HEIGHT, "tag")], [("a", ALTITUDE, AZIMUTH)])
    assert total(rows, "solid") == pytest.approx(SWEPT, abs=0.1)
    rings = [[(p["x"], p["y"]) for p in r["ring"]] for r in rows]
    assert all(inside(rings, AT[0] + x, AT[1] + y) for x, y in ((48, 20), (60, 20), (90, 20), (70, 10)))
    assert not inside(rings, AT[0] + 50, AT[1] + 5)


@pytest.mark.parametrize("azimuth", [0.0, 90.0, 180.0, 270.0])
def test_courtyards_and_gaps_stay_lit(spark, azimuth):
    rows = field(spark, [([box(0, 0, 100, 100), box(20, 20, 80, 80), box(200, 0, 210, 10)], 5.0, "tag")], [("a", 45.0, azimuth)])
    rings = [[(p["x"], p["y"]) for p in r["ring"]] for r in rows]
    assert not inside(rings, 50, 50) and not inside(rings, 150, 50) and inside(rings, 10, 50) and inside(rings, 205, 5)
    # outer walls grow by 5 at one side, the court shrinks by 5, the small box grows by 5
    assert total(rows, "solid") == pytest.approx(100 * 105 - 60 * 55 + 10 * 15, abs=0.01)


def test_layers_do_not_overlap_and_night_has_none(spark):
    casters = [(canopy(), HEIGHT, "tag"), (canopy(), HEIGHT, "canopy_model"), (canopy(5.0), HEIGHT, "canopy_model")]
    rows = field(spark, casters, [("a", ALTITUDE, AZIMUTH), ("n", -5.0, 10.0), ("h", 0.0, 10.0)])
    assert {r["stamp"] for r in rows} == {"a"}
    whole = total(field(spark, [(r, h, "tag") for r, h, _ in casters], [("a", ALTITUDE, AZIMUTH)]), "solid")
    assert total(rows, "solid") == pytest.approx(SWEPT, abs=0.1) and total(rows, "soft") > 0
    assert total(rows, "solid") + total(rows, "soft") == pytest.approx(whole, abs=0.05)
    assert {r["kind"] for r in field(spark, casters[1:], [("a", ALTITUDE, AZIMUTH)])} == {"soft"}
    assert {r["kind"] for r in field(spark, casters[:1], [("a", ALTITUDE, AZIMUTH)])} == {"solid"}


def test_cells_that_one_part_covers_are_known_without_a_sweep(spark):
    """A square's inner cells are all found, a notched part has none, nor has a soft one."""
    units = lambda ring: [tuple(round(v / overlay.UNIT) for v in (*a, *b)) for a, b in zip(ring, ring[1:], strict=False)]
    square = [(-5.0, -5.0), (70.0, -5.0), (70.0, 70.0), (-5.0, 70.0), (-5.0, -5.0)]
    notched = [(-5.0, -5.0), (70.0, -5.0), (70.0, 70.0), (30.0, 10.0), (-5.0, 70.0), (-5.0, -5.0)]
    box = (-5_000_000, -5_000_000, 70_000_000, 70_000_000)
    p = spark.createDataFrame([("a", False, units(square), *box), ("b", False, units(notched), *box), ("c", True, units(square), *box)], "stamp string, soft boolean, es array<struct<ax:long,ay:long,bx:long,by:long>>, x0 long, y0 long, x1 long, y1 long")
    assert {(r["stamp"], r["cx"], r["cy"]) for r in overlay.covered(p, 64_000_000).collect()} == {("a", x, y) for x in range(8) for y in range(8)}


def test_many_small_stamps_are_tiles_of_their_own(spark):
    """Stamps with few parts are swept whole, others in tiles: rings and areas are those of layers()."""
    import random

    r = random.Random(2)
    ring = lambda x, y, a, b: [[{"x": float(x), "y": float(y)}, {"x": x + a, "y": float(y)}, {"x": x + a, "y": y + b}, {"x": float(x), "y": y + b}, {"x": float(x), "y": float(y)}]]
    rows = [(k, k % 2 == 1 and j == 0, ring(r.randint(-90, 90), r.randint(-90, 90), r.uniform(5, 60), r.uniform(5, 60))) for k in range(6) for j in range(5)]
    rows += [(9, False, ring(0, 0, 700.0, 5.0)), (9, False, ring(3, 3, 5.0, 700.0))]
    parts = spark.createDataFrame(rows, "stamp long, soft boolean, rings array<array<struct<x:double,y:double>>>")
    got, want = ({(x["stamp"], x["kind"]): x["a"] for x in f(parts).groupBy("stamp", "kind").agg({"area": "sum"}).withColumnRenamed("sum(area)", "a").collect()} for f in (overlay.layers_each, overlay.layers))
    assert {k[0] for k in got} == {0, 1, 2, 3, 4, 5, 9} and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-3 for k in want)
