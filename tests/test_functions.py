import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from heliospark.functions import clock, exposure, geo, solar, tags, text
from heliospark.functions import format as fmt


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def values(spark, rows, ddl, *cols):
    return [r[0] if len(cols) == 1 else tuple(r) for r in spark.createDataFrame(rows, ddl).select(*cols).collect()]


def rings(*rs):
    return F.array(*[F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in r]) for r in rs])


def ring(*pts):
    return F.element_at(rings(pts), 1)


SQUARE = [(0, 0), (100, 0), (100, 100), (0, 100)]


def test_tags(spark):
    texts = ["12", "12 m", "3,5", "  7.5  ", "24m", None, "ё", "очень высокий дом", "", "0", "0 m", "0.0", "0,0"]
    got = values(spark, [(t,) for t in texts], "t string", tags.parse_numeric(F.col("t")))
    assert got == [12, 12, 3.5, 7.5, 24] + [None] * 8
    assert values(spark, [("0 m",), ("x",)], "t string", tags.parse_numeric(F.col("t"), keep_zero=True)) == [0.0, None]
    assert values(spark, [(float(a),) for a in (-1, 0, 150, 150.5, 500, 1500, 1501)], "a double", tags.size_class(F.col("a"))) == [None, None, "s", "m", "m", "l", "xl"]
    assert one(spark, tags.detail_label(tags.kind_label([F.lit("yes"), F.lit("fast_food")], "Place"), F.lit("Abai")), tags.detail_label(tags.kind_label([F.lit("no"), F.lit(None)], "Building"), F.lit(None).cast("string"))) == ("Fast food · Abai", "Building")
    assert one(spark, tags.bounded_number(F.lit(float("nan")), 0, 100), tags.bounded_number(F.lit(110.0), 0, 100), tags.bounded_number(F.lit(5.0), 0, 100)) == (None, None, 5.0)


def test_clock(spark):
    rows = [("10:00", 22.0), ("23:50", 20.0), ("23:00", 60.0)]
    assert values(spark, rows, "t string, m double", clock.clock_after(F.col("t"), F.col("m") * 60)) == ["10:22", "00:10", "00:00"]
    stamps = F.array(*map(F.lit, ["12:00", "13:00", "16:00", "16:20", "16:40", "17:00", "17:20"]))
    rows = [("12:00", 20.0), ("12:00", 90.0), ("16:00", 45.0), ("17:00", 60.0)]
    assert values(spark, rows, "t string, m double", clock.ends_in(F.col("t"), F.col("m") * 60, stamps)) == [None, "13:00", "16:40", "dark"]
    assert one(spark, clock.ends_in(F.lit("12:00"), F.lit(60.0), F.array().cast("array<string>")), clock.nearest_stamp(F.lit(750), stamps), clock.nearest_stamp(F.lit(1), F.array().cast("array<string>"))) == (None, "12:00", "12:00")
    dates = ["2026-04-30", "2026-05-01", "2026-10-13", "2026-10-31", "2026-11-01", "2026-01-01"]
    assert values(spark, [(d,) for d in dates], "d string", clock.leaf_on(F.to_date("d"))) == [False, True, True, True, False, False]
    assert values(spark, [(d,) for d in ("2026-12-01", "2026-03-01", "2026-06-01", "2026-09-01")], "d string", clock.season(F.to_date("d"))) == ["winter", "spring", "summer", "autumn"]
    assert values(spark, [(m,) for m in (0, 299, 300, 420, 660, 840, 1080, 1230)], "m int", clock.period(F.col("m"))) == ["night", "night", "dawn", "morning", "midday", "afternoon", "evening", "night"]
    assert len(one(spark, clock.slider_times(stamps))[0]) == 27
    assert one(spark, clock.is_daylight(F.lit("16:20"), stamps), clock.is_daylight(F.lit("16:21"), stamps), clock.is_daylight(F.lit("x"), F.lit(None).cast("array<string>"))) == (True, False, True)
    assert one(spark, clock.pretty_date(F.lit(dt.date(2026, 9, 13))), clock.stamp_file_stem(F.lit("06:20"))) == ("13 Sep 2026", "0620")


def test_formats(spark):
    assert values(spark, [(24.0,), (118.0,), (1420.0,), (970573.0,)], "m double", fmt.roughly(F.col("m"))) == ["20 m", "120 m", "1.4 km", "971 km"]
    assert one(spark, fmt.percent(F.lit(0.705)), fmt.metres(F.lit(999.4)), fmt.metres(F.lit(1234.0)), fmt.minutes(F.lit(3600.0)), fmt.minutes(F.lit(3900.0)), fmt.minutes(F.lit(90.0))) == ("71%", "999 m", "1.23 km", "1 h", "1 h 05", "2 min")


def test_geometry(spark):
    c = [F.lit(v) for v in (51.1605, 71.4704)]
    north, east = one(spark, geo.haversine(*c, F.lit(51.1705), c[1]), geo.haversine(*c, c[0], F.lit(71.4804)))
    assert north == pytest.approx(1111.95, abs=0.01) and east == pytest.approx(697.35, abs=0.05)
    assert one(spark, geo.quadkey(*c, 9), geo.quadkey(F.lit(51.2953), c[1], 9)) == ("121302123", "121302121")
    p = one(spark, geo.to_utm(*c))[0]
    back = one(spark, geo.from_utm(F.lit(p["x"]), F.lit(p["y"])))[0]
    assert back["lat"] == pytest.approx(51.1605, abs=1e-9) and back["lon"] == pytest.approx(71.4704, abs=1e-9)
    q = one(spark, geo.to_utm(F.lit(51.1705), c[1]))[0]
    assert math.hypot(q["x"] - p["x"], q["y"] - p["y"]) == pytest.approx(1112.5, abs=1.5)
    hole = [(20, 20), (80, 20), (80, 80), (20, 80)]
    yard = rings(SQUARE, hole)
    assert one(spark, geo.polygon_area(yard), geo.ring_area(ring(*SQUARE)), geo.in_rings(yard, F.lit(50.0), F.lit(50.0)), geo.in_rings(yard, F.lit(10.0), F.lit(50.0))) == (6400.0, 10000.0, False, True)
    ctr = one(spark, geo.ring_centroid(ring((0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3))))[0]
    assert (ctr["x"], ctr["y"]) == pytest.approx((1.1, 1.1))
    assert one(spark, geo.distance_to_polygon(yard, F.lit(150.0), F.lit(50.0)), geo.distance_to_polygon(yard, F.lit(5.0), F.lit(50.0)), geo.distance_to_polygon(yard, F.lit(50.0), F.lit(50.0))) == (50.0, 0.0, 30.0)
    line = ring((0, 0), (30, 0), (30, 10))
    mid = one(spark, geo.line_at(line, 0.5))[0]
    assert one(spark, geo.line_length(line))[0] == 40.0 and (mid["x"], mid["y"]) == (20.0, 0.0)
    cr = geo.crown(F.lit(5.0), F.lit(5.0))
    assert one(spark, geo.ring_area(cr), F.size(cr)) == (pytest.approx(100.0), 17)
    assert one(spark, geo.block(F.lit(-1.0), F.lit(2500.0)))[0] == "-1_2"
    merged = one(spark, geo.merge_lines(F.array(line, ring((30, 10), (40, 10)))))[0]
    assert [(p["x"], p["y"]) for p in merged] == [(0, 0), (30, 0), (30, 10), (40, 10)]
    found = one(spark, geo.footprint_at(F.array(rings([(0, 0), (1, 0), (1, 1)]), yard), F.lit(50.0), F.lit(50.0)))[0]
    assert len(found) == 2  # only the outer ring counts


def test_sun(spark):
    s = one(spark, solar.sun_position(F.lit(dt.date(2026, 10, 24)), F.lit(540)))[0]
    assert s["altitude"] == pytest.approx(16.24558934808859, abs=0.02) and s["azimuth"] == pytest.approx(134.30158825956164, abs=0.02)
    days = [(dt.date(2026, 9, 13), 24), (dt.date(2026, 6, 21), 29)]
    assert values(spark, [(d,) for d, _ in days], "d date", F.size(solar.daylight_minutes(F.col("d")))) == [n for _, n in days]
    m = one(spark, solar.daylight_minutes(F.lit(dt.date(2026, 9, 13))))[0]
    assert (m[0], m[-1]) == (360, 1100)
    v = one(spark, solar.shadow_vector(F.lit(5.0), F.lit(45.0), F.lit(90.0)), solar.shadow_vector(F.lit(5.0), F.lit(0.0), F.lit(90.0)), solar.shadow_vector(F.lit(500.0), F.lit(10.0), F.lit(180.0)))
    assert (v[0]["dx"], v[0]["dy"]) == pytest.approx((-5.0, 0.0)) and v[1] is None and v[2]["dy"] == pytest.approx(300.0)
    assert one(spark, solar.sun_angle(51.1605, F.lit(23.44)))[0]["altitude"] == pytest.approx(62.2795)


def test_names(spark):
    rows = ["проспект Қабанбай Батыр", "  Әл-Фараби,  ", "Кабанбай батыр"]
    assert values(spark, [(t,) for t in rows], "t string", text.fold(F.col("t"))) == ["кабанбай батыр", "ал фараби", "кабанбай батыр"]
    assert values(spark, [(t,) for t in ("Байтерек", "Khan Shatyr", "Хан Шатыр")], "t string", text.latinise(F.col("t"))) == ["baiterek", "han shatir", "han shatir"]
    assert one(spark, text.fold(F.lit("a_b")), text.fold(F.lit("a_b"), text.DROP_UNDERSCORE)) == ("a_b", "a b")
    assert one(spark, text.search_keys(F.lit("Brand#17"), F.array(F.lit("brand 17"), F.lit(None), F.lit("Хан")), text.latinise))[0] == "brand 17 han"


def test_costs_and_policy(spark):
    got = values(spark, [(4.0, 0.0), (-4.0, 0.0), (4.0, 1.0), (-4.0, 1.0), (0.0, 0.3)], "a double, s double", exposure.edge_cost(F.lit(100.0), F.col("s"), F.col("a")))
    assert got == [500.0, 100.0, 100.0, 500.0, 100.0]
    rows = [("2026-10-01", -5.0, 0.0, 0.0), ("2026-10-01", 32.0, 0.0, 0.0), ("2026-04-01", 18.0, 0.0, 0.0), ("2026-10-01", 4.0, 95.0, 0.0), ("2026-10-01", 30.0, 0.0, 0.5), ("2026-01-01", 32.0, 0.0, 9.0), ("2026-07-01", -5.0, 99.0, 0.0), ("2026-09-01", None, None, None), ("2026-10-01", None, None, None), ("2026-10-01", 12.0, 0.0, 0.0)]
    p = exposure.preference(F.to_date("d"), F.col("f"), F.col("c"), F.col("r"))
    got = [(r["mode"], r["reason"], r["alpha"]) for r in values(spark, rows, "d string, f double, c double, r double", p)]
    assert [g[:2] for g in got] == [("sun", "cold"), ("shade", "warm"), ("balanced", "comfortable"), ("balanced", "overcast"), ("balanced", "precipitation"), ("sun", "winter"), ("shade", "summer"), ("shade", "seasonal_fallback"), ("sun", "seasonal_fallback"), ("sun", "cold")]
    assert got[0][2] == -6.0 and got[1][2] == pytest.approx(2 + 10 / 3) and got[9][2] == -2.0
    pub = one(spark, exposure.public_preference(exposure.preference(F.lit(dt.date(2026, 10, 1)), F.lit(4.0), F.lit(0.0), F.lit(0.0))))[0].asDict()
    assert "alpha" not in pub and pub["provider"] == "forecast"
    assert one(spark, exposure.gain(F.lit(0.7), F.lit(0.4), F.lit("shade")), exposure.gain(F.lit(0.7), F.lit(0.4), F.lit("sun")), exposure.gain(F.lit(0.7), F.lit(0.4), F.lit("balanced"))) == (pytest.approx(0.3), pytest.approx(-0.3), 0.0)


def test_points_inside(spark):
    import math
    import random

    from heliospark.functions import geo

    r = random.Random(3)
    rows = []
    for _ in range(60):
        n = r.randint(3, 12)
        star = [(math.cos(2 * math.pi * i / n) * (d := r.uniform(0.1, 9)), math.sin(2 * math.pi * i / n) * d) for i in range(n)]
        rows.append(([star + star[:1]],))
    rows.append(([[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)], [(1.0, 1.0), (8.0, 1.0), (8.0, 8.0), (1.0, 8.0), (1.0, 1.0)]],))
    df = spark.createDataFrame(rows, "rings array<array<struct<x:double,y:double>>>").withColumn("p", geo.point_inside(F.col("rings")))
    assert all(x["i"] for x in df.select(geo.in_rings(F.col("rings"), F.col("p.x"), F.col("p.y")).alias("i")).collect())
    flat = spark.createDataFrame([([[(0.0, 1.0), (5.0, 1.0), (0.0, 1.0)]],)], "rings array<array<struct<x:double,y:double>>>")
    assert flat.select(geo.point_inside(F.col("rings")).alias("p")).first()["p"] is None


def test_daylight_of_many_dates(spark):
    import datetime as dt

    from heliospark.functions import solar

    days = spark.createDataFrame([(dt.date(2026, 1, 5),), (dt.date(2026, 6, 21),), (None,)], "day date")
    got = sorted((r["day"], r["minute"]) for r in solar.daylight(days, "day").collect())
    want = sorted((r["day"], r["m"]) for r in days.where("day is not null").select("day", F.explode(solar.daylight_minutes(F.col("day"))).alias("m")).collect())
    assert got == want and got
