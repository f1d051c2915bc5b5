import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliospark.functions.solar import shadow_vector  # noqa: F401
from heliospark.operators import advice, canopy, heights, intervals, near, places, quality, shade, survey, walks

B = "id long, tag string, bin string, x double, y double, levels double, tag_height double, override_levels double"


def pt(x, y):
    return (float(x), float(y))


def box(x0, y0, x1, y1):
    return [[pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0)]]


RINGS = "array<array<struct<x:double,y:double>>>"
LINE = "array<struct<x:double,y:double>>"


def test_heights_of_a_microdistrict(spark):
    rows = [(i, "apartments", "l", 200.0 * i + 20, 325.0, 9.0, None, None) for i in range(8)]
    rows += [(100 + i, "garage", "s", 60.0 * i + 5, 5.0, 1.0, None, None) for i in range(24)]
    rows += [(500, "yes", "l", 720.0, 320.0, None, None, None), (501, "yes", "l", 720.0, 320.0, None, 31.0, None), (502, "yes", "l", 720.0, 320.0, None, 31.0, 2.0), (503, "yes", "m", 0.0, 0.0, None, None, None)]
    got = {r["id"]: (round(r["height_m"], 6), r["height_source"]) for r in heights.with_height(spark.createDataFrame(rows, B)).collect()}
    assert got[500] == (28.8, "neighbour") and got[501] == (31.0, "tag") and got[502] == (6.4, "override") and got[0] == (28.8, "levels")
    assert got[503][1] == "neighbour" and got[503][0] == 3.2  # no neighbour of its size: those of any
    alone = spark.createDataFrame([(1, "a", "m", 0.0, 0.0, None, None, None)], B)
    assert tuple(heights.with_height(alone).first())[-2:] == (3.2, "fallback")
    three = spark.createDataFrame([(i, "a", "m", 50.0 * i, 0.0, 7.0 if i == 0 else None, None, None) for i in range(3)], B)
    assert [round(r["height_m"], 6) for r in heights.with_height(three).orderBy("id").collect()] == [22.4] * 3
    assert heights.with_height(alone.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_nearest_k_like_all_pairs(spark, seed):
    r = random.Random(seed)
    q = [(i, r.uniform(-500, 500), r.uniform(-50, 900)) for i in range(60)]
    s = [(i, float(r.choice([0, 3, 400, r.randint(0, 300)])), float(r.randint(0, 90))) for i in range(45)]
    got = {}
    for x in near.nearest_k(spark.createDataFrame(q, "query_id long, x double, y double"), spark.createDataFrame(s, "source_id long, sx double, sy double"), 4, 25.0).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["source_id"]))
    for i, x, y in q:
        want = sorted(((x - sx) ** 2 + (y - sy) ** 2, j) for j, sx, sy in s)[:4]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]


def test_nearest_one(spark):
    nodes = spark.createDataFrame([(7, 0.0, 0.0, 0), (8, 100.0, 0.0, 1), (9, 100.0, 0.0, 2)], "node_id long, x double, y double, pos int")
    got = near.nearest_one(spark.createDataFrame([(1, 50.0, 0.0), (2, 390.0, 0.0), (3, 401.0, 0.0)], "point_id long, x double, y double"), nodes, 300.0).orderBy("point_id").collect()
    assert [r["node_id"] for r in got] == [7, 8, None] and got[1]["away"] == 290.0 and "from the nearest mapped" in got[2]["reason"]


def test_grid_join_like_all_pairs(spark):
    r = random.Random(3)
    boxes = lambda n: [(i, *(lambda x, y: (x, y, x + r.uniform(0, 90), y + r.uniform(0, 90)))(r.uniform(-200, 200), r.uniform(-200, 200))) for i in range(n)]
    a, b = boxes(60), boxes(60)
    got = near.grid_join(spark.createDataFrame(a, "a long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(b, "b long, r_x0 double, r_y0 double, r_x1 double, r_y1 double"), 32.0).select("a", "b").collect()
    want = sorted((i[0], j[0]) for i in a for j in b if i[1] <= j[3] and j[1] <= i[3] and i[2] <= j[4] and j[2] <= i[4])
    assert sorted(map(tuple, got)) == want


def test_union_length_like_sampling(spark):
    r = random.Random(1)
    rows = [(k, a, a + r.randint(0, 9)) for k in range(5) for a in [r.randint(0, 40) for _ in range(8)]]
    got = {x["k"]: x["covered"] for x in intervals.union_length(spark.createDataFrame(rows, "k int, t0 int, t1 int"), ["k"]).collect()}
    assert got == {k: len({t for j, a, b in rows if j == k for t in range(a, b)}) for k in range(5)}


def scored(spark, edges, boxes, soft=()):
    e = spark.createDataFrame([(i, [pt(*a), pt(*b)]) for i, (a, b) in enumerate(edges)], f"edge_id long, coords {LINE}")
    parts = spark.createDataFrame([("12:00", s, box(*b)) for s, bs in ((False, boxes), (True, soft)) for b in bs], f"stamp string, soft boolean, rings {RINGS}")
    stamps = spark.createDataFrame([("12:00",)], "stamp string")
    return [round(r["shade"], 6) for r in shade.score(e, shade._boxed(parts), stamps).orderBy("edge_id").collect()]


def test_scoring(spark):
    a, b = ((0, 0), (100, 0)), ((0, 50), (100, 50))
    assert scored(spark, [a], [(0, -5, 50, 5)]) == [0.5]
    assert scored(spark, [a, b], [(0, -5, 30, 5), (70, -5, 100, 5)]) == [0.6, 0.0]
    assert scored(spark, [a], []) == [1.0]
    assert scored(spark, [a, b, ((0, 100), (100, 100))], [(0, -5, 25, 5), (0, 45, 50, 55), (0, 95, 75, 105)]) == [0.25, 0.5, 0.75]
    assert scored(spark, [a], [(0, -5, 50, 5)], soft=[(25, -5, 100, 5)]) == [pytest.approx(0.85)]
    assert scored(spark, [a], [(20, 0, 60, 5)]) == [0.4]  # along a boundary
    assert scored(spark, [((500, 500), (501, 501))], [(0, 0, 1, 1)]) == [0.0]


def test_swept_shadows_like_sampling(spark):
    hole = [pt(20, 20), pt(80, 20), pt(80, 80), pt(20, 80), pt(20, 20)]
    yard = [box(0, 0, 100, 100)[0], hole]
    casters = spark.createDataFrame([(yard, 5.0, "tag"), (box(200, 0, 210, 10), 5.0, "tag")], f"rings {RINGS}, height_m double, height_source string")
    for azimuth in (0, 90, 134.3, 270):
        stamps = spark.createDataFrame([("t", 45.0, float(azimuth))], "stamp string, altitude double, azimuth double")
        dx, dy = (5 * f(math.radians(azimuth + 180)) for f in (math.sin, math.cos))
        inside = lambda x, y: (0 <= x <= 100 and 0 <= y <= 100 and not (20 < x < 80 and 20 < y < 80)) or (200 <= x <= 210 and 0 <= y <= 10)
        lines = [((-20, 13.3), (230, 41.7)), ((37.3, -20), (61.9, 130)), ((40, 50), (60, 50)), ((150, 50), (160, 50)), ((-3, -8), (103, 107))]
        e = spark.createDataFrame([(i, [pt(*a), pt(*b)]) for i, (a, b) in enumerate(lines)], f"edge_id long, coords {LINE}")
        got = [r["shade"] for r in shade.score(e, shade.shadow_parts(casters, stamps), stamps).orderBy("edge_id").collect()]
        for (a, b), g in zip(lines, got, strict=True):
            n = 4000
            dark = sum(any(inside(x - k * dx / 60, y - k * dy / 60) for k in range(61)) for x, y in ((a[0] + (b[0] - a[0]) * (i + 0.5) / n, a[1] + (b[1] - a[1]) * (i + 0.5) / n) for i in range(n))) / n
            assert g == pytest.approx(dark, abs=0.004)
        assert got[2] == 0.0 and got[3] == 0.0
    night = spark.createDataFrame([("t", -1.0, 0.0)], "stamp string, altitude double, azimuth double")
    assert shade.shadow_parts(casters, night).count() == 0


def test_streets_meet_only_what_still_adds_shade(spark, monkeypatch):
    """Lots give what all parts at once give, and where shadows lie many times over each other few of them meet a street."""
    r = random.Random(5)
    houses = [(box(x, y, x + r.uniform(8, 20), y + r.uniform(8, 20)), r.uniform(9, 20), r.choice(["tag", "tag", "canopy_model"])) for x, y in ((r.uniform(0, 60), r.uniform(0, 60)) for _ in range(300))]
    houses += [(box(x, 100, x + 5, 105), 4.0, h) for x, h in ((0, "tag"), (3, "canopy_model"), (20, "canopy_model"))]
    casters = spark.createDataFrame(houses, f"rings {RINGS}, height_m double, height_source string")
    lines = [((5, 5), (50, 20)), ((30, 60), (30, 2)), ((-40, 10), (60, 12)), ((-5, 102), (40, 103)), ((60, 60), (80, 90)), ((3, 3), (3, 3))]
    e = spark.createDataFrame([(i, [pt(*a), pt(*b)]) for i, (a, b) in enumerate(lines)], f"edge_id long, coords {LINE}")
    stamps = spark.createDataFrame([("a", 45.0, 134.3), ("c", -1.0, 0.0)], "stamp string, altitude double, azimuth double")
    joined, met = shade.grid_join, []
    monkeypatch.setattr(shade, "grid_join", lambda *a: (out := joined(*a), met.append(out.count()))[0])
    got = [{(x["stamp"], x["edge_id"]): x["shade"] for x in shade.score(e, shade.shadow_parts(casters, stamps), stamps, first=n).collect()} for n in (1 << 40, 48)]
    assert got[0] == pytest.approx(got[1], abs=1e-6) and len(got[0]) == 12
    assert got[0]["a", 0] == 1.0 and 0 < got[0]["a", 2] < 1 and 0 < got[0]["a", 3] < 1 and got[0]["c", 4] == 1.0
    assert len(met) > 6 and sum(met[3:]) < sum(met[:3]) / 2


def table_of(spark, times):
    rows = [(i, int(t[:2]) * 60 + int(t[3:])) for i, t in enumerate(times)]
    return {r["minute"]: r["stamp_idx"] for r in walks.clock_table(spark.createDataFrame(rows, "stamp_idx int, minute int")).collect()}


def test_clock_table(spark):
    t = table_of(spark, ["06:00", "06:20", "06:40", "12:00", "18:00"])
    assert [t[m] for m in (360, 369, 371, 719, 900, 349, 350, 1440)] == [0, 0, 1, 3, 4, 5, 0, 5] and len(t) == 1441 and t[370] == 1
    t = table_of(spark, ["12:00"])
    assert (t[689], t[690], t[750], t[751]) == (1, 0, 0, 1)


def day(rows, base=3831 / 1.35):
    return [(1, i, t, m, d, s, b, base) for i, (t, m, d, s, b) in enumerate(rows)]


D = "day int, pos int, time string, mode string, duration_s double, shade_fraction double, baseline_shade_fraction double, baseline_duration_s double"


def test_verdicts(spark):
    got = lambda rows, base=3831 / 1.35: advice.verdict(spark.createDataFrame(day(rows, base), D), ["day"]).first()
    long = 4200 / 1.35
    sept = [("06:00", "shade", long, 0.97, 0.94), ("07:00", "shade", long, 0.88, 0.68), ("12:00", "shade", long, 0.57, 0.41), ("15:00", "shade", long, 0.71, 0.46), ("18:20", "shade", long, 0.99, 0.98)]
    r = got(sept)
    assert (r["best_time"], round(r["best_share"], 9), round(r["best_gain"], 9)) == ("15:00", 0.71, 0.25)
    r = got([("08:00", "shade", 1000 + 1200.0, 0.8, 0.3), ("12:00", "shade", 1060.0, 0.65, 0.45)], 1000.0)
    assert (r["best_time"], r["extra_s"], r["payoff_time"], round(r["payoff_gain"], 9)) == ("12:00", 60.0, "08:00", 0.5)
    r = got([("08:00", "sun", 1000.0, 0.7, 0.72), ("12:00", "sun", 1000.0, 0.2, 0.5), ("15:00", "sun", 1000.0, 0.4, 0.55)], 1000.0)
    assert (r["best_time"], round(r["best_share"], 9), round(r["best_gain"], 9)) == ("12:00", 0.8, 0.3)
    r = got([("08:00", "balanced", 1100.0, 0.7, 0.2), ("12:00", "balanced", 1000.0, 0.2, 0.5), ("15:00", "balanced", 1000.0, 0.4, 0.55)], 1000.0)
    assert (r["best_time"], r["best_share"], r["best_gain"]) == ("12:00", None, 0.0)
    r = got([("08:00", "shade", 1180.0, 0.504, 0.5), ("12:00", "shade", 1000.0, 0.5, 0.5)], 1000.0)
    assert (r["best_time"], r["has_useful_detour"]) == ("12:00", False)
    assert got([("17:40", "shade", 1000.0, 0.9, 0.5), ("18:00", "shade", 1000.0, 0.9, 0.5)], 1000.0)["best_time"] == "17:40"
    assert advice.verdict(spark.createDataFrame([], D), ["day"]).count() == 0


def test_verdict_like_a_loop(spark):
    r = random.Random(4)
    rows = [(k, i, f"{i:02d}:00", r.choice(["sun", "shade", "balanced"]), r.choice([900.0, 1000.0, 1300.0]), r.randint(0, 20) / 20, r.randint(0, 20) / 20, 1000.0) for k in range(200) for i in range(r.randint(1, 9))]
    got = {x["day"]: (x["best_time"], x["payoff_time"]) for x in advice.verdict(spark.createDataFrame(rows, D), ["day"]).collect()}
    for k in range(200):
        own = [x for x in rows if x[0] == k]
        gain = lambda x: {"sun": x[6] - x[5], "shade": x[5] - x[6]}.get(x[3], 0.0)
        worth = lambda x: gain(x) / (1 + max(x[4] - 1000, 0) / 60)
        best = None
        for x in [x for x in own if gain(x) >= 0.005] or own:
            useful = any(gain(y) >= 0.005 for y in own)
            if best is None or (useful and (worth(x) - worth(best) > 1e-9 or abs(worth(x) - worth(best)) <= 1e-9 and x[4] < best[4])) or (not useful and x[4] < best[4]):
                best = x
        top = max(own, key=lambda x: (gain(x), -x[1]))
        assert got[k] == (best[2], top[2])


def test_chart(spark):
    r = advice.chart(spark.createDataFrame(day([("06:00", "shade", 1.0, 1.0, 0.0), ("12:00", "shade", 1.0, 0.0, 0.0)]), D), ["day"]).first()
    assert r["line"] == "5.0,5.0 277.0,81.0" and r["area"] == "5.0,86 5.0,5.0 277.0,81.0 277.0,86" and r["direction"] == "shade"
    assert [(b["x"], b["width"]) for b in r["bands"]] == [(0.0, 141.0), (141.0, 141.0)]
    r = advice.chart(spark.createDataFrame(day([("06:00", "sun", 1.0, 1.0, 0.0)]), D), ["day"]).first()
    assert r["xs"] == [141.0] and r["direction"] == "sun"


def entries(spark, rows):
    return places.entries(spark.createDataFrame(rows, "src_rank int, pos long, name string, detail string, lat double, lon double, aliases array<string>"))


def test_ranking_and_map_places(spark):
    rows = [(0, 0, "Кабанбай Батыр", "Street", 51.1, 71.4, None), (0, 1, "Абай", "Street", 51.1, 71.4, None), (1, 2, "Мега Силк Вей", "Mall", 51.1, 71.4, None), (1, 3, "Мега", "Mall", 51.1, 71.4, ["Mega"])]
    asked = spark.createDataFrame([("аб",), ("мега",), ("...",), ("kaban",)], "query string")
    got = {}
    for x in places.rank(entries(spark, rows), asked).orderBy("query", "rank").collect():
        got.setdefault(x["query"], []).append(x["n"])
    assert got == {"аб": ["Абай", "Кабанбай Батыр"], "мега": ["Мега", "Мега Силк Вей"], "kaban": ["Кабанбай Батыр"]}
    rows = [(0, 0, "Abai", "Street", 51.1, 71.4, None), (1, 1, " Kofe ", "Cafe · Abai", 51.1, 71.4, None), (1, 2, "X", "Castle", 51.1, 71.4, None), (1, 3, "Y", "Clinic", 51.1, 71.4, None), (1, 4, "  ", "Cafe", 51.1, 71.4, None), (1, 5, "Z", "Cafe", 91.0, 71.4, None),
            (1, 6, "Байтерек", "Monument", 51.1283, 71.4305, None), (1, 7, "Baiterek", "Station", 51.1283, 71.4305, None), (1, 8, "Хан Шатыр", "Mall", 51.2, 71.404, None)]
    m = {x["id"]: x for x in places.map_places(entries(spark, rows)).collect()}
    assert set(m) == {1, 2, 3, 6, 7, 8}
    short = lambda i: (m[i]["name"], m[i]["category"], m[i]["priority"], m[i]["min_zoom"])
    assert short(1) == ("Kofe", "cafe", 4, 14.0) and short(2)[1:] == ("building", 7, 17.0) and short(3)[1:] == ("hospital", 3, 14.0)
    assert short(6) == ("Baiterek", "landmark", 0, 11.5) and m[6]["icon"] == "landmark-baiterek" and short(7)[1] == "transit" and short(8)[1] == "mall"


def test_dedupe_like_a_loop(spark):
    r = random.Random(6)
    rows = [(i, r.choice("abc"), 51 + r.random() / 300, 71 + r.random() / 300) for i in range(300)]
    got = sorted(x["entry"] for x in places.dedupe(spark.createDataFrame(rows, "entry long, c string, lat double, lon double")).collect())
    kept = []
    for i, c, a, o in rows:
        if not any(k[1] == c and math.hypot((a - k[2]) * 111320, (o - k[3]) * 111320 * math.cos(math.radians(a))) <= 80 for k in kept):
            kept.append((i, c, a, o))
    assert got == [k[0] for k in kept]


def test_street_entries(spark):
    rows = [(0, "A", [pt(0, 0), pt(10, 0)]), (1, "A", [pt(0, 0), pt(0, 10)]), (2, "A", [pt(0, 0), pt(3, 0)]), (3, None, [pt(0, 0), pt(99, 0)])]
    assert [tuple(r) for r in places.street_entries(spark.createDataFrame(rows, f"pos long, name string, coords {LINE}")).collect()] == [("A", 5.0, 0.0)]


def test_analytics_like_loops(spark):
    r = np.random.default_rng(2)
    rows = [(i, int(r.integers(0, 2)), float(r.integers(0, 30)) / 30, float(r.integers(1, 50))) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, y int, s double, w double")
    pos, neg = [x[2] for x in rows if x[1]], [x[2] for x in rows if not x[1]]
    assert quality.roc_auc(df, "y", "s").first()[0] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
    ap, tp, n = 0.0, 0, 0
    for s in sorted({x[2] for x in rows}, reverse=True):
        own = [x[1] for x in rows if x[2] == s]
        tp, n = tp + sum(own), n + len(own)
        ap += sum(own) * tp / n
    assert quality.average_precision(df, "y", "s").first()[0] == pytest.approx(ap / len(pos))
    run = {x["id"]: x["running"] for x in quality.cumulative(df, "w", "id", F.col("w")).collect()}
    total = 0.0
    for x in sorted(rows, key=lambda x: (-x[3], x[0])):
        total += x[3]
        assert run[x[0]] == pytest.approx(total)
    wm = lambda rs: [x["weighted_median"] for x in quality.weighted_median(spark.createDataFrame(rs, "k int, v double, w double"), ["k"], "v", "w").collect()]
    assert wm([(1, 2.0, 1.0), (1, 2.0, 1.0), (1, 2.0, 1.0), (1, 8.0, 1.0)]) == [2.0] and wm([(1, 2.0, 1.0), (1, 2.0, 1.0), (1, 2.0, 1.0), (1, 8.0, 500.0)]) == [8.0] and wm([(1, 2.0, 0.0)]) == [0.0]
    assert quality.concentration(df.limit(0), "w", "id", [0.5]).first()["n_rows"] == 1
    assert quality.hash_sample(df, "id", 10, ["y"]).count() == 20
    assert 0.6 < df.where(quality.hash_split(F.col("id"), 0.7)).count() / 700 < 0.8


def test_cross_validation_never_sees_its_fold(spark):
    r = random.Random(9)
    rows = [(i, "t", r.choice("sml"), r.uniform(0, 4000), r.uniform(0, 4000), float(r.randint(1, 20))) for i in range(250)]
    got = quality.cross_validate(spark.createDataFrame(rows, "id long, tag string, bin string, x double, y double, levels double")).collect()
    fold = {x["id"]: x["fold"] for x in got}
    by_block = {}
    for i, _, _, x, y, _ in rows:
        by_block.setdefault((x // 1000, y // 1000), set()).add(fold[i])
    assert all(len(f) == 1 for f in by_block.values())
    for x in got[:60]:
        i, _, b, px, py, _ = rows[x["id"]]
        train = [t for t in rows if fold[t[0]] != fold[i]]
        near8 = lambda ts: np.median([t[5] for t in sorted(ts, key=lambda t: ((t[3] - px) ** 2 + (t[4] - py) ** 2, t[0]))[:8]])
        same = [t for t in train if t[2] == b]
        assert x["neighbour"] == near8(train) and x["by_size"] == near8(same)
        assert x["prior"] == np.median([t[5] for t in same]) if len(same) >= 10 else True
        assert x["mean"] == (x["prior"] + x["by_size"]) / 2


def test_crowns(spark):
    px = lambda rows: spark.createDataFrame(rows, "row int, col int, value double")
    block = [(r, c, 4.0) for r in range(2, 6) for c in range(2, 6) if (r, c) != (3, 3)] + [(3, 3, 30.0), (9, 9, 5.0)]
    assert [(x["height_m"], x["area"]) for x in canopy.crowns(px(block)).collect()] == [(4.0, 16.0)]
    touch = [(r, c, 4.0) for r in range(3) for c in range(3)] + [(r, c, 10.0) for r in range(3, 6) for c in range(3, 6)]
    got = canopy.crowns(px(touch)).collect()
    assert [x["height_m"] for x in got] == [7.0]
    assert canopy.label(px(touch), diagonal=False).select("label").distinct().count() == 2
    assert canopy.crowns(px([])).count() == 0
    snake = [(0, c, 3.0) for c in range(60)] + [(r, 59, 3.0) for r in range(60)]
    assert canopy.label(px(snake)).select("label").distinct().count() == 1
    cell = spark.createDataFrame([(1, box(0, 0, 10, 10))], f"polygon_id long, rings {RINGS}")
    (c,) = canopy.round_cells(cell).collect()
    assert (c["height_m"], c["height_source"], len(c["rings"][0])) == (4.0, "canopy_model", 17)
    assert canopy.burn(spark.createDataFrame([(1, box(0, 0, 3, 2))], f"polygon_id long, rings {RINGS}"), 1.0).count() == 6
    assert canopy.overlay(px([(0, 0, 1.0), (0, 1, 1.0)]), px([(0, 1, 9.0)])).count() == 1
    assert canopy.best_scene(spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 9.0)], "scene string, cloud double")).first()[0] == "b"
    trees = spark.createDataFrame([([pt(0, 0)],), ([pt(0, 0), pt(12, 0)],)], f"coords {LINE}")
    assert canopy.tree_crowns(trees, 3.0).count() == 4
    b = spark.createDataFrame([(box(0, 0, 1, 1), 3.0, "tag")], f"rings {RINGS}, height_m double, height_source string")
    green = canopy.round_cells(cell)
    assert canopy.casters(b, green, green, "2026-07-01").count() == 3 and canopy.casters(b, green, green, "2026-01-01").count() == 1


def test_survey(spark):
    b = spark.createDataFrame([("way", i, float(i), None if i % 2 else 5.0, 51.0, 71.0, float(i)) for i in range(10)], "osm_element string, osm_id long, area_m2 double, levels double, lat double, lon double, shadow_mass double")
    q = survey.queue(b, 3)
    assert [r["osm_id"] for r in q.collect()] == [9, 7, 5]
    a = spark.createDataFrame([("way", 9, 4.0, "s")], "osm_element string, osm_id long, levels double, source string")
    s = spark.createDataFrame([("way", 7)], "osm_element string, osm_id long")
    p = survey.progress(q, a, s).first()
    assert (p["counted"], p["skipped"], p["left"], round(p["mass_share"], 6)) == (1, 1, 1, round(9 / 21, 6))
    new = spark.createDataFrame([("way", 7, 3.0, "s"), ("way", 9, None, "s")], a.schema)
    a2, s2 = survey.answer(a, s, new)
    assert [tuple(r) for r in a2.collect()] == [("way", 7, 3.0, "s")] and [tuple(r) for r in s2.collect()] == [("way", 9)]
    with pytest.raises(ValueError, match="outside"):
        survey.answer(a, s, spark.createDataFrame([("way", 1, 81.0, "s")], a.schema))
    pos = spark.createDataFrame([("way", 9, 0), ("way", 7, 1), ("way", 5, 2)], "osm_element string, osm_id long, pos int")
    assert survey.resume_at(pos, a.select("osm_element", "osm_id").unionByName(s)).first()["pos"] == 2


def test_nearest_of_many_at_few_places(spark):
    """Copies at one place are neither met with each other nor lost, and work is of places."""
    from heliospark.operators import near

    s = [(i, float(i % 5), float(i % 3)) for i in range(3000)]
    q = [(10_000 + i, float(i % 7), float(i % 2)) for i in range(400)] + [(1, None, 0.0), (2, 1e6, 0.0)]
    sources, queries = spark.createDataFrame(s, "source_id long, sx double, sy double"), spark.createDataFrame(q, "query_id long, x double, y double")
    got = {}
    for r in near.nearest_k(queries, sources, 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["d2"], r["source_id"]))
    assert set(got) == {i for i, x, _ in q if x is not None}
    for i, x, y in q:
        if x is not None:
            want = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in s)[:4]
            assert sorted(got[i]) == [(n, d, j) for n, (d, j) in enumerate(want, 1)]
    assert near._nearest_of_places(queries.select("x", "y").distinct(), sources, 4, None, [], None).count() == 4 * 15  # 14 places and the one afar
    nodes = sources.select(F.col("source_id").alias("node_id"), (-F.col("source_id")).alias("pos"), F.col("sx").alias("x"), F.col("sy").alias("y"))
    one = {r["point_id"]: r for r in near.nearest_one(queries.withColumnRenamed("query_id", "point_id"), nodes, 1.5).collect()}
    for i, x, y in q:
        best = min((((x - a) ** 2 + (y - b) ** 2, -j) for j, a, b in s if x is not None and (x - a) ** 2 + (y - b) ** 2 <= 2.25), default=None)
        assert (one[i]["node_id"], one[i]["away"]) == ((-best[1], best[0] ** 0.5) if best else (None, None)) and (one[i]["reason"] is None) == bool(best)


def test_far_sources_are_sought_by_halved_cells(spark):
    """Places whose sources all lie far off: rings of cells around each place would be very many cells."""
    rng = np.random.default_rng(5)
    q = rng.integers(0, 600, (1000, 2))
    along, across = rng.integers(0, 1010, 20000), rng.integers(1000, 1010, 20000)
    src = np.where(np.arange(20000)[:, None] % 2 == 0, np.column_stack([along, across]), np.column_stack([across, along]))
    kind = rng.integers(0, 2, 20000)
    queries = spark.createDataFrame([(i, float(x), float(y), i % 3) for i, (x, y) in enumerate(q.tolist())], "query_id int, x double, y double, kind int")
    sources = spark.createDataFrame([(i, float(x), float(y), c) for i, ((x, y), c) in enumerate(zip(src.tolist(), kind.tolist(), strict=True))], "source_id int, sx double, sy double, kind int")
    began = time.time()
    got = {}
    for r in near.nearest_k(queries, sources, 4, on=["kind"]).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["source_id"], r["d2"]))
    assert time.time() - began < 120
    assert {i % 3 for i in got} == {0, 1}  # there is no source of the third class
    for i in range(1000):
        own = np.flatnonzero(kind == i % 3)
        d2 = ((src[own] - q[i]) ** 2).sum(1)
        first = np.lexsort((own, d2))[:4]
        assert sorted(got.get(i, [])) == [(n + 1, own[j], d2[j]) for n, j in enumerate(first)]
    most = near.nearest_k(queries, sources, 4, on=["kind"], most=550.0).collect()
    assert sorted((r["query_id"], r["source_id"], r["d2"], r["rank"]) for r in most) == sorted((i, s, d, n) for i, rows in got.items() for n, s, d in rows if d <= 550.0**2)


def test_many_rows_in_small_files_are_not_broadcast(spark, monkeypatch):
    """Places of few different numbers take little space on disk, and much as rows on the driver."""
    from heliospark.sources import tables

    plans, store = [], tables.stored

    def recorded(df, *by):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, *by)

    monkeypatch.setattr(tables, "stored", recorded)
    monkeypatch.setattr(near, "BROADCAST_ROWS", 20)
    q = spark.range(300).selectExpr("id as query_id", "id % 20 * 1.0D as x", "floor(id / 20) * 1.0D as y", "id % 2 as c")
    s = spark.range(300).selectExpr("id as source_id", "id % 20 * 1.0D + 400 as sx", "floor(id / 20) * 1.0D as sy", "id % 2 as c")
    found = near.nearest_k(q, s, 2, on=["c"])
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    joins = [p for p in plans if "Join" in p]
    assert len(joins) > 4 and not [p for p in joins if "BroadcastHashJoin" in p]
    got = {(r["query_id"], r["rank"]): r["source_id"] for r in found.collect()}
    both = sorted(s.collect(), key=lambda r: r["source_id"])
    for r in q.where("query_id % 37 = 0").collect():
        best = sorted(((r["x"] - t["sx"]) ** 2 + (r["y"] - t["sy"]) ** 2, t["source_id"]) for t in both if t["c"] == r["c"])[:2]
        assert [got[r["query_id"], 1], got[r["query_id"], 2]] == [i for _, i in best]
