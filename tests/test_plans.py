import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliospark.operators import search, walks
from heliospark.plans import nightly, routing
from heliospark.sources import files, scorestore, tables
from heliospark.streaming import weather

LINE = "array<struct<x:double,y:double>>"


def city(spark, nodes, streets, stamps, shade, clock=None):
    """streets: pairs of node names, walked both ways; shade(u, v, stamp)."""
    ids = {n: i for i, n in enumerate(nodes)}
    both = [(a, b) for a, b in streets] + [(b, a) for a, b in streets]
    dist = lambda a, b: ((nodes[a][0] - nodes[b][0]) ** 2 + (nodes[a][1] - nodes[b][1]) ** 2) ** 0.5
    e = spark.createDataFrame([(i, ids[a], ids[b], dist(a, b)) for i, (a, b) in enumerate(both)], "edge_id long, u long, v long, length double")
    n = spark.createDataFrame([(ids[k], float(x), float(y)) for k, (x, y) in nodes.items()], "node_id long, x double, y double")
    s = spark.createDataFrame([(k, i, float(shade(a, b, k))) for k in range(len(stamps)) for i, (a, b) in enumerate(both)], "stamp_idx int, edge_id long, shade float")
    c = walks.clock_table(spark.createDataFrame([(i, m) for i, m in enumerate(stamps)], "stamp_idx int, minute int"))
    return e, n, s, c, ids


WAYS = {"A": (0, 0), "C": (300, 0), "N": (150, 100), "S": (150, -100)}
STREETS = [("A", "C"), ("A", "N"), ("N", "C"), ("A", "S"), ("S", "C")]
ROUND = {"A": (0, 0), "C": (5400, 0), "N": (2700, 400), "S": (2700, -400)}
ROUND_STREETS = [("A", "N"), ("N", "C"), ("A", "S"), ("S", "C")]


def flank(a, b, _):
    return 1.0 if "N" in (a, b) else 0.0 if "S" in (a, b) else 0.5


def moving(a, b, k):
    return ((1.0, 0.5), (0.0, 1.0))[k][0 if "N" in (a, b) else 1]


def ask(spark, ids, rows):
    return spark.createDataFrame([(i, ids[o], ids[d], float(a), float(m)) for i, (o, d, a, m) in enumerate(rows)], "req_id long, origin long, goal long, alpha double, depart double")


def test_three_ways(spark):
    e, n, s, c, ids = city(spark, WAYS, STREETS, [720], flank)
    town = search.City.of(e, n, s, c)
    got = {(r["req_id"], r["kind"]): r for r in routing.plan(ask(spark, ids, [("A", "C", 0, 720), ("A", "C", 3, 720), ("A", "C", -3, 720), ("A", "A", 3, 720)]), town).collect()}
    assert set(got) == {(i, k) for i in range(3) for k in ("route", "baseline")}
    base = got[0, "baseline"]
    assert (base["distance_m"], base["shade_fraction"], round(base["duration_s"], 1)) == (300.0, 0.5, 222.2) and got[0, "route"]["distance_m"] == 300.0
    assert got[1, "route"]["shade_fraction"] == 1.0 and got[2, "route"]["shade_fraction"] == 0.0 and got[1, "route"]["distance_m"] > 300


def test_moving_sun(spark):
    e, n, s, c, ids = city(spark, ROUND, ROUND_STREETS, [720, 780], moving)
    town = search.City.of(e, n, s, c)
    got = {r["req_id"]: r["shade_fraction"] for r in routing.plan(ask(spark, ids, [("A", "C", 6, 720), ("A", "C", 6, 780), ("A", "C", 6, 810)]), town).where("kind = 'route'").collect()}
    assert got == {0: 0.75, 1: 1.0, 2: 1.0}
    steps = search.routes(ask(spark, ids, [("A", "C", 6, 720)]), town).where("kind = 'route'").withColumn("depart", F.lit(720.0))
    dated = walks.restamp(steps.withColumnRenamed("stamp_idx", "found"), c, ["req_id"], ["seq"])
    assert [r["found"] for r in dated.orderBy("seq").collect()] == [r["stamp_idx"] for r in dated.orderBy("seq").collect()] == [0, 1]


@pytest.mark.parametrize("seed", range(3))
def test_search_like_rounds_of_joins(spark, seed):
    r = random.Random(seed)
    nodes = {chr(65 + i): (r.randint(0, 900), r.randint(0, 900)) for i in range(9)}
    names = list(nodes)
    streets = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if r.random() < 0.45]
    values = {}
    shade = lambda a, b, k: values.setdefault((a, b, k), r.randint(0, 4) / 4)
    e, n, s, c, ids = city(spark, nodes, streets, [480, 490, 500], shade)
    asked = ask(spark, ids, [(r.choice(names[:4]), r.choice(names[4:]), r.choice([-6, -2, 3, 6]), 484) for _ in range(4)])
    town = search.City.of(e, n, s, c)
    costs = {}
    for q in asked.collect():
        steps = town.walk(town.prices(q["alpha"]), town.clock, q["origin"], q["goal"], q["depart"], guide=False)
        if steps is not None:
            costs[q["req_id"]] = sum(float(town.costs(q["alpha"])[k, i]) for i, k in steps)
    got = {x["req_id"]: x["cost"] for x in search.relax(asked, e, s, c).collect()}
    assert got == pytest.approx(costs, rel=1e-6)
    assert {x["req_id"]: x["cost"] for x in search.relax(asked, e, s, c, nodes=n).collect()} == got
    # whole walks: the same edges in the same order, entered in the same stamps
    tables = search.opened(e, n, s, c, limit=5)
    assert isinstance(tables, search.Network) and isinstance(search.opened(e, n, s, c), search.City)
    row = lambda x: (x["req_id"], x["kind"], x["seq"], x["edge_id"], x["stamp_idx"], round(x["length"], 6), round(x["shade"], 6))
    assert sorted(map(row, search.routes(asked, tables).collect())) == sorted(map(row, search.routes(asked, town).collect()))


def test_network_too_large_for_a_worker(spark):
    e, n, s, c, _ = city(spark, WAYS, STREETS, [720], flank)
    with pytest.raises(ValueError, match="relax"):
        search.City.of(e, n, s, c, limit=5)


@pytest.mark.parametrize("form", ["arrays", "tables"])
def test_requests_without_a_walk(spark, form):
    """Equal ends, nulls, unknown ends and a place that no street leads to give no rows, whichever way the city is held."""
    e, n, s, c, ids = city(spark, {**WAYS, "X": (900, 900)}, STREETS, [720], flank)
    town = search.opened(e, n, s, c, 5 if form == "tables" else search.BROADCAST_CELLS)
    rows = [(0, ids["A"], ids["A"], 1.0, 720.0), (1, ids["A"], ids["X"], 1.0, 720.0), (2, ids["A"], 99, 1.0, 720.0), (3, ids["A"], ids["C"], None, 720.0), (4, ids["A"], ids["C"], 1.0, None), (5, None, ids["C"], 1.0, 720.0), (6, ids["A"], ids["C"], 6.0, 720.0)]
    asked = spark.createDataFrame(rows, "req_id long, origin long, goal long, alpha double, depart double")
    got = routing.plan(asked, town).collect()
    assert {(r["req_id"], r["kind"]) for r in got} == {(6, "route"), (6, "baseline")}
    assert routing.plan(asked.limit(0), town).count() == 0


def test_day_scan(spark):
    e, n, s, c, ids = city(spark, ROUND, ROUND_STREETS, [720, 780], moving)
    town = search.City.of(e, n, s, c)
    stamps = spark.createDataFrame([(0, "12:00", 720), (1, "13:00", 780)], "stamp_idx int, stamp string, minute int")
    req = spark.createDataFrame([(1, ids["A"], ids["C"], dt.date(2026, 7, 1))], "req_id long, origin long, goal long, date date")
    none = spark.createDataFrame([], "date date, hour int, feels double, cloud double, rain double")
    rows, best = routing.day_scan(req, stamps, none, town)
    got = {r["time"]: r for r in rows.collect()}
    assert got["12:00"]["shade_fraction"] == 0.75 and got["13:00"]["shade_fraction"] == 1.0 and got["12:00"]["mode"] == "shade"
    assert best.first()["best_time"] in ("12:00", "13:00")


def test_requests(spark):
    rows = [("2026-09-13", 10, 20), ("2028-09-13", 10, 20), ("2026-09-13", 24, 0), ("2026-09-13", 1, 15), (None, 1, 0)]
    df = spark.createDataFrame(rows, "d string, h int, m int").withColumn("why", routing.refusal(F.to_date("d"), F.col("h"), F.col("m"), dt.date(2026, 9, 13)))
    assert [r["why"] for r in df.collect()] == [None, "date is too far from today", "hour is outside 0 to 23", "minute is no step of the clock", "date is too far from today"]
    _, n, _, _, ids = city(spark, WAYS, STREETS, [720], flank)
    req = spark.createDataFrame([(1, 1.0, 0.0, 301.0, 0.0), (2, 0.0, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 0.0, 9e4)], "req_id long, o_x double, o_y double, d_x double, d_y double")
    got = {r["req_id"]: r for r in routing.snap(req, n.withColumn("pos", F.col("node_id"))).collect()}
    assert (got[1]["origin"], got[1]["goal"], got[1]["error"]) == (ids["A"], ids["C"], None) and "same street corner" in got[2]["error"] and "from the nearest mapped" in got[3]["error"]


KEYS = "radius_m int, date date, stamp string, u long, v long, key int, shade_fraction double"


def store(spark, root, date, stamp, values, first=0):
    scorestore.save(spark.createDataFrame([(1, date, stamp, first + i, first + i + 1, 0, v) for i, v in enumerate(values)], KEYS), root)


def test_score_store(spark, tmp_path):
    root, day = f"{tmp_path}/scores", dt.date(2026, 9, 13)
    edges = spark.createDataFrame([(i, i, i + 1, 0) for i in range(201)], "edge_id long, u long, v long, key int")
    assert scorestore.load(spark, root, 1, day, "06:00", edges) is None and scorestore.missing(spark, root, 1, day, ["06:00"]) == ["06:00"]
    store(spark, root, day, "06:00", [(0.0, 0.25, 0.5, 1.0)[i % 4] for i in range(200)])
    store(spark, root, day, "07:00", [0.5] * 201)
    store(spark, root, day, "07:00", [0.75] * 201)  # replaced, and the other stamp stays
    got = [r["shade"] for r in scorestore.load(spark, root, 1, day, "06:00", edges).orderBy("edge_id").collect()]
    assert got[:4] == [0.0, 0.25, 0.5, 1.0] and got[200] == 0.0
    assert scorestore.load(spark, root, 1, day, "07:00", edges).agg(F.min("shade")).first()[0] == 0.75
    assert scorestore.align(edges, scorestore.scan(spark, root).where("u < 2")) is None
    assert scorestore.missing(spark, root, 1, day, ["06:00", "07:00", "08:00"]) == ["08:00"]
    assert scorestore.day_scores(spark, root, 1, day, ["06:00", "07:00"], edges).count() == 401
    assert scorestore.day_scores(spark, root, 1, day, ["06:00", "08:00"], edges) is None
    assert scorestore.validate(spark, root, 1, day, ["06:00", "07:00"], edges) == []
    store(spark, root, day, "08:00", [1.1] * 201)
    store(spark, root, day, "09:00", [float("nan")] * 201)
    store(spark, root, day, "10:00", [0.5] * 100)
    wrong = scorestore.validate(spark, root, 1, day, ["06:00", "08:00", "11:00"], edges)
    assert [w.split()[0] for w in wrong] == ["11:00", "08:00", "09:00", "10:00"]
    store(spark, root, dt.date(2025, 7, 1), "06:00", [0.5])
    store(spark, root, dt.date(2026, 1, 5), "06:00", [0.5])
    with pytest.raises(ValueError, match="one date"):
        scorestore.release_date(spark, root)
    assert scorestore.prune(spark, root, day) == [dt.date(2025, 7, 1), dt.date(2026, 1, 5)] and scorestore.release_date(spark, root) == day
    assert "PartitionFilters" in scorestore.scan(spark, root).where("stamp = '06:00'")._jdf.queryExecution().toString()


def test_tables(spark, tmp_path):
    e = spark.createDataFrame([(0, 1, 2, 0, 10.0), (1, 2, 3, 1, 14.1)], tables.SCHEMAS["edges"])
    n = spark.createDataFrame([(1, 0.0, 0.0)], tables.SCHEMAS["nodes"])
    s = spark.createDataFrame([(0, [(0.0, 0.0), (10.0, 0.0)])], tables.SCHEMAS["edge_shapes"])
    with pytest.raises(FileNotFoundError, match="write_network"):
        tables.network(spark, str(tmp_path))
    tables.write_network(e, n, s, str(tmp_path))
    assert [t.count() for t in tables.network(spark, str(tmp_path))] == [2, 1, 1]
    assert tables.canopy(spark, str(tmp_path)).count() == 0 and tables.read_optional(spark, f"{tmp_path}/none", "places").count() == 0
    (tmp_path / "o.csv").write_text("osm_element,osm_id,levels,source\nway,1,9,x\nway,2,?,x\n")
    assert [tuple(r) for r in tables.overrides(spark, f"{tmp_path}/o.csv").collect()] == [("way", 1, 9.0)]
    (tmp_path / "p.csv").write_text("osm_element,osm_id,levels,source\nway,1,9,x\nway,1,8,x\n")
    with pytest.raises(ValueError, match="more than one"):
        tables.overrides(spark, f"{tmp_path}/p.csv")
    assert tables.overrides(spark, f"{tmp_path}/q.csv").count() == 0 and tables.read_csv(spark, f"{tmp_path}/q.csv", "queue").count() == 0


def test_weather_and_manifest(spark, tmp_path):
    h = {"time": ["12:00", "13:00"], "temperature_2m": [5.0, 6.0], "apparent_temperature": [2.0, None], "cloud_cover": [10.0, 20.0], "precipitation": [0.0, 0.1]}
    read = lambda **x: [tuple(r) for r in files.parse_weather(spark.createDataFrame([(json.dumps({"hourly": h | x}),)], "body string")).drop("body").collect()]
    assert [(r[0], r[4]) for r in read()] == [("12:00", 2.0), ("13:00", 6.0)]
    for bad in ({"temperature_2m": [None, 6.0]}, {"cloud_cover": [110.0, 20.0]}, {"precipitation": [-1.0, 0.1]}):
        assert [r[0] for r in read(**bad)] == ["13:00"]
    assert files.read_manifest(spark, f"{tmp_path}/m.json") is None
    files.write_manifest(spark, f"{tmp_path}/m.json", "2026-09-13", ["06:00"], "shadows", "now")
    files.write_manifest(spark, f"{tmp_path}/m.json", "2026-09-14", ["06:00"], "shadows", "now")
    assert files.read_manifest(spark, f"{tmp_path}/m.json")["date"] == "2026-09-14"
    files.write_text(spark, f"{tmp_path}/bad.json", "[]")
    with pytest.raises(ValueError, match="manifest"):
        files.read_manifest(spark, f"{tmp_path}/bad.json")
    rings = [[(671000.0, 5665700.0), (671000.4, 5665700.0), (671010.0, 5665700.0), (671010.0, 5665710.0), (671000.0, 5665700.0)]]
    f = files.polygon_features(spark.createDataFrame([(rings, "solid")], "rings array<array<struct<x:double,y:double>>>, kind string"), ["kind"]).first()["feature"]
    body = json.loads(f)
    assert body["properties"] == {"kind": "solid"} and len(body["geometry"]["coordinates"][0]) == 4 and 71 < body["geometry"]["coordinates"][0][0][0] < 72
    with pytest.raises(ValueError, match="empty"):
        files.write_features(spark.createDataFrame([], "feature string"), f"{tmp_path}/f")


def test_release(spark, tmp_path):
    day = dt.date(2026, 12, 21)
    box = [[(0.0, -5.0), (50.0, -5.0), (50.0, 5.0), (0.0, 5.0), (0.0, -5.0)]]
    casters = spark.createDataFrame([(box, 3.0, "tag")], "rings array<array<struct<x:double,y:double>>>, height_m double, height_source string")
    shapes = spark.createDataFrame([(0, [(0.0, 0.0), (100.0, 0.0)])], f"edge_id long, coords {LINE}")
    edges = spark.createDataFrame([(0, 1, 2, 0)], "edge_id long, u long, v long, key int")
    store(spark, f"{tmp_path}/scores", dt.date(2026, 1, 5), "06:00", [0.5])
    assert nightly.release(spark, casters, shapes, edges, day, 1, str(tmp_path), "now", scores_only=True) == [] and files.read_manifest(spark, f"{tmp_path}/manifest.json") is None
    assert nightly.release(spark, casters, shapes, edges, day, 1, str(tmp_path), "now") == [dt.date(2026, 1, 5)]
    stamps = files.read_manifest(spark, f"{tmp_path}/manifest.json")["times"]
    rows = scorestore.scan(spark, f"{tmp_path}/scores").collect()
    assert sorted(r["stamp"] for r in rows) == stamps and all(0.5 <= r["shade_fraction"] <= 1 for r in rows)
    assert [r["name"] for r in nightly.stale(spark, ["b", "a", "c"], ["c"]).collect()] == ["a", "b"]


def test_weather_stream(spark, tmp_path):
    rows = [("2026-09-13 12:10:00", 1, 5.0), ("2026-09-13 12:40:00", 2, 6.0), ("2026-09-13 15:00:00", 3, 7.0)]
    df = spark.createDataFrame(rows, "t string, fetched_at long, feels double").select(F.to_timestamp("t").alias("ts"), "fetched_at", "feels", F.lit(1.0).alias("cloud"), F.lit(0.0).alias("rain"))
    df.write.parquet(f"{tmp_path}/in")
    assert sorted(r["feels"] for r in weather.latest(spark.read.parquet(f"{tmp_path}/in")).collect()) == [6.0, 7.0]
    q = weather.latest(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert [r["feels"] for r in spark.table("w").collect()] == [6.0]


def test_weather_days(spark):
    from heliospark.plans.policy import WeatherDays, for_day

    now, calls, today = [0.0], [], dt.date(2026, 10, 1)

    def fetch(date):
        calls.append(date)
        if date == today + dt.timedelta(1):
            raise OSError
        return [(12, 4.0, 0.0, 0.0)]

    w = WeatherDays(fetch, lambda: today, lambda: now[0])
    assert w.day(today) == w.day(today) and len(calls) == 1
    now[0] = 1801
    w.day(today)
    assert len(calls) == 2 and w.day(today + dt.timedelta(16)) == [] and w.day(today - dt.timedelta(2)) == [] and len(calls) == 2
    assert w.day(today + dt.timedelta(1)) == [] and w.day(today + dt.timedelta(1)) == [] and len(calls) == 3
    now[0] += 61
    w.day(today + dt.timedelta(1))
    assert len(calls) == 4
    got = {r["stamp"]: r["preference"] for r in for_day(spark, w, today, ["12:00", "13:00"]).collect()}
    assert (got["12:00"]["reason"], got["12:00"]["provider"], got["13:00"]["reason"], got["13:00"]["provider"]) == ("cold", "forecast", "seasonal_fallback", None)


def test_classifier_on_unseen_blocks(spark):
    from heliospark.operators import classify, quality

    r = random.Random(5)
    rows = [(i, r.uniform(0, 3000), r.uniform(0, 3000), r.random(), r.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x double, y double, a double, b double")
    both = classify.samples(df.where("a > 0.5"), df.where("a <= 0.5 and b > 0.5"), df.where("a <= 0.5 and b <= 0.5"), per_class=150)
    assert both.count() == 300
    scored = classify.out_of_fold(both, ["a", "b"], trees=3, folds=3)
    assert scored.count() == 300 and quality.roc_auc(scored, "label", "score").first()[0] > 0.95
    assert classify.fit_predict(both, df, ["a", "b"], trees=2).count() == 400


def test_tiles_and_canopy(spark):
    from heliospark.functions import geo

    assert spark.range(1).select(geo.tiles_over(51.1605, 71.4704, 51.2953, 71.4704, 9)).first()[0] == ["121302121", "121302123"]
    good, open_ring = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]], [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]
    df = spark.createDataFrame([(good, 4.0, "chm_height"), (open_ring, 4.0, "x"), (good, -1.0, "x")], "rings array<array<struct<x:double,y:double>>>, height_m double, height_source string")
    assert files.valid_canopy(df.limit(1), (0, 0, 5, 5)).count() == 1
    for bad, box in ((df, (0, 0, 5, 5)), (df.limit(1), (0, 0, 0.5, 5)), (df.limit(0), (0, 0, 5, 5))):
        with pytest.raises(ValueError, match="valid"):
            files.valid_canopy(bad, box)


def test_scores_of_another_network_do_not_pass(spark, tmp_path):
    day = dt.date(2024, 6, 1)
    rows = [(1, day, s, u, u + 1, 0, 0.5) for s in ("06:00", "07:00") for u in (100, 101, 102)]
    scorestore.save(spark.createDataFrame(rows, "radius_m int, date date, stamp string, u long, v long, key int, shade_fraction double"), f"{tmp_path}/s")
    other = spark.createDataFrame([(0, 1, 2, 0), (1, 2, 3, 0)], "edge_id long, u long, v long, key int")
    wrong = scorestore.validate(spark, f"{tmp_path}/s", 1, day, ["06:00", "07:00"], other)
    assert [w.split(" covers ")[1] for w in wrong] == ["0 of 2 edges"] * 2
    own = spark.createDataFrame([(i, 100 + i, 101 + i, 0) for i in range(3)], "edge_id long, u long, v long, key int")
    assert scorestore.validate(spark, f"{tmp_path}/s", 1, day, ["06:00", "07:00"], own) == []


def test_a_reader_never_misses_the_file(spark, tmp_path):
    path = f"{tmp_path}/m.json"
    for text in ("one", "two"):
        files.write_text(spark, path, text)
        assert files.read_text(spark, path) == text
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["m.json"]
    for name in ("a", "b", "c"):
        files.write_text(spark, f"{tmp_path}/tiles/{name}", name)
    assert [x for x in files.drop_stale(spark, f"{tmp_path}/tiles", ["b"]) if not x.startswith(".")] == ["a", "c"]


def test_simplified_keeps_what_is_off_the_line(spark):
    def kept(ring, tolerance=1.0):
        df = spark.createDataFrame([([(float(x), float(y)) for x, y in ring],)], "r array<struct<x:double,y:double>>")
        return [tuple(p) for p in df.select(files.simplified(F.col("r"), tolerance)).first()[0]]

    square = [(0, 0), (10, 0.3), (20, 0), (40, 0), (40, 40), (20, 40.9), (0, 40), (0, 0)]
    assert kept(square) == [(0, 0), (40, 0), (40, 40), (0, 40), (0, 0)]
    notch = [(0, 0), (20, 0), (20, 3), (22, 3), (22, 0), (40, 0), (40, 40), (0, 40), (0, 0)]
    assert kept(notch) == notch
    assert kept([(0, 0), (0.2, 0), (0.2, 0.2), (0, 0)]) == [(0, 0), (0.2, 0), (0.2, 0.2), (0, 0)]


def test_days(spark, tmp_path):
    from heliospark.plans import days

    e, n, s, c, ids = city(spark, ROUND, ROUND_STREETS, [720, 780], moving)
    e = e.withColumn("key", F.lit(0))
    date, root = dt.date(2026, 7, 1), str(tmp_path / "scores")
    with pytest.raises(ValueError, match="daylight"):
        days.assemble(spark, root, 5, date, e, [], "12:00")
    with pytest.raises(FileNotFoundError, match="13:00"):
        days.assemble(spark, root, 5, date, e, ["12:00", "13:00"], "12:50")
    # nothing stored: one stamp, scored on the way, holds from end to end, at night too, and scores have gaps
    one = days.assemble(spark, root, 5, date, e, ["12:00", "13:00"], "12:30", lambda stamp: s.where("stamp_idx = 0 and edge_id < 4").select("edge_id", "shade"))
    assert one.stamps == ["12:00"]
    for form in (1, search.BROADCAST_CELLS):
        town = search.opened(e, n, one.shade, one.clock, form)
        for minute in (720, 60):
            walk = {r["kind"]: r["shade_fraction"] for r in routing.plan(ask(spark, ids, [("A", "C", 6, minute)]), town).collect()}
            assert walk["route"] == 1.0
    names = spark.createDataFrame([(0, "12:00"), (1, "13:00")], "stamp_idx int, stamp string")
    rows = s.join(names, "stamp_idx").join(e, "edge_id").select(F.lit(5).alias("radius_m"), F.lit(date).alias("date"), "stamp", "u", "v", "key", F.col("shade").alias("shade_fraction"))
    scorestore.save(rows, root)
    whole = days.assemble(spark, root, 5, date, e, ["12:00", "13:00"], "12:00")
    town = search.opened(e, n, whole.shade, whole.clock)
    assert routing.plan(ask(spark, ids, [("A", "C", 6, 720)]), town).where("kind = 'route'").first()["shade_fraction"] == 0.75
    # one stamp of the store, where another is missing
    assert days.assemble(spark, root, 5, date, e, ["12:00", "13:00", "14:00"], "12:40").stamps == ["13:00"]


def test_bodies(spark):
    rows = ['{"date": "2026-09-13", "hour": 10, "minute": 20}', '{"date": "2026-09-13", "hour": 10, "minute": 20, "zeal": 1, "a": 2}', "[1]", "", None, '{"hour": 10}', '{"date": "13.9.2026", "hour": 10, "minute": 0}', '{"date": "2026-09-13", "hour": "x", "minute": 0}']
    got = spark.createDataFrame([(r,) for r in rows], "b string").select(routing.body_refusal(F.col("b"), dt.date(2026, 9, 13)).alias("w")).collect()
    no = "the body is no JSON object"
    assert [r["w"] for r in got] == [None, "unknown field: a", no, no, no, "date is too far from today", "date is too far from today", "hour is outside 0 to 23"]


def test_bounded_bodies():
    import io

    waits = []
    fetch = lambda data: lambda wait: (waits.append(wait), io.BytesIO(data))[1]
    assert files.bounded_body(fetch(b'{"a": 1}')) == {"a": 1} and waits == [3.0]
    assert files.bounded_body(fetch(b"[1]")) == {}
    assert files.bounded_body(fetch(b'"' + b"x" * 8 + b'"'), limit=10) == {}
    with pytest.raises(ValueError, match="longer"):
        files.bounded_body(fetch(b'"' + b"x" * 9 + b'"'), limit=10)
    with pytest.raises(ValueError):
        files.bounded_body(fetch(b"<html>"))


def test_index_is_held_but_failures_are_not(spark, tmp_path):
    path = str(tmp_path / "index")
    index = files.Index(spark, path)
    with pytest.raises(Exception):
        index.entries()
    spark.createDataFrame([("<html>",)], "value string").write.text(path)
    with pytest.raises(Exception):
        index.entries()
    e = spark.createDataFrame([(0, "Ann", "Cafe", 51.0, 71.0, "ann", "ann")], "entry long, n string, d string, lat double, lon double, c string, l string")
    files.index_json(e).write.mode("overwrite").text(path)
    assert [tuple(r) for r in index.entries().collect()] == [(0, "Ann", "Cafe", 51.0, 71.0, "ann", "ann")]
    assert index.entries() is index.entries()


def test_landmarks_promise_no_more_than_is_left(spark):
    """On a one-way loop with a dead end and a stamp that comes back, guided walks are those of the search without hints, and tables agree."""
    ways = [("A", "B", 70.0), ("B", "C", 90.0), ("C", "D", 60.0), ("D", "A", 80.0), ("B", "D", 155.0), ("A", "E", 30.0), ("D", "F", 40.0), ("F", "A", 40.0)]
    e = spark.createDataFrame([(i, *w) for i, w in enumerate(ways)], "edge_id long, u string, v string, length double")
    n = spark.createDataFrame([(k, 0.0, 0.0) for k in "ABCDEF"], "node_id string, x double, y double")
    shade = spark.createDataFrame([(t, i, (i * 3 + t * 5) % 7 / 8) for t in (0, 1) for i in range(len(ways))], "stamp_idx int, edge_id long, shade float")
    clock = spark.createDataFrame([(m, 0 if m in (601, 604) else 1 if m in (602, 603) else 2) for m in range(1441)], "minute int, stamp_idx int")
    town = search.City.of(e, n, shade, clock)
    asked = [(f"{a}{b}{alpha}", a, b, float(alpha), 600.0) for a in "ABCDEF" for b in "ABCDEF" for alpha in (-6, 0, 4) if a != b]
    at = {k: i for i, k in enumerate(town.nodes.tolist())}
    for _, a, b, alpha, depart in asked:
        least = town.least(alpha, town.clock, depart)
        assert town.walk(town.prices(alpha), town.clock, at[a], at[b], depart, least=least) == town.walk(town.prices(alpha), town.clock, at[a], at[b], depart, guide=False)
    r = spark.createDataFrame(asked, "req_id string, origin string, goal string, alpha double, depart double")
    told = {x["req_id"]: (x["cost"], x["walked"]) for x in search.cheapest(r, town).collect()}
    assert told == {x["req_id"]: (x["cost"], x["walked"]) for x in search.relax(r, e, shade, clock).collect()} and "EA0" not in told


def test_searches_are_dealt_over_tasks(spark):
    """A table of one file is one task; requests are dealt by their number, and long walks leave in several batches."""
    n = 3 * search.REQUESTS
    e = spark.createDataFrame([(0, 0, 1, 5.0), (1, 1, 0, 5.0)], "edge_id long, u long, v long, length double")
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 5.0, 0.0)], "node_id long, x double, y double")
    clock = spark.range(1441).selectExpr("cast(id as int) as minute", "0 as stamp_idx")
    town = search.City.of(e, nodes, spark.createDataFrame([(0, 0, 0.5)], "stamp_idx int, edge_id long, shade float"), clock)
    asked = spark.range(0, n, 1, 1).selectExpr("id as req_id", "id % 2 as origin", "1 - id % 2 as goal", "1.0D as alpha", "0.0D as depart")
    out = search.routes(asked, town)
    assert out.rdd.getNumPartitions() == 4 and out.count() == 2 * n


def test_a_network_takes_the_driver_some_bytes_an_edge(spark):
    """Arrays, not rows and lists of Python objects: it is measured in what Python allocates."""
    import tracemalloc

    wide, n = 60, 3_600
    nodes = spark.range(n).selectExpr("id as node_id", f"id % {wide} * 10.0D as x", f"floor(id / {wide}) * 10.0D as y")
    edges = nodes.selectExpr("node_id as u", f"explode(array(node_id + 1, node_id - 1, node_id + {wide}, node_id - {wide})) as v").where(f"v between 0 and {n - 1}")
    edges = edges.toPandas().assign(edge_id=lambda e: np.arange(len(e)), length=lambda e: 10.0 + (e["u"] * e["v"]) % 7)
    made = spark.createDataFrame(edges).select("edge_id", "u", "v", "length").localCheckpoint()
    shade_of = made.selectExpr("explode(sequence(0, 5)) as stamp_idx", "edge_id", "cast((u + v) % 5 / 4 as float) as shade").localCheckpoint()
    clock = spark.range(1441).selectExpr("cast(id as int) as minute", "cast(least(id / 200, 6) as int) as stamp_idx")
    tracemalloc.start()
    town = search.City.of(made, nodes, shade_of, clock)
    marks = town.landmarks()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 400 * len(edges), most / len(edges)
    assert town.shade.shape == (7, len(edges)) and (town.shade[6] == 1).all() and np.array_equal(town.shade[2], ((edges["u"] + edges["v"]) % 5 / 4).to_numpy(np.float32))
    # lengths by rounds over all edges
    there, at = marks[0][0], int(np.argmin(marks[0][0]))
    far = np.full(n, np.inf)
    far[at] = 0.0
    while True:
        new = far.copy()
        np.minimum.at(new, edges["v"].to_numpy(), far[edges["u"].to_numpy()] + edges["length"].to_numpy())
        if np.array_equal(new, far):
            break
        far = new
    assert np.allclose(there, far, rtol=1e-12)
    with pytest.raises(ValueError, match="not there"):
        search.City.of(made, nodes.where("node_id != 7"), shade_of, clock)
