import struct

from pyspark.sql import functions as F

from heliospark.operators import quality
from heliospark.sources import geometry


def ring(points, order="<"):
    return struct.pack(order + "I", len(points)) + b"".join(struct.pack(order + "dd", *p) for p in points)


def test_well_known_binary(spark):
    a, b = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]
    polygon = struct.pack("<BII", 1, 3, 2) + ring(a) + ring(b)
    many = struct.pack(">BII", 0, 6, 2) + (struct.pack(">BII", 0, 3, 1) + ring(a, ">")) + (struct.pack("<BII", 1, 3, 1) + ring(b))
    line, point = struct.pack("<BI", 1, 2) + ring(a), struct.pack("<BIdd", 1, 1, 5.0, 6.0)
    high = struct.pack("<BII", 1, 0x80000000 | 0x20000000 | 1, 4326) + struct.pack("<ddd", 7.0, 8.0, 9.0)
    rows = [(i, bytearray(x) if x is not None else None) for i, x in enumerate([polygon, many, line, point, high, None, b"\x01", b"", b"\x07" * 40])]
    df = spark.createDataFrame(rows, "id int, wkb binary").withColumn("g", geometry.from_wkb("wkb"))
    got = {r["id"]: (r["g"]["type"], [[tuple(p) for p in x] for x in r["g"]["rings"]]) if r["g"] and r["g"]["type"] else None for r in df.collect()}
    assert got == {0: ("Polygon", [a, b]), 1: ("MultiPolygon", [a, b]), 2: ("LineString", [a]), 3: ("Point", [[(5.0, 6.0)]]), 4: ("Point", [[(7.0, 8.0)]]), 5: None, 6: None, 7: None, 8: None}
    assert sorted(r["id"] for r in geometry.polygons(df, "g").collect()) == [0, 1]
    assert [r["coords"][0]["x"] for r in geometry.lines(df, "g").collect()] == [0.0]


def test_geojson(spark):
    texts = ['{"type":"Point","coordinates":[1,2]}', '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,0],[3,4]]}}', '{"type":"FeatureCollection"}', "none", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(geometry.from_geojson(F.col("t")).alias("g")).collect()
    assert [r["g"] and (r["g"]["type"], [[tuple(p) for p in x] for x in r["g"]["rings"]]) for r in got] == [("Point", [[(1.0, 2.0)]]), ("LineString", [[(0.0, 0.0), (3.0, 4.0)]]), None, None, None]


def test_samples_are_the_smallest_hashes(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("c"))
    code = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id", F.lit(0)).alias("h")).collect()}
    for keep in (1, 70, 10_000):
        got = quality.hash_sample(df, "id", keep, ["c"]).collect()
        for k, name in enumerate(("a", "b", None)):
            want = sorted((i for i in range(5000) if i % 3 == k), key=lambda i: code[i])[:keep]
            assert sorted(r["id"] for r in got if r["c"] == name) == sorted(want)
        assert {r["id"] for r in quality.hash_sample(df, "id", keep).collect()} == set(sorted(range(5000), key=lambda i: code[i])[:keep])


def test_a_ring_is_made_once(spark):
    """Whatever makes a ring is named once, not again for each of its corners."""
    from pyspark.sql import functions as F

    from heliospark.functions import geo
    from heliospark.sources import files

    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (0.0, 0.0)],)], "ring array<struct<x:double,y:double>>")
    for made in (geo.point_inside(F.array("ring")), geo.ring_centroid(F.col("ring")), files.simplified(F.col("ring"))):
        plan = df.select(made.alias("p"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("ring#") <= 2, plan.count("ring#")
    row = df.select(geo.point_inside(F.array("ring")).alias("p"), geo.ring_centroid(F.col("ring")).alias("c"), F.size(files.simplified(F.col("ring"))).alias("n")).first()
    assert (tuple(row["p"]), tuple(row["c"]), row["n"]) == ((2.0, 1.5), (2.0, 1.5), 5)
