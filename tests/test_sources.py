"""Published versions, GeoParquet files, raster windows and shadow frames."""

import json
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from heliospark.functions import geo
from heliospark.operators import shade
from heliospark.sources import files, geometry, publish, raster


def square(x0, y0, w):
    return [(x0, y0), (x0 + w, y0), (x0 + w, y0 + w), (x0, y0 + w), (x0, y0)]


def crowns(spark, n):
    return spark.createDataFrame([([square(671000.0 + 20 * k, 5665700.0, 5.0)], 4.0, "chm_height") for k in range(n)], f"rings {geo.RINGS}, height_m double, height_source string")


def test_readers_see_whole_versions(spark, tmp_path):
    root, box = str(tmp_path / "tree"), (670000.0, 5660000.0, 680000.0, 5670000.0)
    read = lambda: spark.read.text(publish.current(spark, root)).count()
    assert publish.current(spark, root) is None
    files.replace_tree(crowns(spark, 3), root, box)
    assert read() == 3
    with pytest.raises(ValueError):
        files.replace_tree(crowns(spark, 3).where("height_m > 9"), root, box)
    assert read() == 3 and len(publish.versions(spark, root)) == 1

    def fails(folder):
        spark.range(5).write.parquet(folder)
        raise OSError("lost")

    with pytest.raises(OSError):
        publish.publish(spark, root, fails)
    assert read() == 3 and len(publish.versions(spark, root)) == 1
    for n in (4, 5, 6):
        files.replace_tree(crowns(spark, n), root, box)
        assert read() == n
    assert len(publish.versions(spark, root)) == 2


def test_a_failing_rename_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "p")
    publish.publish(spark, root, lambda f: spark.range(2).write.parquet(f))

    def broken(*_):
        raise OSError("no rename")

    monkeypatch.setattr(publish, "write_text", broken)
    with pytest.raises(OSError):
        publish.publish(spark, root, lambda f: spark.range(9).write.parquet(f))
    assert spark.read.parquet(publish.current(spark, root)).count() == 2 and len(publish.versions(spark, root)) == 1


def wkb(rings):
    out = struct.pack("<BII", 1, 3, len(rings))
    for r in rings:
        out += struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r)
    return out


def geo_file(path, covering=True, meta=True, encoding="WKB"):
    boxes = [(float(x), 0.0) for x in range(0, 10_000, 10)]
    rows = {"id": list(range(len(boxes))), "shape": [wkb([square(x, y, 5.0)]) for x, y in boxes], "bbox": [{"xmin": x, "ymin": y, "xmax": x + 5, "ymax": y + 5} for x, y in boxes]}
    column = {"encoding": encoding, "geometry_types": ["Polygon"]} | ({"covering": {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}} if covering else {})
    t = pa.table(rows)
    if meta:
        t = t.replace_schema_metadata({"geo": json.dumps({"version": "1.1.0", "primary_column": "shape", "columns": {"shape": column}})})
    pq.write_table(t, path, row_group_size=100)
    return str(path)


@pytest.mark.parametrize("covering", [True, False])
def test_geoparquet_is_read_by_box(spark, tmp_path, covering):
    path = geo_file(tmp_path / "a.parquet", covering)
    whole = geometry.scan_geoparquet(spark, path)
    assert whole.count() == 1000 and whole.first()["geometry"]["type"] == "Polygon"
    some = geometry.scan_geoparquet(spark, path, (104.0, 1.0, 121.0, 2.0))
    assert sorted(r["id"] for r in some.collect()) == [10, 11, 12]
    assert [tuple(p) for p in some.orderBy("id").first()["geometry"]["rings"][0]] == square(100.0, 0.0, 5.0)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert ("PushedFilters: [" in plan and "bbox.xmin" in plan.split("PushedFilters: [")[1].split("]")[0]) == covering


def test_geoparquet_refuses_what_it_cannot_read(spark, tmp_path):
    with pytest.raises(ValueError, match="geo metadata"):
        geometry.scan_geoparquet(spark, geo_file(tmp_path / "b.parquet", meta=False))
    with pytest.raises(ValueError, match="encoded"):
        geometry.scan_geoparquet(spark, geo_file(tmp_path / "c.parquet", encoding="point"))


def test_windows_are_slices(spark):
    r = np.random.default_rng(1)
    grid = r.integers(1, 99, (50, 41)).astype(np.float32)
    px = spark.createDataFrame([(i, j, float(grid[i, j])) for i in range(50) for j in range(41)], "row int, col int, value double")
    asked = [(0, 0, 0, 50, 41), (1, -5, -7, 20, 20), (2, 45, 38, 30, 9), (3, 15, 15, 2, 2), (4, 500, -300, 3, 4), (5, 16, 16, 16, 16), (6, -60, 0, 200, 1)]
    got = {x["window_id"]: np.frombuffer(x["pixels"], np.float32).reshape(x["height"], x["width"]) for x in raster.windows(raster.tiled(px, 16), spark.createDataFrame(asked, "window_id long, row int, col int, height int, width int"), 16).collect()}
    wide = np.zeros((1000, 1000), np.float32)
    wide[400:450, 400:441] = grid
    for k, a, b, h, w in asked:
        assert np.array_equal(got[k], wide[400 + a : 400 + a + h, 400 + b : 400 + b + w]), k


def test_shadow_frames_and_features(spark, tmp_path):
    c = crowns(spark, 2)
    s = spark.createDataFrame([("09:00", 16.2446, 134.3016), ("23:00", -20.0, 0.0)], "stamp string, altitude double, azimuth double")
    blobs = shade.shadow_blobs(c, s)
    rows = shade.shadow_frame(blobs, s, "2026-10-24").collect()
    assert {(r["time"], r["altitude_deg"], r["azimuth_deg"], r["kind"]) for r in rows} == {("2026-10-24T09:00:00+05:00", 16.24, 134.3, "soft")}
    assert all(71 < p[0] < 72 and 51 < p[1] < 52 for r in rows for ring in r["rings"] for p in ring)
    out = str(tmp_path / "f")
    files.write_features(files.polygon_features(blobs, ["stamp", "kind"]), out)
    features = [json.loads(x["value"]) for x in spark.read.text(out).collect()]
    assert len(features) == len(rows) and all(f["geometry"]["type"] == "Polygon" and f["properties"]["kind"] == "soft" for f in features)
