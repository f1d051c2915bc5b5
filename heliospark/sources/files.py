"""Exchange files: weather, manifest, map features, the search index."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospark.constants import COLLAPSE, KAZAKH_TO_RUSSIAN, LATIN, SIMPLIFY, STREET_WORDS
from heliospark.functions.geo import distance_to_segment, from_utm, let
from heliospark.functions.tags import bounded_number

#: The longest weather body and wait.
MOST_WEATHER_BYTES, WEATHER_TIMEOUT_S = 128 * 1024, 3.0
HOURLY = "hourly struct<time:array<string>,temperature_2m:array<double>,apparent_temperature:array<double>,cloud_cover:array<double>,precipitation:array<double>>"


def parse_weather(rows: DataFrame, column: str = "body") -> DataFrame:
    """(…, time, temperature_c, apparent_temperature_c, cloud_cover_percent, precipitation_mm): columnar JSON as a row per hour. An hour with a value that is absent or out of range is left out; without an apparent temperature the air's counts."""
    h = F.from_json(column, HOURLY)["hourly"]
    z = F.explode(F.arrays_zip(*[h[c].alias(c) for c in ("time", "temperature_2m", "apparent_temperature", "cloud_cover", "precipitation")])).alias("h")
    out = rows.select("*", z).select(
        *rows.columns, F.col("h.time").alias("time"), bounded_number(F.col("h.temperature_2m"), -100, 100).alias("temperature_c"), F.col("h.apparent_temperature").alias("__a"),
        bounded_number(F.col("h.cloud_cover"), 0, 100).alias("cloud_cover_percent"), bounded_number(F.col("h.precipitation"), 0, 1000).alias("precipitation_mm"),
    )
    felt = F.when(F.col("__a").isNull(), F.col("temperature_c")).otherwise(bounded_number(F.col("__a"), -100, 100))
    out = out.withColumn("apparent_temperature_c", felt)
    return out.where("time is not null and temperature_c is not null and apparent_temperature_c is not null and cloud_cover_percent is not null and precipitation_mm is not null").drop("__a")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written aside and renamed over the old one in one step, so that a reader sees the old one or the new one."""
    fs, p = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(option, 1)
    over[0] = option.OVERWRITE
    where = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    where.rename(fs.makeQualified(aside), fs.makeQualified(p), over)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    return "\n".join(r["value"] for r in spark.read.text(path).collect()) if fs.exists(p) else None


def bounded_body(fetch, limit: int = MOST_WEATHER_BYTES, timeout_s: float = WEATHER_TIMEOUT_S) -> dict:
    """The JSON object that fetch(timeout_s) gives as a readable binary file. A longer body than the limit and one that is no JSON are ValueErrors and a slow one the OSError that fetch raises, both of which policy.WeatherDays holds as failures; JSON of another kind is an empty object."""
    with fetch(timeout_s) as f:
        body = f.read(limit + 1)
    if len(body) > limit:
        raise ValueError(f"the body is longer than {limit} bytes")
    out = json.loads(body)
    return out if isinstance(out, dict) else {}


def write_manifest(spark: SparkSession, path: str, date: str, times: list[str], layer: str, generated_at: str) -> None:
    write_text(spark, path, json.dumps({"date": date, "times": times, "layer": layer, "generated_at": generated_at}))


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """None if there is none; a body that is no such JSON is an error."""
    text = read_text(spark, path)
    if text is None:
        return None
    body = json.loads(text)
    if not isinstance(body, dict) or not isinstance(body.get("times"), list):
        raise ValueError(f"{path} is no manifest")
    return body


def lon_lat(point: Column) -> Column:
    """array(lon, lat) of a metric point."""
    p = from_utm(point["x"], point["y"])
    return F.array(F.round(p["lon"], 6), F.round(p["lat"], 6))


def simplified(ring: Column, tolerance: float = SIMPLIFY) -> Column:
    """A closed ring without corners that lie within the tolerance of the line between kept ones (Douglas and Peucker).

    Each round looks at all stretches between kept corners at once and keeps the corner of each that is farthest off, if it
    is too far; a ring of n corners needs at most n rounds, and one that no corner is kept of is returned as it is. The ring is
    made once, however it is given."""
    return let(ring, lambda r: _simplified(r, tolerance))


def _simplified(ring: Column, tolerance: float) -> Column:
    point = lambda i: F.element_at(ring, i + 1)
    last = F.size(ring) - 1

    def farthest(i, j):
        a, b = point(i), point(j)
        off = lambda k: distance_to_segment(point(k)["x"], point(k)["y"], F.struct(a.alias("a"), b.alias("b")))
        inner = F.when(j - i > 1, F.sequence(i + 1, j - 1)).otherwise(F.array().cast("array<int>"))
        return F.array_max(F.transform(inner, lambda k: F.struct(off(k).alias("d"), (-k).alias("k"))))

    def split(kept):
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))), lambda i: farthest(F.element_at(kept, i), F.coalesce(F.get(kept, i), F.element_at(kept, i))))
        far = F.transform(F.filter(pairs, lambda p: p["d"] > tolerance), lambda p: -p["k"])
        return F.array_sort(F.concat(kept, far))

    rounds = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
    start = F.struct(F.array(F.lit(0), last).alias("kept"), F.lit(False).alias("done"))
    step = lambda acc, _: F.when(acc["done"], acc).otherwise(let(split(acc["kept"]), lambda k: F.struct(k.alias("kept"), (F.size(k) == F.size(acc["kept"])).alias("done"))))
    kept = F.aggregate(rounds, start, step)["kept"]
    return F.when(F.size(ring) < 4, ring).otherwise(let(kept, lambda k: F.when(F.size(k) >= 4, F.transform(k, point)).otherwise(ring)))


def polygon_features(parts: DataFrame, properties: list[str]) -> DataFrame:
    """(feature): a GeoJSON polygon per row of parts(rings, *properties)."""
    rings = F.transform(F.transform("rings", lambda r: simplified(r)), lambda r: F.transform(r, lon_lat))
    return parts.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"))).alias("feature"))


def line_features(lines: DataFrame, properties: list[str]) -> DataFrame:
    coords = F.transform("coords", lon_lat)
    return lines.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"))).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    """One feature a line; refuses to publish nothing."""
    if not features.limit(1).count():
        raise ValueError(f"{path} would be empty")
    features.write.mode("overwrite").text(path)


def valid_canopy(canopy: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """canopy(rings, height_m, height_source) for a map: every crown must have closed rings of at least four corners, an area, a height, and lie inside the box (x0, y0, x1, y1). One that has not is an error, as is no crown at all."""
    from heliospark.functions.geo import polygon_area

    inside = F.forall(F.flatten("rings"), lambda p: p["x"].between(box[0], box[2]) & p["y"].between(box[1], box[3]))
    closed = F.forall("rings", lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)))
    sound = (F.size("rings") > 0) & closed & inside & (F.col("height_m") > 0)
    ok = F.when(F.coalesce(sound, F.lit(False)), polygon_area(F.col("rings")) > 0).otherwise(False)
    n, bad = canopy.agg(F.count("*"), F.count_if(~ok)).first()
    if not n or bad:
        raise ValueError(f"{bad} of {n} crowns are not valid" if n else "no canopy is valid")
    return canopy


def replace_tree(canopy: DataFrame, root: str, box: tuple[float, float, float, float], keep: int = 2) -> str:
    """Crowns as features, validated, as the new published version under root (publish.current finds it); returns its folder."""
    from heliospark.sources.publish import publish

    return publish(canopy.sparkSession, root, lambda folder: write_features(polygon_features(valid_canopy(canopy, box), ["height_m", "height_source"]), folder), keep)


def drop_stale(spark: SparkSession, folder: str, written: list[str]) -> list[str]:
    """Deletes what a folder holds but `written`, and says which, in order."""
    fs, p = _fs(spark, folder)
    gone = sorted({s.getPath().getName() for s in (fs.listStatus(p) if fs.exists(p) else [])} - set(written))
    for name in gone:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
    return gone


FOLD_RULES = {"chars": KAZAKH_TO_RUSSIAN, "strip": STREET_WORDS, "translit": LATIN, "collapse": [list(p) for p in COLLAPSE]}


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """entries (entry, n, d, lat, lon, c, l) of what `index_json` wrote; a line that is no such object is an error when it is read."""
    rows = spark.read.schema("entry long, n string, d string, p array<double>, c string, l string").option("mode", "FAILFAST").json(path)
    return rows.select("entry", "n", "d", F.col("p")[0].alias("lat"), F.col("p")[1].alias("lon"), "c", "l")


class Index:
    """An index that is read when first asked for and then held; a failure is not held."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.held = spark, path, None

    def entries(self) -> DataFrame:
        if self.held is None:
            held = read_index(self.spark, self.path).persist()
            try:
                held.count()
            except Exception:
                held.unpersist()
                raise
            self.held = held
        return self.held


def index_json(entries: DataFrame) -> DataFrame:
    """(value): one JSON object per entry with the short keys that clients read; the rules stand beside them in FOLD_RULES."""
    return entries.orderBy("entry").select(F.to_json(F.struct("entry", "n", "d", F.array("lat", "lon").alias("p"), "c", "l")).alias("value"))
