"""Geometries of files: GeoJSON text and well-known binary, as rings of points, and filters by their type."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = ["Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon"]


def geojson_type(text: Column) -> Column:
    """Of a geometry, or of a feature's geometry."""
    return F.coalesce(F.get_json_object(text, "$.geometry.type"), F.get_json_object(text, "$.type"))


def from_geojson(text: Column) -> Column:
    """struct(type, rings): a point or a line is one ring of its own points, a multipolygon all rings of its parts (the even-odd rule needs no more). Null for what is no geometry."""
    kind = geojson_type(text)
    coords = F.coalesce(F.get_json_object(text, "$.geometry.coordinates"), F.get_json_object(text, "$.coordinates"))
    read = lambda depth: F.from_json(coords, "array<" * depth + "double" + ">" * depth)
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    ring = lambda r: F.transform(r, point)
    rings = (
        F.when(kind == "Point", F.array(F.array(point(read(1)))))
        .when(kind.isin("LineString", "MultiPoint"), F.array(ring(read(2))))
        .when(kind.isin("Polygon", "MultiLineString"), F.transform(read(3), ring))
        .when(kind == "MultiPolygon", F.transform(F.flatten(read(4)), ring))
    )
    return F.when(kind.isin(TYPES) & rings.isNotNull(), F.struct(kind.alias("type"), rings.alias("rings")))


def tagged(rows: DataFrame, text: str, tags: list[str]) -> DataFrame:
    """Extracted features, a GeoJSON feature a row, as a table: element and id (of "way/12", or of @type and @id), the tags asked for (null where a feature has none), and its geometry. Rows that are no feature with a geometry are left out."""
    at = lambda *path: F.get_json_object(text, "$" + "".join(f"['{p}']" for p in path))
    name = F.coalesce(at("id"), at("properties", "@id"), at("properties", "id"))
    element = F.coalesce(F.nullif(F.regexp_extract(name, "^([a-z]+)/[0-9]+$", 1), F.lit("")), at("properties", "@type"), at("properties", "element"))
    number = F.nullif(F.regexp_extract(name, "([0-9]+)$", 1), F.lit("")).cast("long")
    return rows.select(element.alias("element"), number.alias("id"), *[at("properties", t).alias(t) for t in tags], from_geojson(F.col(text)).alias("geometry")).where("geometry is not null")


def _wkb(data: bytes | None) -> dict | None:
    if not data:
        return None
    at = 0

    def take(form: str, order: str):
        nonlocal at
        out = struct.unpack_from(order + form, data, at)
        at += struct.calcsize(order + form)
        return out

    def one() -> tuple[int, list]:
        order = "<" if take("B", "<")[0] else ">"
        code = take("I", order)[0]
        if code & 0x20000000:  # a reference system stands before the points
            take("I", order)
        size = 2 + bool(code & 0x80000000 or code % 10_000 // 1000 in (1, 3)) + bool(code & 0x40000000 or code % 10_000 // 1000 in (2, 3))
        kind = (code & 0xFFFF) % 1000
        points = lambda n: [dict(zip("xy", take("d" * size, order)[:2], strict=True)) for _ in range(n)]
        if kind == 1:
            return kind, [points(1)]
        n = take("I", order)[0]
        if kind == 2:
            return kind, [points(n)]
        if kind == 3:
            return kind, [points(take("I", order)[0]) for _ in range(n)]
        return kind, [ring for _ in range(n) for ring in one()[1]]

    try:
        kind, rings = one()
        return {"type": TYPES[kind - 1], "rings": rings}
    except (struct.error, IndexError):
        return None


POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("rings", T.ArrayType(T.ArrayType(POINT)))])


@F.pandas_udf(GEOMETRY)
def from_wkb(data: pd.Series) -> pd.DataFrame:
    """struct(type, rings) of well-known binary, read in Arrow batches; nulls for what is none."""
    found = [_wkb(x) or {"type": None, "rings": None} for x in data]
    return pd.DataFrame(found, columns=["type", "rings"])


def of_types(rows: DataFrame, geometry: str, types: list[str]) -> DataFrame:
    """The rows whose geometry (a struct of type and rings) is of one of the types, with `rings` in place of it."""
    return rows.where(F.col(geometry)["type"].isin(types)).withColumn("rings", F.col(geometry)["rings"]).drop(geometry)


def polygons(rows: DataFrame, geometry: str) -> DataFrame:
    return of_types(rows, geometry, ["Polygon", "MultiPolygon"])


def lines(rows: DataFrame, geometry: str) -> DataFrame:
    """A row per line, with its coords."""
    return of_types(rows, geometry, ["LineString", "MultiLineString"]).withColumn("coords", F.explode("rings")).drop("rings")


def geo_metadata(spark: SparkSession, path: str) -> dict:
    """The `geo` entry of a GeoParquet file's footer, or of the first file of a folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if fs.getFileStatus(p).isDirectory():
        files = sorted(str(s.getPath()) for s in fs.listStatus(p) if str(s.getPath()).endswith(".parquet"))
        if not files:
            raise ValueError(f"{path} holds no Parquet file")
        p = jvm.org.apache.hadoop.fs.Path(files[0])
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(p, conf))
    try:
        text = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()
    if not text:
        raise ValueError(f"{path} has no geo metadata")
    return json.loads(text)


def scan_geoparquet(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A GeoParquet file's rows with its primary column as geometry, struct(type, rings).

    box (x0, y0, x1, y1), in the file's own coordinates, keeps rows whose box meets it. Where the metadata names a covering box column the test is one on
    plain columns, which row groups are skipped by; without one it is made on the decoded points."""
    meta = geo_metadata(spark, path)
    name = meta["primary_column"]
    column = meta["columns"][name]
    if column.get("encoding") != "WKB":
        raise ValueError(f"{path}: {name} is encoded as {column.get('encoding')}, not as WKB")
    rows = spark.read.parquet(path)
    cover = (column.get("covering") or {}).get("bbox")
    if box and cover:
        at = {k: F.col(".".join(f"`{x}`" for x in v)) for k, v in cover.items()}
        rows = rows.where((at["xmin"] <= box[2]) & (at["xmax"] >= box[0]) & (at["ymin"] <= box[3]) & (at["ymax"] >= box[1]))
    out = rows.withColumn("__geometry", from_wkb(F.col(f"`{name}`"))).drop(name).withColumnRenamed("__geometry", "geometry")
    if box and not cover:
        points = F.flatten("geometry.rings")
        xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
        out = out.where((F.array_min(xs) <= box[2]) & (F.array_max(xs) >= box[0]) & (F.array_min(ys) <= box[3]) & (F.array_max(ys) >= box[1]))
    return out
