"""Typed tables. A column that a file lacks is read as null; nothing is inferred."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.functions.geo import RING, RINGS

SCHEMAS = {
    "edges": "edge_id long, u long, v long, key int, length double",
    "nodes": "node_id long, x double, y double",
    "edge_shapes": f"edge_id long, coords {RING}",
    "buildings": f"element string, id long, building string, height string, `building:levels` string, name string, `addr:street` string, rings {RINGS}",
    "trees": f"element string, id long, natural string, leaf_type string, leaf_cycle string, species string, coords {RING}",
    "canopy": f"rings {RINGS}, height_m double, height_source string",
    "places": "element string, id long, name string, amenity string, leisure string, shop string, tourism string, lat double, lon double",
    "scores": "radius_m int, date date, stamp string, u long, v long, key int, shade_fraction float",
    "overrides": "osm_element string, osm_id long, levels string, source string",
    "queue": "osm_element string, osm_id long, area_m2 double, lat double, lon double, shadow_mass double, url string",
    "pixels": "row int, col int, value double",
    "weather": "time string, temperature_c double, apparent_temperature_c double, cloud_cover_percent double, precipitation_mm double",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, path: str, name: str, written_by: str = "") -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is missing" + (f"; {written_by} writes it" if written_by else ""))
    return spark.read.schema(schema(name)).parquet(path)


def read_optional(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The table, or an empty one of its columns."""
    return read(spark, path, name) if exists(spark, path) else spark.createDataFrame([], schema(name))


def network(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges, nodes and shapes of one folder, all three or none."""
    return tuple(read(spark, f"{folder}/{name}", name, "write_network()") for name in ("edges", "nodes", "edge_shapes"))


def write_network(edges: DataFrame, nodes: DataFrame, shapes: DataFrame, folder: str) -> None:
    for name, df in (("edges", edges), ("nodes", nodes), ("edge_shapes", shapes)):
        df.select(*schema(name).names).write.mode("overwrite").parquet(f"{folder}/{name}")


def canopy(spark: SparkSession, folder: str) -> DataFrame:
    """Measured crowns where there are any, else the lattice's, else none."""
    for name in ("canopy_measured", "canopy_lattice"):
        if exists(spark, f"{folder}/{name}"):
            return read(spark, f"{folder}/{name}", "canopy")
    return spark.createDataFrame([], schema("canopy"))


def write_canopy(canopy: DataFrame, folder: str, measured: bool) -> None:
    """The crowns that `canopy` reads: measured ones, or those of the lattice."""
    canopy.select(*schema("canopy").names).write.mode("overwrite").parquet(f"{folder}/canopy_{'measured' if measured else 'lattice'}")


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """(osm_element, osm_id, levels) from a CSV file; a key that stands twice is an error, and levels that are no number are dropped."""
    from heliospark.functions.tags import parse_numeric

    if not exists(spark, path):
        return spark.createDataFrame([], "osm_element string, osm_id long, levels double")
    rows = spark.read.schema(schema("overrides")).option("header", True).csv(path)
    twice = rows.groupBy("osm_element", "osm_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['osm_element']} {twice[0]['osm_id']} has more than one override")
    return rows.select("osm_element", "osm_id", parse_numeric(F.col("levels")).alias("levels")).where("levels is not null")


def read_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A CSV of known columns; one that is missing or empty is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema(name))
    return spark.read.schema(schema(name)).option("header", True).csv(path)


def upsert(current: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of answers in place of those of the same key."""
    return current.join(answers, keys, "left_anti").unionByName(answers)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset and all tasks run on this machine, an error on a cluster."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="heliospark-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, kind: str = "tables") -> str:
    """A new path in the shared folder; what is written there goes when the JVM ends."""
    path = f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written to the shared folder and read back, which ends its lineage. The folder goes with `dropped`, or when the JVM ends."""
    spark = df.sparkSession
    path = scratch(spark)
    (df.write.partitionBy(*partition_by) if partition_by else df.write).mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.hs_path = path
    return out


def dealt(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df over as many tasks as it has lots of rows: a table of few files is few tasks, however long each row takes."""
    return df.repartition(df.count() // rows + 1)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of `stored` that nothing will read again."""
    for t in tables:
        if path := getattr(t, "hs_path", None):
            p = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
