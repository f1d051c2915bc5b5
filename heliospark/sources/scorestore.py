"""Shade scores as one dataset, partitioned by radius, date and stamp."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospark.constants import MIN_COVERAGE
from heliospark.sources.tables import exists, schema

KEYS = ["radius_m", "date", "stamp"]


def save(scores: DataFrame, root: str, files_per_stamp: int = 1) -> None:
    """scores(radius_m, date, stamp, u, v, key, shade_fraction); only the partitions that it holds are replaced. A stamp is written by `files_per_stamp` tasks, whatever the tasks that scored it."""
    out = scores.select("u", "v", "key", F.col("shade_fraction").cast("float").alias("shade_fraction"), "radius_m", F.col("date").cast("date").alias("date"), "stamp")
    out = out.repartition(*KEYS, F.pmod(F.xxhash64("u", "v"), F.lit(files_per_stamp)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*KEYS).parquet(root)


def scan(spark: SparkSession, root: str) -> DataFrame:
    if not exists(spark, root):
        return spark.createDataFrame([], schema("scores"))
    return spark.read.schema(schema("scores")).parquet(root)


def align(edges: DataFrame, scores: DataFrame, least: float = MIN_COVERAGE) -> DataFrame | None:
    """edges(edge_id, u, v, key) with shade, gaps 0; None if fewer than `least` of the edges have a score."""
    s = scores.select("u", "v", "key", F.col("shade_fraction").alias("shade"))
    out = edges.select("edge_id", "u", "v", "key").join(s, ["u", "v", "key"], "left")
    there = out.agg(F.avg(F.when(F.col("shade").isNotNull(), 1.0).otherwise(0.0))).first()[0]
    return None if there is None or there < least else out.select("edge_id", F.coalesce("shade", F.lit(0.0).cast("float")).alias("shade"))


def load(spark: SparkSession, root: str, radius_m: int, date: dt.date, stamp: str, edges: DataFrame) -> DataFrame | None:
    """The scores of one stamp by edge, or None if they are absent or cover too little."""
    part = scan(spark, root).where((F.col("radius_m") == radius_m) & (F.col("date") == date) & (F.col("stamp") == stamp))
    return align(edges, part) if part.limit(1).count() else None


def partitions(spark: SparkSession, root: str) -> list[tuple[int, dt.date, str]]:
    """(radius, date, stamp) of what is there, from the folders' names; no file is opened."""
    if not exists(spark, root):
        return []
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/radius_m=*/date=*/stamp=*")) or []:
        v = [x.split("=", 1)[1].replace("%3A", ":") for x in s.getPath().toString().split("/")[-3:]]
        out.append((int(v[0]), dt.date.fromisoformat(v[1]), v[2]))
    return sorted(out)


def missing(spark: SparkSession, root: str, radius_m: int, date: dt.date, stamps: list[str]) -> list[str]:
    have = {s for r, d, s in partitions(spark, root) if (r, d) == (radius_m, date)}
    return [s for s in stamps if s not in have]


def prune(spark: SparkSession, root: str, keep: dt.date) -> list[dt.date]:
    """Deletes the partitions of other dates, and says which."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = sorted({(r, d) for r, d, _ in partitions(spark, root) if d != keep})
    for r, d in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/radius_m={r}/date={d.isoformat()}"), True)
    return sorted({d for _, d in gone})


def release_date(spark: SparkSession, root: str) -> dt.date:
    """The one date that there are scores of."""
    dates = sorted({d for _, d, _ in partitions(spark, root)})
    if len(dates) != 1:
        raise ValueError(f"one date is expected, there are {len(dates)}: {', '.join(map(str, dates))}")
    return dates[0]


def day_scores(spark: SparkSession, root: str, radius_m: int, date: dt.date, stamps: list[str], edges: DataFrame) -> DataFrame | None:
    """(stamp_idx, edge_id, shade) of a whole day, or None if any stamp is absent or covers too little. One scan for all stamps."""
    if missing(spark, root, radius_m, date, stamps):
        return None
    part = scan(spark, root).where((F.col("radius_m") == radius_m) & (F.col("date") == date) & F.col("stamp").isin(stamps))
    idx = F.array_position(F.array(*map(F.lit, stamps)), F.col("stamp")).cast("int") - 1
    met = edges.select("edge_id", "u", "v", "key").join(part, ["u", "v", "key"]).select(idx.alias("stamp_idx"), "edge_id", F.col("shade_fraction").alias("shade"))
    n = edges.count()
    counts = {r["stamp_idx"]: r["count"] for r in met.groupBy("stamp_idx").count().collect()}  # one row per stamp
    return met if n and all(counts.get(i, 0) >= MIN_COVERAGE * n for i in range(len(stamps))) else None


def coverage(edges: DataFrame, scores: DataFrame, stamps: list[str]) -> DataFrame:
    """(stamp, n_edges, n_scored, valid): for every stamp asked for, how many different edges it scores, and whether all scores of the network's edges are shares."""
    keys = ["u", "v", "key"]
    asked = F.explode(F.array(*map(F.lit, stamps))) if stamps else F.explode(F.array().cast("array<string>"))
    e = edges.select(*keys).distinct()
    all_pairs = e.select(*keys, asked.alias("stamp"))
    good = F.col("shade_fraction").between(0, 1) & ~F.isnan("shade_fraction")
    seen = scores.groupBy(*keys, "stamp").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("good"))
    met = all_pairs.join(seen, [*keys, "stamp"], "left")
    return met.groupBy("stamp").agg(F.count("*").alias("n_edges"), F.count("good").alias("n_scored"), F.coalesce(F.bool_and("good"), F.lit(True)).alias("valid"))


def validate(spark: SparkSession, root: str, radius_m: int, date: dt.date, stamps: list[str], edges: DataFrame) -> list[str]:
    """What is wrong with a day's scores; nothing if it may be released. Scores of another network's edges cover nothing."""
    wrong = [] if stamps else ["no daylight stamp"]
    wrong += [f"{s} is missing" for s in missing(spark, root, radius_m, date, stamps)]
    if not edges.limit(1).count():
        return [*wrong, "no edges"]
    part = scan(spark, root).where((F.col("radius_m") == radius_m) & (F.col("date") == date))
    there = [s for r, d, s in partitions(spark, root) if (r, d) == (radius_m, date)]
    for r in coverage(edges, part, there).orderBy("stamp").collect():  # a row per stamp
        if r["n_scored"] < MIN_COVERAGE * r["n_edges"]:
            wrong.append(f"{r['stamp']} covers {r['n_scored']} of {r['n_edges']} edges")
        if not r["valid"]:
            wrong.append(f"{r['stamp']} has shade outside 0 to 1")
    return wrong
