"""Where operators keep intermediate tables, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset and all tasks run in this process' machine, an error on a cluster."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="heliospark-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders of the tables that `stored` has written and nobody has dropped.
TABLES: list[str] = []
#: Rows up to which keys are broadcast, some 20 MB of the driver's memory for ids; they are counted first, and more of them meet the other side in a shuffle.
BROADCAST_KEYS = 250_000


def small(keys: DataFrame) -> DataFrame:
    """A stored table of keys, with a hint to broadcast it if it has at most BROADCAST_KEYS rows, or else to shuffle both sides and hash the keys."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys.hint("shuffle_hash")


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written to the shared folder and read back: the lineage ends there, and a lost executor loses nothing. The folder is the result's hs_path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    TABLES.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.hs_path = path
    return out


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of `stored` that nothing will read again."""
    for path in paths:
        hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
        TABLES.remove(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def fresh(name: str, taken: list[str]) -> str:
    """name, or a longer one that none of the columns has, whatever their case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
