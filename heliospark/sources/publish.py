"""Publishing a folder in one step: versions side by side, and a pointer that is renamed over the old one.

A reader follows the pointer, so it sees a whole version, the old one or the new one, whenever it looks and wherever a writer fails."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from heliospark.sources.files import _fs, read_text, write_text

POINTER = "CURRENT"


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the version that is published, or None."""
    name = read_text(spark, f"{root}/{POINTER}")
    return f"{root}/versions/{name.strip()}" if name else None


def publish(spark: SparkSession, root: str, write: Callable[[str], None], keep: int = 2) -> str:
    """Lets write(folder) fill a new version, points readers at it, and deletes all but the last `keep` versions. What write raises leaves the published one as it was, and its own rest is deleted."""
    fs, _ = _fs(spark, root)
    path = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{name}")
    before = versions(spark, root)
    name = f"{(int(before[-1].split('-')[0]) if before else 0) + 1:08d}-{uuid.uuid4().hex[:8]}"
    try:
        write(f"{root}/versions/{name}")
        write_text(spark, f"{root}/{POINTER}", name)
    except BaseException:
        if current(spark, root) != f"{root}/versions/{name}":
            fs.delete(path(name), True)
        raise
    for old in [*before, name][: -max(keep, 1)]:
        fs.delete(path(old), True)
    return f"{root}/versions/{name}"


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the versions that are there, oldest first."""
    fs, p = _fs(spark, f"{root}/versions")
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
