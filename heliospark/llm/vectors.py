"""What the vector operators share: exact integer vectors, samples by hash, and results of blocks.

A vector takes part if it is not null and no component is null, non-finite or, multiplied and floored, above 2^27
in size (its products would not fit into a long). Scores and squares are whole numbers: they are counted
in doubles where every sum stays below 2^53, else in longs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1 << 27


def floored(column: pa.Array, factor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists: which rows take part, the lengths of those, and their components times factor, floored, end to end."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = pc.list_flatten(column).cast(pa.float64())
    x = np.floor(np.asarray(pc.fill_null(flat, np.nan), np.float64) * factor)
    bad = ~(np.abs(x) <= LIMIT)
    row = np.repeat(np.arange(len(lengths)), lengths)
    keep = np.asarray(column.is_valid(), bool)
    keep[row[bad]] = False
    return keep, lengths[keep], np.where(bad, 0, x).astype(np.int64)[keep[row]]


def matrix(lengths: np.ndarray, flat: np.ndarray, width: int) -> np.ndarray:
    """Rows of width, filled up with zeros."""
    out = np.zeros((len(lengths), width), np.int32)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = flat
    return out


def packed(x: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    x = np.ascontiguousarray(x)
    return pa.array([r.tobytes() for r in x], pa.binary())


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), width)


def exact(x: np.ndarray, top: int | None = None) -> np.ndarray:
    """x in doubles if no sum of products can reach 2^53 with components up to top, else in longs."""
    top = int(np.abs(x).max(initial=0)) if top is None else top
    return x.astype(np.float64 if top * top * max(1, x.shape[1]) < 1 << 53 else np.int64)


def whole_vectors(df: DataFrame, factor: int) -> DataFrame:
    """df (its other columns first, embedding last) with the floored vector as v array<int> in place of embedding, of the rows whose vector takes part."""
    others = df.columns[:-1]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others) + ", v array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, lengths, flat = floored(b.column(len(others)), factor)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(keep)) for c in b.columns[:-1]), lists], names=[*others, "v"])

    return df.mapInArrow(run, schema)


def by_hash(vec_id: Column, seed: str) -> Column:
    """Where an id stands in an order that does not follow ids: the hex sha256 of `seed:vec_id`."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")), 256)


def sample(rows: DataFrame, most: int, seed: str) -> tuple[np.ndarray, list[tuple]]:
    """The vectors v of at most `most` rows, the first by hash of their vec_id, in one matrix, and the rows."""
    got = rows.orderBy(by_hash(F.col("vec_id"), seed), "v").limit(most).collect()
    width = max((len(r["v"]) for r in got), default=0)
    return matrix(np.array([len(r["v"]) for r in got], np.int64), np.array([x for r in got for x in r["v"]], np.int64), width), got


def lists_to_matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of whole lists without nulls as rows of width."""
    return matrix(np.asarray(pc.list_value_length(column), np.int64), np.asarray(pc.list_flatten(column), np.int64), width)
