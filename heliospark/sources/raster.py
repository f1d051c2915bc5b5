"""Rasters as tables of square tiles, and windows cut out of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.operators.near import cells

SIZE = 256


def tiled(pixels: DataFrame, size: int = SIZE) -> DataFrame:
    """(tile_row, tile_col, pixels) of pixels(row, col, value): a tile's values as float32 bytes, row by row, 0 where there is no pixel; of several, the highest counts."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((size, size), -np.inf, np.float32)
        np.maximum.at(grid, (pdf["row"].to_numpy() - key[0] * size, pdf["col"].to_numpy() - key[1] * size), pdf["value"].to_numpy(np.float32))
        return pd.DataFrame({"tile_row": [key[0]], "tile_col": [key[1]], "pixels": [np.where(np.isinf(grid), 0, grid).astype(np.float32).tobytes()]})

    at = lambda c: F.floor(F.col(c) / size).cast("long")
    # pixels that repeat are one before they are shuffled, so a tile's group has at most size * size rows
    p = pixels.where("value is not null").groupBy(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).agg(F.max("value").cast("double").alias("value"))
    return p.withColumn("tr", at("row")).withColumn("tc", at("col")).groupBy("tr", "tc").applyInPandas(pack, "tile_row long, tile_col long, pixels binary")


def windows(tiles: DataFrame, asked: DataFrame, size: int = SIZE, fill: float = 0.0) -> DataFrame:
    """(window_id, height, width, pixels) of asked(window_id, row, col, height, width): the pixels from a corner on, `fill` wherever no tile is.

    A window may lie across tiles or beyond the raster's edge; it keeps its shape, so no pixel slides. Windows and tiles meet by the tiles that a window
    touches; a tile is cut to a window's part of it before it is shuffled on, and the parts are put together per window."""
    row, col, last_row, last_col = F.col("row").cast("long"), F.col("col").cast("long"), F.col("row") + F.col("height") - 1, F.col("col") + F.col("width") - 1
    need = asked.select("*", F.explode(cells(row, col, last_row, last_col, size)).alias("c")).select("window_id", "row", "col", "height", "width", F.col("c.cx").alias("tile_row"), F.col("c.cy").alias("tile_col"))
    schema = "window_id long, row long, col long, height long, width long, top long, left long, rows long, pixels binary"

    def cut(batches):
        for pdf in batches:
            out = []
            for w in pdf.itertuples(index=False):
                top, left = max(w.row, w.tile_row * size), max(w.col, w.tile_col * size)
                bottom, right = min(w.row + w.height, (w.tile_row + 1) * size), min(w.col + w.width, (w.tile_col + 1) * size)
                grid = np.full((size, size), fill, np.float32) if w.pixels is None else np.frombuffer(w.pixels, np.float32).reshape(size, size)
                part = grid[top - w.tile_row * size : bottom - w.tile_row * size, left - w.tile_col * size : right - w.tile_col * size]
                out.append((w.window_id, w.row, w.col, w.height, w.width, top - w.row, left - w.col, bottom - top, part.tobytes()))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        grid = np.full((first["height"], first["width"]), fill, np.float32)
        for top, left, rows, data in zip(pdf["top"], pdf["left"], pdf["rows"], pdf["pixels"], strict=True):
            part = np.frombuffer(data, np.float32).reshape(rows, -1)
            grid[top : top + rows, left : left + part.shape[1]] = part
        return pd.DataFrame({"window_id": [first["window_id"]], "height": [first["height"]], "width": [first["width"]], "pixels": [grid.tobytes()]})

    met = need.join(tiles, ["tile_row", "tile_col"], "left").select("window_id", *[F.col(c).cast("long").alias(c) for c in ("row", "col", "height", "width", "tile_row", "tile_col")], "pixels")
    return met.mapInPandas(cut, schema).groupBy("window_id").applyInPandas(whole, "window_id long, height long, width long, pixels binary")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def values(pixels: pd.Series) -> pd.Series:
    """A tile's or a window's values, row by row."""
    return pixels.map(lambda b: None if b is None else np.frombuffer(b, np.float32))
