"""Local work on pixels in square tiles with a border: each pixel goes to the few tiles whose border holds it.

A tile is an array of bounded size, whatever the size of its image, so sums over windows of any reach
cost one shuffle and a cumulative sum.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def box_sums(a: np.ndarray, reach: int) -> np.ndarray:
    """Sums of a over the square window around each place that has a whole one."""
    w = 2 * reach + 1
    c = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    np.cumsum(np.cumsum(a, 0), 1, out=c[1:, 1:])
    return c[w:, w:] - c[:-w, w:] - c[w:, :-w] + c[:-w, :-w]


def _spread(df: DataFrame, by: list[str], values: list[str], reach: int, size: int) -> DataFrame:
    """Each pixel in every tile (ty, tx) that it lies in or whose border holds it."""
    cells = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size)))
    return df.select(*by, "y", "x", *[F.col(v).cast("double").alias(v) for v in values]).withColumn("ty", cells("y")).withColumn("tx", cells("x"))


def _arrays(pdf, values: list[str], reach: int, size: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Arrays of a tile with its border, NaN where there is no pixel, and its rows' places in them."""
    edge = size + 2 * reach
    y = pdf["y"].to_numpy(np.int64) - (int(pdf["ty"].iloc[0]) * size - reach)
    x = pdf["x"].to_numpy(np.int64) - (int(pdf["tx"].iloc[0]) * size - reach)
    arrays = {}
    for v in values:
        arrays[v] = np.full((edge, edge), np.nan)
        arrays[v][y, x] = pdf[v].to_numpy(float)
    return arrays, y, x


def tiled(df: DataFrame, by: list[str], values: list[str], reach: int, run: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], out: list[str], size: int = 256) -> DataFrame:
    """(by, y, x, out) for every pixel of df (by, y, x, values): y and x are whole numbers, a place occurs once in its group.

    run gets arrays of a tile with its border, NaN where there is no pixel (or null), and returns arrays
    of the tile alone. Nulls in by make a group of their own.
    """
    schema = T.StructType([*[df.schema[c] for c in by], T.StructField("y", T.LongType()), T.StructField("x", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in out]])

    def tile(pdf):
        top, left = int(pdf["ty"].iloc[0]) * size - reach, int(pdf["tx"].iloc[0]) * size - reach
        arrays, y, x = _arrays(pdf, values, reach, size)
        made = run(arrays)
        own = (y >= reach) & (y < reach + size) & (x >= reach) & (x < reach + size)
        result = pdf.loc[own, by].copy()
        result["y"], result["x"] = y[own] + top, x[own] + left
        for c in out:
            result[c] = made[c][y[own] - reach, x[own] - reach]
        return result

    got = _spread(df, by, values, reach, size).groupBy(*by, "ty", "tx").applyInPandas(tile, schema)
    return got.select(*by, F.col("y").cast(df.schema["y"].dataType).alias("y"), F.col("x").cast(df.schema["x"].dataType).alias("x"), *out)


def tile_sums(df: DataFrame, by: list[str], values: list[str], reach: int, run: Callable[[dict[str, np.ndarray]], dict[str, float]], size: int = 256) -> DataFrame:
    """(by, name, total): sums over a group's tiles of what run gives for each, from arrays as in `tiled`.

    run's sums must be over the places of the tile alone: those of the border belong to other tiles.
    """
    schema = T.StructType([*[df.schema[c] for c in by], T.StructField("name", T.StringType()), T.StructField("sum", T.DoubleType())])

    def tile(pdf):
        arrays, _, _ = _arrays(pdf, values, reach, size)
        sums = {k: x for k, x in run(arrays).items() if x}
        # a tile without any still tells that its group is there
        sums = sums or {"": 0.0}
        out = pdf[by].iloc[[0] * len(sums)].reset_index(drop=True)
        out["name"], out["sum"] = list(sums), list(sums.values())
        return out

    got = _spread(df, by, values, reach, size).groupBy(*by, "ty", "tx").applyInPandas(tile, schema)
    return got.groupBy(*by, "name").agg(F.sum("sum").alias("total"))
