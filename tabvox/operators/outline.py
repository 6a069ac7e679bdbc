"""Outlines of objects: convex hull, its area, solidity and Feret diameters, from mergeable extremes of rows.

A hull needs only the first and last pixel of each row of an object, which are partial minima and
maxima; the hull is then found on an array of at most two points a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HULL = T.StructType([T.StructField("hull", T.ArrayType(T.ArrayType(T.LongType()))), *[T.StructField(c, T.DoubleType()) for c in ("hull_area", "feret", "least_feret", "feret_angle")]])


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of distinct whole points (x, y), counter-clockwise; points on its sides are left out."""
    p = points[np.lexsort((points[:, 1], points[:, 0]))].tolist()

    def chain(run):
        out = []
        for x, y in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out

    if len(p) < 2:
        return np.array(p)
    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def calipers(hull: np.ndarray) -> tuple[float, float, float]:
    """Largest distance of two corners, least width between parallel lines, and the angle of the largest one in degrees, 0 to 180.

    The calipers turn about the hull: for each side the farthest corner is found by going on from the last one's.
    """
    n, h = len(hull), hull.astype(float).tolist()
    if n < 2:
        return 0.0, 0.0, 0.0
    if n == 2:
        (ax, ay), (bx, by) = h
        return float(np.hypot(bx - ax, by - ay)), 0.0, float(np.degrees(np.arctan2(by - ay, bx - ax)) % 180)
    best, width, angle, j = -1.0, np.inf, 0.0, 1

    def height(i, k):
        (ax, ay), (bx, by), (cx, cy) = h[i], h[(i + 1) % n], h[k % n]
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    for i in range(n):
        j = max(j, i + 1)
        while height(i, j + 1) > height(i, j):
            j += 1
        (ax, ay), (bx, by) = h[i], h[(i + 1) % n]
        width = min(width, height(i, j) / np.hypot(bx - ax, by - ay))
        far = (j, j + 1) if height(i, j + 1) == height(i, j) else (j,)
        for k in far:
            cx, cy = h[k % n]
            for px, py in ((ax, ay), (bx, by)):
                d = (cx - px) ** 2 + (cy - py) ** 2
                turn = float(np.degrees(np.arctan2(cy - py, cx - px)) % 180)
                if d > best or d == best and turn < angle:
                    best, angle = d, turn
    return float(np.sqrt(best)), float(width), angle


@F.pandas_udf(_HULL)
def _measured(points: pd.Series) -> pd.DataFrame:
    rows = []
    for p in points:
        hull = convex_hull(np.array([[q["x"], q["y"]] for q in p], np.int64))
        x, y = hull[:, 0].astype(float), hull[:, 1].astype(float)
        rows.append((hull.tolist(), abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2, *calipers(hull)))
    return pd.DataFrame(rows, columns=[f.name for f in _HULL.fields])


def outlines(labels: DataFrame, by: list[str], pixel: float = 1.0, least: int = 3) -> DataFrame:
    """(by, label, area, hull, hull_area, solidity, feret, least_feret, feret_angle) of positive labels (by, y, x, label), with slices laid over each other.

    hull: the corners (x, y) of the convex hull of the pixels' middles, counter-clockwise. Its area is the
    pixels' own where that is larger, as with thin objects, so solidity is 1 at most. feret: the largest
    distance of two pixels; least_feret: the least width between parallel lines; feret_angle in degrees, of
    several the smallest. pixel: length of a pixel's side. Objects of fewer than `least` pixels are left out.
    """
    own = labels.where("label > 0").select(*by, "label", "y", "x").distinct()
    rows = own.groupBy(*by, "label", "y").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    ends = F.flatten(F.collect_list(F.array(*[F.struct(F.col(c).cast("long").alias("x"), F.col("y").cast("long").alias("y")) for c in ("x0", "x1")])))
    m = rows.groupBy(*by, "label").agg(F.sum("n").alias("n"), F.array_distinct(ends).alias("ends")).where(F.col("n") >= least)
    m = m.withColumn("m", _measured("ends"))
    hull_area = F.greatest(F.col("m.hull_area"), F.col("n").cast("double"))
    return m.select(*by, "label", (F.col("n") * pixel**2).alias("area"), "m.hull", (hull_area * pixel**2).alias("hull_area"), (F.col("n") / hull_area).alias("solidity"), (F.col("m.feret") * pixel).alias("feret"), (F.col("m.least_feret") * pixel).alias("least_feret"), "m.feret_angle")
