"""Periodicity of an image: the strongest wave of its windowed power spectrum."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvox.functions.lineage import few


def peak_wave(plane: np.ndarray, steps: tuple[float, float]) -> dict[str, float | None]:
    """The strongest wave of a plane (NaN: missing, taken as the mean) whose places lie so far apart along y and x.

    Ties within a billionth go to the first in rows of rising frequency.
    """
    height, width = plane.shape
    known = np.isfinite(plane)
    out = dict.fromkeys(("wavelength", "angle", "stripiness", "peak"))
    if known.sum() < 8 or height < 4 or width < 4:
        return out
    if plane[known].var() <= 1e-12 * max(1.0, plane[known].mean() ** 2):
        return {**out, "stripiness": 0.0, "peak": 0.0}
    hann = [0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)) for n in plane.shape]
    power = np.abs(np.fft.fft2(np.where(known, plane - plane[known].mean(), 0.0) * np.outer(*hann))) ** 2
    ky, kx = (np.where(np.arange(n) > n // 2, np.arange(n) - n, np.arange(n)) for n in plane.shape)
    half = (ky[:, None] > 0) | ((ky[:, None] == 0) & (kx[None] > 0))
    of_half = power[half]
    at = int(np.argmax(of_half >= of_half.max() * (1 - 1e-9)))
    y, x = np.argwhere(half)[at]
    fy, fx = ky[y] / (height * steps[0]), kx[x] / (width * steps[1])
    positive = of_half[of_half > 0]
    return {
        "wavelength": 1 / math.hypot(fx, fy),
        "angle": (90.0 - math.degrees(math.atan2(fy, fx)) % 180.0) % 180.0,
        "stripiness": of_half[at] / np.median(positive),
        "peak": of_half[at] / of_half.sum(),
    }


def spectrum(pixels: DataFrame, by: list[str], scale: tuple[float, float] = (1.0, 1.0), side: int = 128) -> DataFrame:
    """(by, wavelength, angle, stripiness, peak) of pixels (by, y, x, value).

    An image wider or higher than side is first reduced to means of whole blocks, so that a group's plane has
    at most side * side places whatever the size of the image. wavelength is in units of scale (the steps along y
    and x); angle: of the lines, counter-clockwise on the screen, in degrees below 180; stripiness: the peak's power
    over the median; peak: its share of all. Null with fewer than 8 known places or 4 rows or columns; a constant image has a
    stripiness and peak of 0.
    """
    there = pixels.select(*by, "y", "x", F.when(~F.isnan(F.col("value").cast("double")), F.col("value").cast("double")).alias("value"))
    extent = there.groupBy(*by).agg(*[f(a).cast("long").alias(f"{a}{n}") for a in "yx" for n, f in ((0, F.min), (1, F.max))])
    step = lambda a: F.ceil((F.col(f"{a}1") - F.col(f"{a}0") + 1) / side)
    extent = extent.withColumns({"sy": step("y"), "sx": step("x")})
    keys = [F.col(f"p.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by]
    placed = there.alias("p").join(few(extent).alias("e"), keys) if by else there.alias("p").crossJoin(F.broadcast(extent).alias("e"))
    block = lambda a: F.floor((F.col(f"p.{a}") - F.col(f"{a}0")) / F.col(f"s{a}")).alias(f"row_{a}")
    size = lambda a: F.ceil((F.col(f"{a}1") - F.col(f"{a}0") + 1) / F.col(f"s{a}")).alias(f"n{a}")
    own = [F.col(f"p.{c}").alias(c) for c in by]
    means = placed.select(*own, block("y"), block("x"), size("y"), size("x"), "sy", "sx", "value").groupBy(*by, "row_y", "row_x")
    means = means.agg(F.avg("value").alias("value"), *[F.first(c).alias(c) for c in ("ny", "nx", "sy", "sx")])
    names = ["wavelength", "angle", "stripiness", "peak"]

    def run(pdf):
        plane = np.full((int(pdf["ny"].iloc[0]), int(pdf["nx"].iloc[0])), np.nan)
        plane[pdf["row_y"].to_numpy(int), pdf["row_x"].to_numpy(int)] = pdf["value"].to_numpy(float)
        got = peak_wave(plane, (scale[0] * int(pdf["sy"].iloc[0]), scale[1] * int(pdf["sx"].iloc[0])))
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), *(got[n] for n in names)]], columns=[*by, *names]).astype(dict.fromkeys(names, "float64"))

    schema = T.StructType([*[pixels.schema[c] for c in by], *[T.StructField(n, T.DoubleType()) for n in names]])
    return means.groupBy(*by).applyInPandas(run, schema).select(*by, *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])
