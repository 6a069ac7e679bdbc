"""Exact Euclidean distance to the nearest place of a mask, axis by axis: no pairs, no rounds of a growing radius.

Along the first axis each line that holds places of the mask gets the squared distance to the nearest
one at every coordinate; along each further axis the lower envelope of the parabolas that stand on those
values gives the distance in one dimension more. A line is one array, as long as the image is wide.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lower_envelope(at: np.ndarray, height: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """min over i of (c - at[i])**2 + height[i] for c from lo to hi; at ascends."""
    top, edge = [0], [-np.inf]  # parabolas of the envelope and where each takes over
    a, h = at.tolist(), height.tolist()
    for i in range(1, len(a)):
        while True:
            j = top[-1]
            meet = ((h[i] + a[i] * a[i]) - (h[j] + a[j] * a[j])) / (2 * (a[i] - a[j]))
            if meet > edge[-1]:
                break
            top.pop()
            edge.pop()
        top.append(i)
        edge.append(meet)
    c = np.arange(lo, hi + 1)
    which = np.array(top)[np.searchsorted(np.array(edge), c, "left") - 1]
    return (c - at[which]) ** 2.0 + height[which]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _line(points: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    out = []
    for p, first, last in zip(points, lo, hi, strict=True):
        at, h = np.array([x["c"] for x in p], float), np.array([x["h"] for x in p], float)
        order = np.argsort(at)
        out.append(lower_envelope(at[order], h[order], int(first), int(last)))
    return pd.Series(out)


def distances(places: DataFrame, mask: DataFrame, by: list[str], axes: list[str], scale: dict[str, float] | None = None) -> DataFrame:
    """places with distance: from each place (by, axes: whole numbers) to its group's nearest place of mask; null in groups without one.

    scale: the length of a step along an axis (default 1), as slices are often farther apart than pixels.
    Places may lie outside the mask's extent and repeat; a mask may repeat places.
    """
    scale = scale or {}
    both = places.select(*by, *axes).unionByName(mask.select(*by, *axes))
    extent = both.groupBy(*by).agg(*[f(a).alias(f"{a}_{n}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))])
    now = mask.select(*by, *axes).distinct().withColumn("h_", F.lit(0.0))
    for axis in axes:
        step = float(scale.get(axis, 1.0)) ** 2  # heights in units of this axis
        rest = [a for a in axes if a != axis]
        lines = now.groupBy(*by, *rest).agg(F.collect_list(F.struct(F.col(axis).cast("long").alias("c"), (F.col("h_") / step).alias("h"))).alias("points"))
        lines = lines.join(extent.select(*by, f"{axis}_lo", f"{axis}_hi").hint("merge"), by) if by else lines.crossJoin(F.broadcast(extent))
        made = lines.select(*by, *rest, F.col(f"{axis}_lo").alias("lo_"), F.posexplode(_line("points", f"{axis}_lo", f"{axis}_hi")).alias("i_", "h_"))
        now = made.select(*by, *rest, (F.col("lo_") + F.col("i_")).cast(places.schema[axis].dataType).alias(axis), (F.col("h_") * step).alias("h_"))
    return places.join(now.select(*by, *axes, F.sqrt("h_").alias("distance")).hint("merge"), [*by, *axes], "left")


def shell_measures(distance: DataFrame, by: list[str], width: float, shells: int | None = None) -> dict[str, DataFrame]:
    """From (by, distance, value): shells (by, shell, n, mean), and summary (by, slope, auc) over the shells' means.

    A shell is width wide, from 0 on; places beyond `shells` of them (if given) or without a distance don't
    count. slope: of the means over the shells' middles, null with fewer than two; auc: their sum times width.
    """
    shell = F.floor(F.round(F.col("distance") / width, 9)).cast("int")
    per = distance.where("distance IS NOT NULL AND value IS NOT NULL").groupBy(*by, shell.alias("shell")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    per = per.where(F.col("shell") < shells) if shells else per
    summary = per.groupBy(*by).agg(F.regr_slope(F.col("mean"), (F.col("shell") + 0.5) * width).alias("slope"), (F.sum("mean") * width).alias("auc"))
    return {"shells": per, "summary": summary}
