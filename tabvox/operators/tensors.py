"""Symmetric 3 x 3 tensors: their eigenvectors, and the direction of structures in space."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("values", "v1", "v2", "v3")]))
def eigen3(xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, xz: pd.Series, yz: pd.Series) -> pd.DataFrame:
    """Eigenvalues of symmetric tensors from the largest on, and their unit vectors (x, y, z); nulls where a part is null."""
    a = np.stack([np.stack(r, -1) for r in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], -1).astype(float)
    known = np.isfinite(a).all((1, 2))
    values, vectors = np.linalg.eigh(np.where(known[:, None, None], a, 0.0))
    values, vectors = values[:, ::-1], vectors[:, :, ::-1]
    # of the two signs of a vector the one whose first part that isn't 0 is positive
    for k in range(3):
        v = vectors[:, :, k]
        lead = np.take_along_axis(v, (np.abs(v) > 1e-9).argmax(1)[:, None], 1)
        vectors[:, :, k] = np.where(lead < 0, -v, v)
    parts = {"values": values, **{f"v{k + 1}": vectors[:, :, k] for k in range(3)}}
    return pd.DataFrame({n: [x.tolist() if ok else None for x, ok in zip(p, known, strict=True)] for n, p in parts.items()})


def anisotropy3d(voxels: DataFrame, by: list[str], scale: tuple[float, float, float] = (1.0, 1.0, 1.0), bins: int = 18, least: float = 1e-9, slices: int = 5) -> DataFrame:
    """(by, coherency, angle, entropy) of the summed structure tensor of voxels (by, z, y, x, value).

    scale: the steps along z, y, x. Gradients are central differences, one-sided where a neighbour lacks and 0
    where both do. coherency: the two largest eigenvalues' difference over the sum of the three; angle: of
    the strongest gradient's direction in the plane, plus 90 degrees, within [0, 180); entropy: of the planar angles
    over the bins, 1 if even. Null in groups of fewer than 8 voxels or so many slices, or without gradients.
    """
    steps = [(0, 0, 0), *[tuple(s if i == a else 0 for i in range(3)) for a in range(3) for s in (1, -1)]]
    sent = voxels.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).select(
        *by, "value", F.inline(F.array(*[F.struct(*[(F.col(c) - d).alias(c) for c, d in zip("zyx", o, strict=True)], F.lit(k).alias("k")) for k, o in enumerate(steps)]))
    )
    near = sent.groupBy(*by, "z", "y", "x").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"v{k}") for k in range(7)]).where("v0 IS NOT NULL")

    def slope(after, before, step):
        sides = F.col(after).isNotNull().cast("int") + F.col(before).isNotNull().cast("int")
        return (F.coalesce(after, "v0") - F.coalesce(before, "v0")) / (step * F.greatest(F.lit(1), sides))

    g = near.select(*by, "z", *[slope(f"v{2 * i + 1}", f"v{2 * i + 2}", scale[i]).alias(f"g{c}") for i, c in enumerate("zyx")])
    turn = F.atan2("gy", "gx") + math.pi / 2
    bin_ = F.least(F.lit(bins - 1), F.floor(F.round(F.pmod(turn, F.lit(math.pi)) / math.pi * bins, 9)))
    g = g.withColumn("bin", F.when(F.hypot("gx", "gy") > least, bin_))
    sums = g.groupBy(*by).agg(
        F.count("*").alias("n"),
        (F.max("z") - F.min("z") + 1).alias("depth"),
        *[F.sum(F.col(f"g{a}") * F.col(f"g{b}")).alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")],
        *[F.count_if(F.col("bin") == i).alias(f"h{i}") for i in range(bins)],
    )
    e = sums.withColumn("e", eigen3("xx", "yy", "zz", "xy", "xz", "yz"))
    total = F.col("xx") + F.col("yy") + F.col("zz")
    known = (F.col("n") >= 8) & (F.col("depth") >= slices) & (total > least)
    vx, vy = F.col("e.v1")[0], F.col("e.v1")[1]
    angle = F.degrees(F.pmod(F.round(F.atan2(vy, vx), 12) + math.pi / 2, F.lit(math.pi)))
    counts = F.array(*[F.col(f"h{i}").cast("double") for i in range(bins)])
    of_all = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c)
    entropy = F.aggregate(counts, F.lit(0.0), lambda s, c: s - F.when(c > 0, c / of_all * F.ln(c / of_all)).otherwise(0.0)) / math.log(bins)
    return e.select(
        *by,
        F.when(known, F.greatest(F.lit(0.0), (F.col("e.values")[0] - F.col("e.values")[1]) / total)).alias("coherency"),
        F.when(known & (F.hypot(vx, vy) > 1e-9), angle).alias("angle"),
        F.when(known & (of_all > 0), entropy).alias("entropy"),
    )
