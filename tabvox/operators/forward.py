"""Full forward model of a target channel: what autofluorescence and bleeding sources add to it is fitted and taken off."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvox.functions.lineage import cut, few
from tabvox.operators.aggregate import nearest_rank
from tabvox.operators.tiles import box_sums, tiled

MOST = 65535.0  # fixed value: the largest of 16 bits


def solve(gram: np.ndarray, rhs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of gram (..., n, n) k = rhs (..., n), negative ones as 0, and which are regular; others are fitted one by one."""
    n = rhs.shape[-1]
    diagonal = np.einsum("...ii->...i", gram)
    alone = np.where(diagonal > 1e-12, rhs / np.where(diagonal > 1e-12, diagonal, 1.0), 0.0)
    scale = np.sqrt(np.where(diagonal > 1e-12, diagonal, 1.0))
    even = gram / scale[..., :, None] / scale[..., None, :]  # ones on the diagonal, so that its determinant says how regular it is
    good = (np.linalg.det(even) > 1e-10) & (diagonal > 1e-12).all(-1)
    even = np.where(good[..., None, None], even, np.eye(n))
    together = np.linalg.solve(even, (rhs / scale)[..., None])[..., 0] / scale
    return np.maximum(0.0, np.where(good[..., None], together, alone)), good


def _fit(pool: DataFrame, by: list[str], y: Column, xs: list[Column], name: str) -> DataFrame:
    """(by, name, name_n): coefficients of y = sum of k x by least squares, from sums; name_n is the number of rows."""
    n = len(xs)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def coefficients(sums: pd.Series) -> pd.Series:
        flat = np.stack(sums.to_numpy()) if len(sums) else np.zeros((0, n * n + n))
        return pd.Series(list(solve(flat[:, : n * n].reshape(-1, n, n), flat[:, n * n :])[0]))

    sums = F.array(*[F.sum(a * b) for a in xs for b in xs], *[F.sum(a * y) for a in xs])
    return pool.groupBy(*by).agg(sums.alias("s"), F.count("*").alias(f"{name}_n")).select(*by, coefficients("s").alias(name), f"{name}_n")


def _percentiles(df: DataFrame, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """(by, t_<column>): the nearest-rank percentile of each column of the group's pixels."""
    out = None
    for c, p in wanted.items():
        one = nearest_rank(df.select(*by, F.col(c).alias("value")), by, "value", p).withColumnRenamed("value", f"t_{c}")
        out = one if out is None else out.join(one, by)
    return out


def _clamped(c: Column) -> Column:
    return F.floor(F.least(F.lit(MOST), F.greatest(F.lit(0.0), c)) + 0.5)


def _less(value: Column, k: str, channels: list[str]) -> Column:
    """value less the channels times their coefficients, an array column k; missing ones count as 0."""
    for i, c in enumerate(channels):
        value = value - F.coalesce(F.get(F.col(k), F.lit(i)), F.lit(0.0)) * F.col(c)
    return value


def forward_model(
    voxels: DataFrame, by: list[str], target: str, autos: list[str], sources: list[str], reach: int = 32, quiet: float = 0.5, source_quiet: float = 0.5, bright: float = 0.9,
    least_local: int = 50, least_bleed: int = 50, saturated: float = MOST, rounds: int = 1, tolerance: float = 1e-3,
) -> DataFrame:
    """voxels (by, y, x, channels) with local_1.., bleed_1.. and corrected, the target without what others add; whole numbers of 16 bits.

    Per group (an image plane): (1) of the target's quiet pixels (at most its `quiet` percentile, nothing
    saturated) least squares give its shares of the autos channels, in a square window of `reach` around
    each pixel, or over the whole group where the window holds fewer than least_local quiet pixels or
    doesn't determine them; (2) likewise the autos are taken off each source over the group; (3) where the
    target without autos is quiet and a purified source bright (at least its `bright` percentile), least
    squares give the sources' shares, 0 if fewer than least_bleed pixels do; (4) both are taken off.
    Negative shares are 0. More rounds repeat (1) on the target without its sources' shares and (3), until
    no share of a source moves by tolerance or more; one round is the usual model. Shares stay in Spark,
    only the largest move comes to the driver. Channels come out
    as doubles, null ones as 0; an empty table gives no rows.
    """
    if not autos or not sources:
        raise ValueError("autos and sources are needed")
    channels = [target, *autos, *sources]
    v = voxels.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in channels})
    v = v.withColumn("free", F.greatest(*[F.col(c) for c in channels]) < saturated)
    limits = few(_percentiles(v, by, {target: quiet, **{s: source_quiet for s in sources}}))
    v = v.join(limits, by)
    lit = F.greatest(*[F.col(a) for a in autos]) > 0 if len(autos) > 1 else F.col(autos[0]) > 0
    for s in sources:
        fit = _fit(v.where(F.col("free") & (F.col(s) <= F.col(f"t_{s}")) & lit), by, F.col(s), [F.col(a) for a in autos], f"k_{s}")
        v = v.join(few(fit), by, "left").withColumn(f"p_{s}", _clamped(_less(F.col(s), f"k_{s}", autos)))
    pure = [f"p_{s}" for s in sources]
    brights = few(_percentiles(v, by, {p: bright for p in pure}).withColumnsRenamed({f"t_{p}": f"b_{p}" for p in pure}))
    v = cut(v.join(brights, by).select(*voxels.columns, "free", f"t_{target}", *pure, *[f"b_{p}" for p in pure]))
    is_quiet = F.col("free") & (F.col(target) <= F.col(f"t_{target}"))
    bleed, names = None, [f"local_{i + 1}" for i in range(len(autos))]
    for turn in range(rounds):
        now = v.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in channels})
        now = now.withColumn("rest", F.col(target)) if bleed is None else now.join(few(bleed), by, "left").withColumn("rest", F.greatest(F.lit(0.0), _less(F.col(target), "bleed", pure))).drop("bleed", "bleed_n")
        whole = few(_fit(now.where(is_quiet & lit), by, F.col("rest"), [F.col(a) for a in autos], "whole"))
        local = _local(now.withColumn("quiet", is_quiet.cast("double")), by, autos, reach, least_local, names)
        now = now.join(local.hint("merge"), [*by, "y", "x"]).join(whole, by, "left")
        now = now.withColumns({n: F.coalesce(F.nanvl(n, F.lit(None)), F.get("whole", F.lit(i)), F.lit(0.0)) for i, n in enumerate(names)}).drop("whole", "whole_n", "rest")
        value = F.col(target)
        for n, a in zip(names, autos, strict=True):
            value = value - F.col(n) * F.col(a)
        now = cut(now.withColumn("first", _clamped(value)))
        limit = few(_percentiles(now, by, {"first": quiet}))
        lights = F.array_contains(F.array(*[F.col(p) >= F.col(f"b_{p}") for p in pure]), True) & (F.greatest(F.lit(0.0), *[F.col(p) for p in pure]) > 0)
        pool = now.join(limit, by).where(F.col("free") & (F.col("first") <= F.col("t_first")) & lights)
        new = cut(_fit(pool, by, F.col("first"), [F.col(p) for p in pure], "bleed").where(F.col("bleed_n") >= max(3, least_bleed)))
        moved = None
        if bleed is not None and turn + 1 < rounds:
            both = new.join(bleed.select(*by, F.col("bleed").alias("old")), by, "full")
            zero = F.array(*[F.lit(0.0) for _ in sources])
            moved = both.agg(F.max(F.array_max(F.zip_with(F.coalesce("bleed", zero), F.coalesce("old", zero), lambda a, b: F.abs(a - b))))).first()[0]
        bleed = new
        if moved is not None and moved < tolerance:
            break
    out = now.join(few(bleed), by, "left").withColumn("corrected", _clamped(_less(F.col("first"), "bleed", pure)))
    shares = [F.coalesce(F.get("bleed", F.lit(i)), F.lit(0.0)).alias(f"bleed_{i + 1}") for i in range(len(sources))]
    return out.select(*voxels.columns, *names, *shares, F.col("corrected").cast("double").alias("corrected"))


def _local(now: DataFrame, by: list[str], autos: list[str], reach: int, least: int, names: list[str]) -> DataFrame:
    """(by, y, x, names): shares fitted in the window around each pixel; NaN where it doesn't determine them."""
    n = len(autos)

    def run(a):
        quiet = np.nan_to_num(a["quiet"])
        xs, y = [np.nan_to_num(a[c]) for c in autos], np.nan_to_num(a["rest"])
        count = box_sums(quiet, reach)
        gram = np.stack([np.stack([box_sums(quiet * p * q, reach) for q in xs], -1) for p in xs], -2)
        shares, good = solve(gram, np.stack([box_sums(quiet * p * y, reach) for p in xs], -1))
        some = (np.einsum("...ii->...i", gram) > 1e-12).any(-1)
        known = (count >= max(3, least) - 0.5) & (good if n == 1 else some)
        return {name: np.where(known, shares[..., i], np.nan) for i, name in enumerate(names)}

    return tiled(now, by, ["quiet", "rest", *autos], reach, run, names)
