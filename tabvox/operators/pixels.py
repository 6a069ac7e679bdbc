"""Measures on pixel and voxel tables (by..., z, y, x, value) and labelled ones (by..., z, y, x, label)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tabvox.functions.lineage import cut, few
from tabvox.functions.scalar import correlation, norm_cdf
from tabvox.operators.distance import distances, shell_measures
from tabvox.operators.outline import outlines
from tabvox.operators.spatial import neighbours
from tabvox.operators.tiles import box_sums, tiled


def objects_from_labels(labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, voxels, x, y, z, x0..z1) of positive labels."""
    return labels.where("label > 0").groupBy(*by, "label").agg(F.count("*").alias("voxels"), *[F.avg(a).alias(a) for a in "xyz"], *[f(a).alias(f"{a}{i}") for a in "xyz" for i, f in enumerate((F.min, F.max))])


def object_intensity(labels: DataFrame, voxels: DataFrame, by: list[str], voxel_volume: float = 1.0) -> DataFrame:
    """(by, label, volume, intden, mean, cx, cy, cz): the centre is weighted by intensity, or plain if that sums to 0."""
    j = labels.where("label > 0").join(voxels, [*by, "z", "y", "x"], "left")
    v = F.coalesce("value", F.lit(0.0))
    s = F.sum(v)
    return j.groupBy(*by, "label").agg((F.count("*") * voxel_volume).alias("volume"), s.alias("intden"), F.avg(v).alias("mean"), *[F.when(s != 0, F.sum(v * F.col(a)) / s).otherwise(F.avg(a)).alias(f"c{a}") for a in "xyz"])


def surface(labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, faces): voxel faces that don't touch the same label."""
    six = [(0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0)]
    own = labels.where("label > 0")
    inner = neighbours(own, by, six, ["z", "y", "x"], "label").where("label = other").groupBy(*by, "label").agg(F.count("*").alias("inner"))
    return own.groupBy(*by, "label").agg(F.count("*").alias("n")).join(inner, [*by, "label"], "left").select(*by, "label", (6 * F.col("n") - F.coalesce("inner", F.lit(0))).alias("faces"))


def max_projection(voxels: DataFrame, by: list[str]) -> DataFrame:
    return voxels.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*by, "y", "x").agg(F.max("value").alias("value"))


def intensity(voxels: DataFrame, by: list[str], threshold: float, area: float = 1.0) -> DataFrame:
    """Integrated density over the threshold and in all, share of area over it, and the same after binarising, in one pass."""
    over = F.col("value") >= threshold
    n = F.count("*")
    return voxels.groupBy(*by).agg((F.sum(F.when(over, F.col("value")).otherwise(0.0)) * area).alias("intden"), (100.0 * F.sum(over.cast("int")) / n).alias("pct_area"), (F.sum("value") * area).alias("intden_unfiltered"), (100.0 * F.sum((F.col("value") > 0).cast("int")) / n).alias("pct_positive"), (F.sum(over.cast("double")) * 255 * area).alias("intden_binarized"))


def patchiness(voxels: DataFrame, by: list[str], sizes: list[int]) -> DataFrame:
    """(by, size, cv, lacunarity): variation of tile means and what their second moment exceeds 1 by."""
    tiles = voxels.select(*by, "x", "y", "value", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")).groupBy(*by, "size", F.floor(F.col("y") / F.col("size")).alias("ty"), F.floor(F.col("x") / F.col("size")).alias("tx")).agg(F.avg("value").alias("m"))
    mean = F.avg("m")
    return tiles.groupBy(*by, "size").agg(F.when(mean != 0, F.stddev_pop("m") / mean).alias("cv"), F.when(mean != 0, F.avg(F.col("m") * F.col("m")) / (mean * mean) - 1).alias("lacunarity"))


def moran(tiles: DataFrame, by: list[str]) -> DataFrame:
    """(by, y, x, z, lag, local) of a grid of values: z-score, mean z of the eight neighbours and their product (null without a neighbour)."""
    w = W.partitionBy(*by)
    s = F.stddev_pop("value").over(w)
    z = tiles.withColumn("z", F.when(s > 0, (F.col("value") - F.avg("value").over(w)) / s).otherwise(0.0)).select(*by, "y", "x", "z")
    eight = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    lag = neighbours(z, by, eight, ["y", "x"], "z").groupBy(*by, "y", "x").agg(F.avg("other").alias("lag"))
    return z.join(lag, [*by, "y", "x"], "left").withColumn("local", F.col("z") * F.col("lag"))


def hotspots(tiles: DataFrame, by: list[str], permutations: int = 199, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """(by, moran, fraction): global statistic and the share of cells whose local score few shuffles of the others reach."""
    m = moran(tiles, by)
    w = W.partitionBy(*by, "sim")
    sims = tiles.select(*by, "y", "x", "value", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("sim"))
    slots = sims.select(*by, "sim", "y", "x", F.row_number().over(w.orderBy("y", "x")).alias("k"))
    moved = sims.select(*by, "sim", "value", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "sim", "y", "x"), "y", "x")).alias("k"))
    null = moran(slots.join(moved.hint("merge"), [*by, "sim", "k"]), [*by, "sim"]).select(*by, "y", "x", F.col("local").alias("null"))
    p = m.where("local IS NOT NULL").join(null.hint("merge"), [*by, "y", "x"]).groupBy(*by, "y", "x", "z", "local").agg(((F.sum((F.col("null") >= F.col("local")).cast("int")) + 1) / (permutations + 1)).alias("p"))
    return p.groupBy(*by).agg(F.avg("local").alias("moran"), F.avg(((F.col("p") < alpha) & (F.col("z") > 0)).cast("double")).alias("fraction"))


def null_model(tiles: DataFrame, by: list[str], value: str = "value", alpha: float = 0.05) -> DataFrame:
    """(by, n, z, p, passed): normal form of the dispersion of counts against Poisson, its two-sided p, and whether p is alpha or more.

    With fewer than two counts or a mean of 0 or less z, p and passed are null.
    """
    n = F.count(value)
    chi = F.var_samp(value) / F.avg(value) * (n - 1)
    out = tiles.groupBy(*by).agg(n.alias("n"), F.when((F.avg(value) > 0) & (n > 1), (chi - (n - 1)) / F.sqrt(2.0 * (n - 1))).alias("z"))
    out = out.withColumn("p", F.when(F.col("z").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * (1 - norm_cdf(F.abs("z")))))))
    return out.withColumn("passed", F.col("p") >= alpha)


def granularity(voxels: DataFrame, by: list[str], lags: list[int]) -> DataFrame:
    """(by, lag, r): correlation of each pixel with the one lag to the right."""
    n = neighbours(voxels, by, [(0, k) for k in lags], ["y", "x"])
    lag = F.element_at(F.array(*[F.lit(k) for k in lags]), F.col("offset") + 1)
    return n.groupBy(*by, lag.alias("lag")).agg(correlation("value", "other").alias("r"))


def shells(voxels: DataFrame, mask: DataFrame, by: list[str], width: float, axes: tuple[str, ...] = ("y", "x"), scale: dict[str, float] | None = None, count: int | None = None) -> dict[str, DataFrame]:
    """shells: (by, shell, n, mean) and summary: (by, slope, auc) of values by distance from the nearest place of mask, in two or three dimensions."""
    at = distances(voxels.select(*by, *axes, "value"), mask, by, list(axes), scale)
    return shell_measures(at, by, width, count)


def glcm(voxels: DataFrame, by: list[str], levels: int, low: float, high: float) -> DataFrame:
    """(by, contrast, entropy, homogeneity, asm, correlation) of the symmetric co-occurrences at four offsets."""
    q = voxels.withColumn("value", F.least(F.lit(levels - 1), F.greatest(F.lit(0), F.floor((F.col("value") - low) / (high - low) * levels))).cast("int"))
    n = neighbours(q, by, [(0, 1), (1, 0), (1, 1), (1, -1)], ["y", "x"]).select(*by, F.explode(F.array(F.struct(F.col("value").alias("a"), F.col("other").alias("b")), F.struct(F.col("other").alias("a"), F.col("value").alias("b")))).alias("p"))
    p = n.groupBy(*by, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*by)))
    d, m = F.abs(F.col("a") - F.col("b")), F.sum(F.col("p") * F.col("a"))
    v = F.sum(F.col("p") * F.col("a") * F.col("a")) - m * m
    return p.groupBy(*by).agg(F.sum(F.col("p") * d * d).alias("contrast"), (-F.sum(F.col("p") * F.log("p")) / math.log(levels * levels)).alias("entropy"), F.sum(F.col("p") / (1 + d)).alias("homogeneity"), F.sum(F.col("p") * F.col("p")).alias("asm"), F.when(v > 0, (F.sum(F.col("p") * F.col("a") * F.col("b")) - m * m) / v).alias("correlation"))


def object_glcm(voxels: DataFrame, by: list[str], levels: int, low: float, high: float, least: int = 16) -> DataFrame:
    """(by, label, ...) as glcm within each label, entropy in bits and homogeneity by the squared difference; labels with few pairs are left out."""
    q = voxels.withColumn("value", F.least(F.lit(levels - 1), F.greatest(F.lit(0), F.floor((F.col("value") - low) / (high - low) * levels))).cast("int"))
    n = neighbours(q, [*by, "label"], [(0, 1), (1, 0), (1, 1), (1, -1)], ["y", "x"])
    n = n.select(*by, "label", F.explode(F.array(F.struct(F.col("value").alias("a"), F.col("other").alias("b")), F.struct(F.col("other").alias("a"), F.col("value").alias("b")))).alias("p"))
    w = W.partitionBy(*by, "label")
    p = n.groupBy(*by, "label", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n")).withColumns({"p": F.col("n") / F.sum("n").over(w), "pairs": F.sum("n").over(w) / 2}).where(F.col("pairs") >= least)
    d = F.abs(F.col("a") - F.col("b"))
    return p.groupBy(*by, "label").agg(F.sum(F.col("p") * d * d).alias("contrast"), F.abs(F.sum(-F.col("p") * F.log2("p"))).alias("entropy"), F.sum(F.col("p") / (1 + d * d)).alias("homogeneity"), F.sum(F.col("p") * F.col("p")).alias("asm"))


def scale_divergence(voxels: DataFrame, by: list[str], sizes: list[int]) -> DataFrame:
    """(by, q, slope) of the weighted log probability of boxes against the log of their size, for q = -2, 0, 2."""
    v = voxels.where("value > 0").select(*by, "x", "y", "value", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"))
    box = v.groupBy(*by, "size", F.floor(F.col("y") / F.col("size")).alias("ty"), F.floor(F.col("x") / F.col("size")).alias("tx")).agg(F.sum("value").alias("s")).withColumn("p", F.col("s") / F.sum("s").over(W.partitionBy(*by, "size")))
    qs = box.select(*by, "size", "p", F.explode(F.array(*[F.lit(float(q)) for q in (-2, 0, 2)])).alias("q")).withColumn("w", F.pow("p", F.col("q")))
    one = qs.groupBy(*by, "q", "size").agg((F.sum(F.col("w") * F.log("p")) / F.sum("w")).alias("y"))
    return one.groupBy(*by, "q").agg(F.regr_slope(F.col("y"), F.log("size")).alias("slope"))


def cross_correlation(a: DataFrame, b: DataFrame, by: list[str], reach: int) -> DataFrame:
    """(by, dy, dx, r): the shift of b within reach with the largest correlation; ties go to the smaller shift."""
    shifts = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
    from tabvox.operators.spatial import shifted

    j = a.select(*by, "y", "x", "value").join(shifted(b.select(*by, "y", "x", "value"), shifts, ["y", "x"], "value").hint("merge"), [*by, "y", "x"])
    r = j.groupBy(*by, "offset").agg(correlation("value", "other").alias("r")).where("r IS NOT NULL")
    name = F.element_at(F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y, x in shifts]), F.col("offset") + 1)
    return r.withColumn("s", name).groupBy(*by).agg(F.max_by(F.struct("s.dy", "s.dx", "r"), F.struct(F.round("r", 9), -(F.abs("s.dy") + F.abs("s.dx")), -F.col("s.dy"), -F.col("s.dx"))).alias("m")).select(*by, "m.*")


def manders(ab: DataFrame, by: list[str], ta: float, tb: float) -> DataFrame:
    """(by, pearson, m1, m2) of columns a and b: shares of a where b is over its threshold, and the reverse."""
    return ab.groupBy(*by).agg(correlation("a", "b").alias("pearson"), (F.sum(F.when(F.col("b") > tb, F.col("a")).otherwise(0.0)) / F.nullif(F.sum("a"), F.lit(0.0))).alias("m1"), (F.sum(F.when(F.col("a") > ta, F.col("b")).otherwise(0.0)) / F.nullif(F.sum("b"), F.lit(0.0))).alias("m2"))


@F.pandas_udf(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
def _bisected(bins: pd.Series, cells: pd.Series, least: pd.Series) -> pd.DataFrame:
    """Bisection over whole cells: the correlation of all pixels in bins below the middle decides each step."""
    out = []
    for rows, n, r0 in zip(bins, cells, least, strict=True):
        table = np.array([[r[c] for c in ("bin", "n", "a", "b", "aa", "bb", "ab")] for r in rows], float)
        table = table[np.argsort(table[:, 0])]
        sums = np.vstack([np.zeros(6), np.cumsum(table[:, 1:], 0)])
        lo, hi = 0, int(n)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            k, a, b, aa, bb, ab = sums[np.searchsorted(table[:, 0], mid, "left")]
            va, vb = (aa - a * a / k, bb - b * b / k) if k else (0.0, 0.0)
            over = va > 1e-12 * aa and vb > 1e-12 * bb and (ab - a * b / k) / np.sqrt(va * vb) > r0
            lo, hi = (lo, mid) if over else (mid, hi)
        out.append((lo, hi))
    return pd.DataFrame(out, columns=["lo", "hi"])


def costes(ab: DataFrame, by: list[str], steps: int = 32, least: float = 0.01, at_once: int = 10) -> DataFrame:
    """(by, ta, tb): thresholds along the regression line below which the correlation vanishes, by bisection of all groups at once.

    A pixel lies below the line's point t from some t on, so sums over 2**at_once equal steps of t say how
    every one of the next at_once bisections goes; a pass over the pixels serves as many. Groups whose
    line doesn't rise are left out. ta is the upper end of the last interval.
    """
    line = ab.groupBy(*by).agg(F.regr_slope(F.col("b"), F.col("a")).alias("slope"), F.regr_intercept(F.col("b"), F.col("a")).alias("cut"), F.min("a").alias("lo"), F.max("a").alias("hi"), F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    state = line.where("slope > 0")
    a, b = F.col("a") - F.col("ma"), F.col("b") - F.col("mb")  # about their means, so that sums keep their digits
    while steps > 0:
        cells = 1 << min(steps, at_once)
        here = F.least(F.col("a"), (F.col("b") - F.col("cut")) / F.col("slope"))
        place = F.when(F.col("hi") > F.col("lo"), F.floor((here - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells)).otherwise(F.lit(0))
        j = ab.where("a IS NOT NULL AND b IS NOT NULL").join(few(state), by).withColumn("bin", F.greatest(F.lit(-1), F.least(F.lit(cells), place)))
        sums = j.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab"))
        found = sums.groupBy(*by).agg(F.collect_list(F.struct("bin", "n", "a", "b", "aa", "bb", "ab")).alias("bins")).select(*by, _bisected("bins", F.lit(cells), F.lit(float(least))).alias("m"))
        width = (F.col("hi") - F.col("lo")) / cells
        state = state.join(few(found), by).withColumns({"hi": F.col("lo") + width * F.col("m.hi"), "lo": F.col("lo") + width * F.col("m.lo")}).drop("m")
        steps -= at_once
    return state.select(*by, F.col("hi").alias("ta"), (F.col("slope") * F.col("hi") + F.col("cut")).alias("tb"))


def mutual_information(ab: DataFrame, by: list[str], bins: int, low: float, high: float) -> DataFrame:
    """(by, nmi): 2 MI / (Ha + Hb) of the joint histogram."""
    q = lambda c: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(c) - low) / (high - low) * bins)))
    p = ab.groupBy(*by, q("a").alias("i"), q("b").alias("j")).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*by)))
    h = lambda df: df.groupBy(*by).agg(F.sum(-F.col("p") * F.log("p")).alias("h"))
    one = lambda c: h(p.groupBy(*by, c).agg(F.sum("p").alias("p")))
    out = h(p).withColumnRenamed("h", "hab").join(one("i").withColumnRenamed("h", "ha"), by).join(one("j").withColumnRenamed("h", "hb"), by)
    return out.select(*by, F.when(F.col("ha") + F.col("hb") > 0, 2 * (F.col("ha") + F.col("hb") - F.col("hab")) / (F.col("ha") + F.col("hb"))).alias("nmi"))


def convolve(voxels: DataFrame, by: list[str], kernel: list[tuple[int, int, float]]) -> DataFrame:
    """(by, y, x, value): sum of kernel (dy, dx, weight) over the pixels that are there, at places that hold a pixel."""
    k = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(float(w)).alias("w")) for a, b, w in kernel])).alias("k")
    spread = voxels.select(*by, "y", "x", "value", k).groupBy(*by, (F.col("y") + F.col("k.dy")).alias("y"), (F.col("x") + F.col("k.dx")).alias("x")).agg(F.sum(F.col("value") * F.col("k.w")).alias("value"))
    return spread.join(voxels.select(*by, "y", "x").hint("merge"), [*by, "y", "x"], "left_semi")


def anisotropy(voxels: DataFrame, by: list[str]) -> DataFrame:
    """(by, coherency, angle) of the structure tensor of central differences."""
    n = neighbours(voxels, by, [(0, 1), (0, -1), (1, 0), (-1, 0)], ["y", "x"]).groupBy(*by, "y", "x").pivot("offset", [0, 1, 2, 3]).agg(F.first("other")).dropna()
    gx, gy = (F.col("0") - F.col("1")) / 2, (F.col("2") - F.col("3")) / 2
    t = n.groupBy(*by).agg(F.sum(gx * gx).alias("xx"), F.sum(gy * gy).alias("yy"), F.sum(gx * gy).alias("xy"))
    root = F.sqrt(F.pow(F.col("xx") - F.col("yy"), 2) + 4 * F.col("xy") * F.col("xy"))
    return t.select(*by, F.when(F.col("xx") + F.col("yy") > 0, root / (F.col("xx") + F.col("yy"))).alias("coherency"), (F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2).alias("angle"))


def periodicity(voxels: DataFrame, by: list[str], size: int, most: int) -> DataFrame:
    """(by, ky, kx, power): the strongest frequency up to `most` cycles, by a separable transform in two joins and sums."""
    two_pi = 2 * math.pi
    mean = voxels.withColumn("v", F.col("value") - F.avg("value").over(W.partitionBy(*by)))
    hann = lambda c: 0.5 - 0.5 * F.cos(two_pi * F.col(c) / (size - 1))
    v = mean.select(*by, "y", "x", (F.col("v") * hann("x") * hann("y")).alias("v"))
    row = v.select("*", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("kx")).groupBy(*by, "y", "kx").agg(F.sum(F.col("v") * F.cos(two_pi * F.col("kx") * F.col("x") / size)).alias("re"), F.sum(-F.col("v") * F.sin(two_pi * F.col("kx") * F.col("x") / size)).alias("im"))
    ang = two_pi * F.col("ky") * F.col("y") / size
    col = row.select("*", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("ky")).groupBy(*by, "ky", "kx").agg(F.sum(F.col("re") * F.cos(ang) + F.col("im") * F.sin(ang)).alias("re"), F.sum(F.col("im") * F.cos(ang) - F.col("re") * F.sin(ang)).alias("im"))
    power = col.where("kx > 0 OR ky > 0").withColumn("power", F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return power.groupBy(*by).agg(F.max_by(F.struct("ky", "kx", "power"), F.struct(F.round("power", 3), -F.col("kx"), -F.col("ky"))).alias("m")).select(*by, "m.*")


def unmix(voxels: DataFrame, by: list[str], quiet: float, saturated: float) -> DataFrame:
    """voxels (target, c1, c2) with corrected: what the contaminants explain on quiet, unsaturated pixels is taken off; 0..65535, rounded."""
    from tabvox.operators.aggregate import least_squares

    fit = least_squares(voxels.where((F.col("target") <= quiet) & (F.greatest("target", "c1", "c2") < saturated)), by, "target", "c1", "c2")
    j = voxels.join(fit, by, "left")
    weight = lambda c: F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)))
    return j.withColumn("corrected", F.round(F.least(F.lit(65535.0), F.greatest(F.lit(0.0), F.col("target") - weight("a") * F.col("c1") - weight("b") * F.col("c2"))))).drop("a", "b")


def local_sums(voxels: DataFrame, by: list[str], value: str, reach: int) -> DataFrame:
    """Add total: the sum over a square window; the grid may have gaps."""
    total = tiled(voxels, by, [value], reach, lambda a: {"total": box_sums(np.nan_to_num(a[value]), reach)}, ["total"])
    return voxels.join(total.hint("merge"), [*by, "y", "x"])


def local_correlation(ab: DataFrame, by: list[str], reach: int) -> DataFrame:
    """Add r: correlation of a and b in a window around each pixel; null where either is constant there."""

    def run(arrays):
        there = ~np.isnan(arrays["a"])
        a, b = (np.where(there, arrays[c] - np.nanmean(arrays[c]), 0.0) for c in "ab")  # about 0, so that sums keep their digits
        n, sa, sb, saa, sbb, sab = (box_sums(x, reach) for x in (there.astype(float), a, b, a * a, b * b, a * b))
        n = np.maximum(n, 1)
        va, vb = saa - sa * sa / n, sbb - sb * sb / n
        known = (va > 1e-9) & (vb > 1e-9)
        return {"r": np.where(known, (sab - sa * sb / n) / np.sqrt(np.where(known, va * vb, 1.0)), np.nan)}

    r = tiled(ab.where("a IS NOT NULL AND b IS NOT NULL"), by, ["a", "b"], reach, run, ["r"])
    return ab.join(r.hint("merge"), [*by, "y", "x"], "left").select(*ab.columns, F.nanvl("r", F.lit(None)).alias("r"))


def veto(ab: DataFrame, by: list[str], target_from: float, contaminant_to: float) -> DataFrame:
    """Add keep: the target is bright enough and the contaminant dark enough."""
    return ab.withColumn("keep", (F.col("a") >= target_from) & (F.col("b") <= contaminant_to))


def components(mask: DataFrame, by: list[str]) -> DataFrame:
    """(by, y, x, label): the smallest pixel of each four-connected component, as y * 2**32 + x, by label propagation with doubling jumps.

    Each round is written to the checkpoint folder, so lineage stays short; rounds end when nothing moves.
    """
    now = mask.select(*by, "y", "x", (F.col("y").cast("long") * (1 << 32) + F.col("x")).alias("label"))
    four = [(0, 1), (0, -1), (1, 0), (-1, 0)]
    while True:
        least = neighbours(now, by, four, ["y", "x"], "label").groupBy(*by, "y", "x").agg(F.min("other").alias("near"))
        step = now.join(least.hint("merge"), [*by, "y", "x"], "left").withColumn("best", F.least("label", F.coalesce("near", "label")))
        # everything under an old label takes the best that any of its pixels saw, then that label's own label
        jump = step.groupBy(*by, "label").agg(F.min("best").alias("to"))
        to = jump.join(jump.select(*by, F.col("label").alias("to"), F.col("to").alias("to2")).hint("merge"), [*by, "to"], "left").select(*by, "label", F.coalesce("to2", "to").alias("to"))
        new = cut(now.join(to.hint("merge"), [*by, "label"]).select(*by, "y", "x", F.col("to").alias("label"), (F.col("to") != F.col("label")).alias("moved")))
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return now


def size_filter(labels: DataFrame, by: list[str], low: int, high: int) -> DataFrame:
    ok = labels.groupBy(*by, "label").agg(F.count("*").alias("n")).where(F.col("n").between(low, high))
    return labels.join(ok.select(*by, "label"), [*by, "label"], "left_semi")


def contamination(objects: DataFrame, ratio_cut: float = 0.5, overlap_cut: float = 0.3) -> DataFrame:
    """objects (target, contaminant, overlap) with ratio, score, keep and the reasons against."""
    ratio = F.when(F.col("target") > 0, F.col("contaminant") / F.col("target"))
    score = F.greatest(F.lit(0.0), 1 - 0.5 * F.least(F.lit(1.0), F.coalesce(ratio, F.lit(1.0))) - 0.5 * F.least(F.lit(1.0), F.col("overlap")))
    reasons = F.concat_ws(";", F.array_compact(F.array(F.when(F.coalesce(ratio, F.lit(1.0)) > ratio_cut, F.lit("ratio")), F.when(F.col("overlap") > overlap_cut, F.lit("overlap")))))
    return objects.withColumns({"ratio": ratio, "score": score, "reasons": reasons}).withColumn("keep", F.col("reasons") == "")


def roc_search(samples: DataFrame, low: float, high: float, step: float, limit: float) -> DataFrame:
    """(threshold, fpr, retention) of samples (control, metric), and best: the largest retention under the limit of false positives, then the smallest threshold."""
    t = F.explode(F.sequence(F.lit(0), F.lit(int(round((high - low) / step))))).alias("i")
    grid = samples.select("control", "metric", t).withColumn("threshold", F.lit(low) + F.col("i") * step)
    over = (F.col("metric") >= F.col("threshold")).cast("double")
    out = grid.groupBy("threshold").agg(F.avg(F.when(F.col("control"), over)).alias("fpr"), F.avg(F.when(~F.col("control"), over)).alias("retention"))
    best = out.where(F.col("fpr") <= limit).agg(F.max_by("threshold", F.struct("retention", -F.col("threshold")))).first()[0]
    return out.withColumn("best", F.coalesce(F.col("threshold") == F.lit(best), F.lit(False)))


def shape2d(labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, area, perimeter, circularity, aspect, extent): the perimeter counts pixels with a side outside."""
    own = labels.where("label > 0")
    inner = neighbours(own, by, [(0, 1), (0, -1), (1, 0), (-1, 0)], ["y", "x"], "label").where("label = other").groupBy(*by, "label", "y", "x").agg(F.count("*").alias("k"))
    px = own.join(inner, [*by, "label", "y", "x"], "left").withColumn("edge", F.coalesce("k", F.lit(0)) < 4)
    w, h = F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1
    a = px.groupBy(*by, "label").agg(F.count("*").alias("area"), F.sum(F.col("edge").cast("int")).alias("perimeter"), (F.greatest(w, h) / F.least(w, h)).alias("aspect"), (F.count("*") / (w * h)).alias("extent"))
    return a.withColumn("circularity", F.least(F.lit(1.0), 4 * math.pi * F.col("area") / F.pow("perimeter", 2)))


def shape3d(labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, n, r1, r2, r3): semi-axes of the ellipsoid with the same second moments, largest first, in closed form."""
    c = lambda a, b: (F.covar_pop(a, b)).alias(f"{a}{b}")
    m = labels.where("label > 0").groupBy(*by, "label").agg(F.count("*").alias("n"), *[c(a, b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")])
    q = (F.col("xx") + F.col("yy") + F.col("zz")) / 3
    off = F.col("xy") ** 2 + F.col("xz") ** 2 + F.col("yz") ** 2
    p = F.sqrt(((F.col("xx") - q) ** 2 + (F.col("yy") - q) ** 2 + (F.col("zz") - q) ** 2 + 2 * off) / 6)
    x, y, z = (F.col(k) - q for k in ("xx", "yy", "zz"))
    det = x * (y * z - F.col("yz") ** 2) - F.col("xy") * (F.col("xy") * z - F.col("yz") * F.col("xz")) + F.col("xz") * (F.col("xy") * F.col("yz") - y * F.col("xz"))
    r = F.when(p > 1e-12, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))).otherwise(0.0)
    phi = F.acos(r) / 3
    e1, e3 = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    axis = lambda e: F.sqrt(5 * F.greatest(F.lit(0.0), e))
    return m.select(*by, "label", "n", axis(e1).alias("r1"), axis(3 * q - e1 - e3).alias("r2"), axis(e3).alias("r3"))


def form3d(labels: DataFrame, by: list[str], scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(by, label, n, faces, sphericity, compactness, elongation, flatness, centre_least, centre_most, centre_mean, centre_sd) of positive labels.

    Sphericity and compactness compare the voxels with their open faces (both 1 for a ball); elongation and flatness
    are ratios of the radii of shape3d, the first to the second and the second to the third (null where the divisor is 0).
    The others describe distances of voxels from the centroid; scale: lengths of steps along z, y and x for these.
    """
    own = labels.where("label > 0").select(*by, "label", *"zyx")
    centre = own.groupBy(*by, "label").agg(*[F.avg(a).alias(f"c{a}") for a in "zyx"])
    squares = sum(((F.col(a) - F.col(f"c{a}")) * float(k)) ** 2 for a, k in zip("zyx", scale, strict=True))
    d = own.join(centre.hint("merge"), [*by, "label"]).withColumn("d", F.sqrt(squares))
    d = d.groupBy(*by, "label").agg(F.min("d").alias("centre_least"), F.max("d").alias("centre_most"), F.avg("d").alias("centre_mean"), F.stddev_pop("d").alias("centre_sd"))
    n, s = F.col("n"), F.col("faces")
    j = shape3d(labels, by).join(surface(labels, by).hint("merge"), [*by, "label"]).join(d.hint("merge"), [*by, "label"])
    ratio = lambda a, b: F.when(F.col(b) > 1e-9, F.col(a) / F.col(b))
    return j.select(
        *by, "label", "n", "faces", F.when(s > 0, F.pow(F.lit(math.pi), F.lit(1 / 3)) * F.pow(6 * n, F.lit(2 / 3)) / s).alias("sphericity"), F.when(s > 0, 36 * math.pi * n * n / (s * s * s)).alias("compactness"),
        ratio("r1", "r2").alias("elongation"), ratio("r2", "r3").alias("flatness"), "centre_least", "centre_most", "centre_mean", "centre_sd",
    )


def box_count(labels: DataFrame, by: list[str], radii: list[int]) -> DataFrame:
    """(by, label, dimension, r2): minus the slope of log boxes against log size."""
    b = labels.where("label > 0").select(*by, "label", "y", "x", F.explode(F.array(*[F.lit(r) for r in radii])).alias("r")).groupBy(*by, "label", "r").agg(F.countDistinct(F.floor(F.col("y") / F.col("r")), F.floor(F.col("x") / F.col("r"))).alias("n"))
    return b.groupBy(*by, "label").agg((-F.regr_slope(F.log("n"), F.log("r"))).alias("dimension"), F.regr_r2(F.log("n"), F.log("r")).alias("r2"))


def sholl(skeleton: DataFrame, by: list[str], centre: tuple[float, float], step: float, rings: int) -> DataFrame:
    """(by, r, crossings): edges between neighbouring skeleton pixels that cross each radius around the centre."""
    d = lambda y, x: F.sqrt(F.pow(y - centre[0], 2) + F.pow(x - centre[1], 2))
    half = [(0, 1), (1, 0), (1, 1), (1, -1)]
    e = neighbours(skeleton.withColumn("value", F.lit(1)), by, half, ["y", "x"])
    off = F.element_at(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in half]), F.col("offset") + 1)
    e = e.withColumns({"d0": d(F.col("y"), F.col("x")), "d1": d(F.col("y") + off["dy"], F.col("x") + off["dx"])})
    r = e.select(*by, "d0", "d1", F.explode(F.sequence(F.lit(1), F.lit(rings))).alias("k")).withColumn("r", F.col("k") * step)
    return r.where((F.least("d0", "d1") < F.col("r")) & (F.greatest("d0", "d1") >= F.col("r"))).groupBy(*by, "r").agg(F.count("*").alias("crossings"))


def sholl_summary(crossings: DataFrame, by: list[str]) -> DataFrame:
    """(by, critical, critical_radius, primary, schoenen) from sholl's rows: the most crossings and their first radius, those of the first radius that has any, and their ratio."""
    best = F.max_by(F.struct(F.col("crossings").alias("critical"), F.col("r").alias("critical_radius")), F.struct("crossings", -F.col("r")))
    out = crossings.where("crossings > 0").groupBy(*by).agg(best.alias("m"), F.min_by("crossings", "r").alias("primary"))
    return out.select(*by, "m.critical", "m.critical_radius", "primary", (F.col("m.critical") / F.col("primary")).alias("schoenen"))


def skeleton_nodes(skeleton: DataFrame, by: list[str]) -> DataFrame:
    """(by, endpoints, junctions, length): pixels of one neighbour, of three or more, and all."""
    eight = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    s = skeleton.withColumn("value", F.lit(1))
    n = s.join(neighbours(s, by, eight, ["y", "x"]).groupBy(*by, "y", "x").agg(F.count("*").alias("k")), [*by, "y", "x"], "left")
    return n.groupBy(*by).agg(F.count(F.when(F.col("k") == 1, 1)).alias("endpoints"), F.count(F.when(F.col("k") >= 3, 1)).alias("junctions"), F.count("*").alias("length"))


def radial_profile(labels: DataFrame, voxels: DataFrame, by: list[str], bins: int) -> DataFrame:
    """(by, label, bin, mean): mean value by distance from the object's centre, as shares of its largest distance."""
    c = labels.where("label > 0").groupBy(*by, "label").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    d = labels.where("label > 0").join(c, [*by, "label"]).withColumn("d", F.sqrt(F.pow(F.col("y") - F.col("cy"), 2) + F.pow(F.col("x") - F.col("cx"), 2)))
    d = d.withColumn("top", F.max("d").over(W.partitionBy(*by, "label"))).join(voxels, [*by, "y", "x"])
    bin_ = F.when(F.col("top") > 0, F.least(F.lit(bins - 1), F.floor(F.round(F.col("d") / F.col("top") * bins, 9)))).otherwise(0).cast("int")
    return d.groupBy(*by, "label", bin_.alias("bin")).agg(F.avg("value").alias("mean"))


def image_quality(voxels: DataFrame, by: list[str], top: float) -> DataFrame:
    """(by, saturated, range_use, cv): share of pixels at the top, span over the top, and variation."""
    v = F.col("value")
    return voxels.groupBy(*by).agg(F.avg((v >= top).cast("double")).alias("saturated"), ((F.max(v) - F.min(v)) / top).alias("range_use"), F.when(F.avg(v) != 0, F.stddev_pop(v) / F.avg(v)).alias("cv"))


def signal_slices(voxels: DataFrame, by: list[str], channel: str, tolerance: float = 0.05) -> DataFrame:
    """(by, first, last): slices whose brightest channel mean is over the least by more than a share of the spread."""
    z = voxels.groupBy(*by, "z", channel).agg(F.avg("value").alias("m")).groupBy(*by, "z").agg(F.max("m").alias("m"))
    w = W.partitionBy(*by)
    signal = z.withColumns({"lo": F.min("m").over(w), "hi": F.max("m").over(w)}).where(F.col("m") > F.col("lo") + tolerance * (F.col("hi") - F.col("lo")))
    return signal.groupBy(*by).agg(F.min("z").alias("first"), F.max("z").alias("last"))


def orient(voxels: DataFrame, width: int, height: int, turns: int = 0, flip: bool = False) -> DataFrame:
    """Pixels turned by quarter turns clockwise, then flipped left to right."""
    for _ in range(turns % 4):
        voxels = voxels.withColumns({"x": F.lit(height - 1) - F.col("y"), "y": F.col("x")})
        width, height = height, width
    return voxels.withColumn("x", F.lit(width - 1) - F.col("x")) if flip else voxels


def object_features(labels: DataFrame, voxels: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, volume, faces, feret, elongation, sphericity, compactness, mean, sd, least, most, z): what classifiers of objects read.

    Volumes count voxels and faces their open sides; an absent value counts as 0. Sphericity and compactness are 0 without faces.
    feret: the largest distance in the object's outline; elongation: the first radius of shape3d over the second, null if that is 0.
    """
    v = F.coalesce("value", F.lit(0.0))
    own = labels.where("label > 0")
    stats = own.join(voxels, [*by, "z", "y", "x"], "left").groupBy(*by, "label").agg(F.count("*").alias("volume"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg("z").alias("z"))
    j = stats.join(surface(labels, by).hint("merge"), [*by, "label"]).join(outlines(labels, by, least=1).select(*by, "label", "feret").hint("merge"), [*by, "label"])
    j = j.join(shape3d(labels, by).select(*by, "label", "r1", "r2").hint("merge"), [*by, "label"])
    n, s = F.col("volume"), F.col("faces")
    ball = F.pow(F.lit(math.pi), F.lit(1 / 3)) * F.pow(6 * n, F.lit(2 / 3))
    return j.select(*by, "label", "volume", "faces", "feret", F.when(F.col("r2") > 1e-9, F.col("r1") / F.col("r2")).alias("elongation"), F.when(s > 0, ball / s).otherwise(0.0).alias("sphericity"), F.when(s > 0, 36 * math.pi * n * n / (s * s * s)).otherwise(0.0).alias("compactness"), "mean", "sd", "least", "most", "z")
