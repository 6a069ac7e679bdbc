"""Corrections of one channel by others, colocalisation by chance, depth and texture on pixel tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabvox.functions.lineage import cut, few
from tabvox.functions.scalar import correlation
from tabvox.operators.aggregate import class_fractions, nearest_rank
from tabvox.operators.distance import distances
from tabvox.operators.pixels import convolve
from tabvox.operators.points import kmeans, zscore
from tabvox.operators.rank import knee, otsu
from tabvox.operators.spatial import neighbours, shifted
from tabvox.operators.tiles import box_sums, tiled


def global_ratio(voxels: DataFrame, by: list[str], quiet: float, saturated: float) -> DataFrame:
    """Add corrected: the target without the share of contaminant c1 that fits its quiet, unsaturated pixels; 0..65535, rounded.

    The share is at least 0; a group without such pixels keeps its target.
    """
    t, c = F.col("target"), F.col("c1")
    fit = voxels.where((t <= quiet) & (F.greatest(t, c) < saturated)).groupBy(*by).agg((F.sum(t * c) / F.nullif(F.sum(c * c), F.lit(0.0))).alias("k"))
    k = F.greatest(F.lit(0.0), F.coalesce("k", F.lit(0.0)))
    return voxels.join(fit, by, "left").withColumn("corrected", F.round(F.least(F.lit(65535.0), F.greatest(F.lit(0.0), t - k * c)))).drop("k")


def local_ratio(voxels: DataFrame, by: list[str], quiet: float, saturated: float, reach: int, least: int) -> DataFrame:
    """As global_ratio, with the share fitted in a square window around each pixel; where it holds fewer than `least` quiet pixels, the group's share."""
    t, c = F.col("target"), F.col("c1")
    free = (t <= quiet) & (F.greatest(t, c) < saturated)
    whole = voxels.where(free).groupBy(*by).agg((F.sum(t * c) / F.nullif(F.sum(c * c), F.lit(0.0))).alias("k0"))

    def run(a):
        q, t, c = (np.nan_to_num(a[x]) for x in ("q", "target", "c1"))
        n, tc, cc = box_sums(q, reach), box_sums(q * t * c, reach), box_sums(q * c * c, reach)
        known = (n > least - 0.5) & (cc > 1e-9)
        return {"k": np.where(known, tc / np.where(known, cc, 1.0), np.nan)}

    local = tiled(voxels.withColumn("q", free.cast("double")), by, ["q", "target", "c1"], reach, run, ["k"])
    j = voxels.join(local.hint("merge"), [*by, "y", "x"], "left").join(few(whole), by, "left")
    k = F.coalesce(F.nanvl("k", F.lit(None)), "k0", F.lit(0.0))
    return j.withColumn("corrected", F.round(F.least(F.lit(65535.0), F.greatest(F.lit(0.0), t - F.greatest(F.lit(0.0), k) * c)))).drop("k", "k0")


def envelope(voxels: DataFrame, by: list[str], contaminants: list[str], dominant: float = 0.5, level: float = 0.9, bins: int = 16, least: int = 10) -> DataFrame:
    """Add adjusted: the target without the envelope that its contaminants' sum explains; 0..65535, rounded.

    Among pixels whose sum is positive and reaches the percentile `dominant`, each bin of the sum gives
    the nearest-rank percentile `level` of the target; a bin of fewer than `least` pixels takes the one
    before it (the first: 0). The envelope never falls from bin to bin and is interpolated between
    bins spread evenly from 0 to the largest sum.
    """
    score = sum((F.col(c) for c in contaminants), F.lit(0.0))
    v = voxels.withColumn("__s", score)
    top = v.groupBy(*by).agg(F.max("__s").alias("__top"))
    strong_from = nearest_rank(v, by, "__s", dominant).withColumnRenamed("value", "__cut")
    v = v.join(top.join(strong_from, by), by)
    bin_ = F.least(F.lit(bins - 1), F.floor(F.col("__s") / F.col("__top") * bins).cast("int"))
    strong = v.where("__s >= __cut AND __s > 0").select(*by, bin_.alias("__bin"), "target")
    enough = strong.groupBy(*by, "__bin").agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    levels = nearest_rank(strong.join(enough, [*by, "__bin"], "left_semi"), [*by, "__bin"], "target", level)
    # at most `bins` values a group
    known = levels.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__bin", "value"))).alias("__m"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.array_max(F.transform(F.sequence(F.lit(0), i), lambda j: F.coalesce(F.try_element_at(F.col("__m"), j), F.lit(0.0)))), F.lit(0.0)))
    j = v.join(known.select(*by, steps.alias("__e")), by, "left")
    at = F.col("__s") / F.col("__top") * (bins - 1)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    lower, upper = F.get("__e", low), F.get("__e", high)
    predicted = F.when((F.col("__s") > 0) & F.col("__e").isNotNull(), lower + (upper - lower) * (at - low)).otherwise(0.0)
    return j.withColumn("adjusted", F.round(F.least(F.lit(65535.0), F.greatest(F.lit(0.0), F.col("target") - predicted)))).drop("__s", "__top", "__cut", "__e")


def chance_correlation(ab: DataFrame, by: list[str], size: int = 5, rounds: int = 199, seed: int = 1, rows: int = 200_000) -> DataFrame:
    """(by, pearson, p): how often a, shuffled against b by blocks of size x size pixels, correlates as well: (as well + 1) / (rounds + 1).

    A block is one row of up to size² values, so a shuffle moves blocks, not pixels; a pixel that lacks
    in either of two blocks doesn't count. p is null where the correlation is.
    """
    at = (F.pmod("y", F.lit(size)) * size + F.pmod("x", F.lit(size))).cast("int")
    held = ab.groupBy(*by, F.floor(F.col("y") / size).alias("by_"), F.floor(F.col("x") / size).alias("bx_")).agg(F.map_from_entries(F.collect_list(F.struct(at, "a"))).alias("pa"), F.map_from_entries(F.collect_list(F.struct(at, "b"))).alias("pb"))
    dense = lambda p: F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.try_element_at(F.col(p), i)).alias(p)
    blocks = held.select(*by, "by_", "bx_", dense("pa"), dense("pb"))
    sims = blocks.select("*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("sim"))
    w = W.partitionBy(*by, "sim")
    fixed = sims.select(*by, "sim", "pb", F.row_number().over(w.orderBy("by_", "bx_")).alias("k"))
    moved = sims.select(*by, "sim", "pa", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "sim", "by_", "bx_"), "by_", "bx_")).alias("k"))
    met = fixed.join(moved.hint("merge"), [*by, "sim", "k"]).select(*by, "sim", F.explode(F.arrays_zip("pa", "pb")).alias("v"))
    null = met.groupBy(*by, "sim").agg(correlation("v.pa", "v.pb").alias("r"))
    seen = ab.groupBy(*by).agg(correlation("a", "b").alias("pearson"))
    over = seen.join(null.hint("merge"), by).groupBy(*by).agg(F.sum((F.col("r") >= F.col("pearson")).cast("int")).alias("k"))
    return seen.join(over, by, "left").select(*by, "pearson", F.when(F.col("pearson").isNotNull(), (F.coalesce("k", F.lit(0)) + 1) / (rounds + 1)).alias("p"))


def mark_correlation(ab: DataFrame, by: list[str], reach: int = 12) -> DataFrame:
    """(by, radius, strength): the rounded radius at which mean(a here * b there) is largest against mean(a) mean(b); ties: the smallest.

    Null for groups whose baseline isn't positive.
    """
    ring = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if math.floor(math.hypot(dy, dx) + 0.5) <= reach]
    radii = F.array(*[F.lit(math.floor(math.hypot(dy, dx) + 0.5)) for dy, dx in ring])
    pairs = ab.select(*by, "y", "x", "a").join(shifted(ab.select(*by, "y", "x", "b"), ring, ["y", "x"], "b").hint("merge"), [*by, "y", "x"])
    sums = pairs.groupBy(*by, F.get(radii, F.col("offset")).alias("radius")).agg(F.avg(F.col("a") * F.col("other")).alias("m"))
    base = ab.groupBy(*by).agg((F.avg("a") * F.avg("b")).alias("base"))
    best = sums.join(base.where("base > 0"), by).withColumn("s", F.col("m") / F.col("base"))
    peak = best.groupBy(*by).agg(F.max_by(F.struct("radius", F.col("s").alias("strength")), F.struct(F.round("s", 9), -F.col("radius"))).alias("m")).select(*by, "m.*")
    return base.select(*by).join(peak, by, "left")


def depth_profile(voxels: DataFrame, mask: DataFrame, by: list[str], width: float, rim: float, bins: int = 5) -> dict[str, DataFrame]:
    """bins: (by, bin, n, mean) and summary: (by, slope, peak, rim_core, edge) of values by distance from the mask's boundary.

    The boundary is the mask's pixels with a 4-neighbour outside it. Only the first `bins` bins are
    reported as such; slope, peak (middle of the brightest bin of all, ties: the first), ratio of rim and
    core means, and their difference over the mean use every pixel.
    """
    inner = neighbours(mask.select(*by, "y", "x", F.lit(1).alias("value")), by, [(0, 1), (0, -1), (1, 0), (-1, 0)], ["y", "x"]).groupBy(*by, "y", "x").agg(F.count("*").alias("n")).where("n = 4")
    edge = mask.select(*by, "y", "x").join(inner.hint("merge"), [*by, "y", "x"], "left_anti")
    d = distances(voxels.join(mask.select(*by, "y", "x").hint("merge"), [*by, "y", "x"], "left_semi"), edge, by, ["y", "x"])
    d = d.withColumn("bin", F.floor(F.round(F.col("distance") / width, 9)))
    per = d.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    peak = per.groupBy(*by).agg(((F.max_by("bin", F.struct(F.round("mean", 9), -F.col("bin"))) + 0.5) * width).alias("peak"))
    outer, core = F.avg(F.when(F.col("distance") <= rim, F.col("value"))), F.avg(F.when(F.col("distance") > rim, F.col("value")))
    line = d.groupBy(*by).agg(F.regr_slope(F.col("value"), F.col("distance")).alias("slope"), F.when(core > 0, outer / core).alias("rim_core"), F.when(F.avg("value") > 0, (outer - core) / F.avg("value")).alias("edge"))
    return {"bins": per.where(F.col("bin") < bins), "summary": line.join(peak, by).select(*by, "slope", "peak", "rim_core", "edge")}


def gauss(voxels: DataFrame, by: list[str], sigma: float) -> DataFrame:
    """Values smoothed along rows, then columns, to three sigma; weights of pixels that lack go to the others."""
    reach = math.ceil(3 * sigma)
    weights = [(i, math.exp(-i * i / (2 * sigma * sigma))) for i in range(-reach, reach + 1)]

    def along(df, axis):
        k = F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.lit(w).alias("w")) for i, w in weights])).alias("k")
        place = [(F.col(c) + F.col("k.d")).alias(c) if c == axis else F.col(c) for c in ("y", "x")]
        sums = df.select(*by, "y", "x", "value", k).groupBy(*by, *place).agg((F.sum(F.col("value") * F.col("k.w")) / F.sum("k.w")).alias("value"))
        return sums.join(voxels.select(*by, "y", "x").hint("merge"), [*by, "y", "x"], "left_semi")

    return cut(along(along(voxels.select(*by, "y", "x", "value"), "x"), "y"))


def texture_classes(voxels: DataFrame, by: list[str], classes: int = 3, seed: int = 1) -> DataFrame:
    """(by, class, fraction): k-means classes of intensity, difference of Gaussians, gradient and residue, weighted towards intensity.

    Classes are learned over all groups, so they mean the same in each, and numbered by mean intensity.
    """
    small, large = gauss(voxels, by, 1.0), gauss(voxels, by, 3.0)
    side = neighbours(small, by, [(0, 1), (0, -1), (1, 0), (-1, 0)], ["y", "x"]).groupBy(*by, "y", "x").pivot("offset", [0, 1, 2, 3]).agg(F.first("other"))
    zero = F.lit(0.0)
    grad = side.select(*by, "y", "x", F.sqrt(F.pow(F.coalesce((F.col("0") - F.col("1")) / 2, zero), 2) + F.pow(F.coalesce((F.col("2") - F.col("3")) / 2, zero), 2)).alias("gradient"))
    j = voxels.select(*by, "y", "x", "value").join(small.withColumnRenamed("value", "s"), [*by, "y", "x"]).join(large.withColumnRenamed("value", "l"), [*by, "y", "x"]).join(grad, [*by, "y", "x"], "left")
    names = ["value", "band", "gradient", "residue"]
    f = j.select(*by, "y", "x", "value", (F.col("s") - F.col("l")).alias("band"), F.coalesce("gradient", zero).alias("gradient"), F.abs(F.col("value") - F.col("s")).alias("residue"))
    z = zscore(f, names)
    # fixed values: weights of the four features
    got, model = kmeans(z.withColumns({n: F.col(n) * w for n, w in zip(names, (6.0, 0.35, 0.35, 0.35), strict=True)}), names, classes, seed)
    order = sorted(range(len(model.clusterCenters())), key=lambda i: float(model.clusterCenters()[i][0]))
    number = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)])
    return class_fractions(got.withColumn("class_", F.element_at(number, F.col("cluster"))), by, "class_", classes)


def texture_vector(voxels: DataFrame, labels: DataFrame, by: list[str], size: int = 3, sigma: float = 2.0, wavelength: float = 4.0) -> DataFrame:
    """(by, label, gabor0..3, wave0..3): mean squared responses of an object's pixels to Gabor kernels of four
    directions and to four a-trous differences of B3-spline smoothings."""
    out = labels.where("label > 0").select(*by, "label", "y", "x")
    names = []
    for i in range(4):
        a = i * math.pi / 4
        kernel = [(dy, dx, math.exp(-(dy * dy + dx * dx) / (2 * sigma * sigma)) * math.cos(2 * math.pi * (dx * math.cos(a) + dy * math.sin(a)) / wavelength)) for dy in range(-size, size + 1) for dx in range(-size, size + 1)]
        mean = sum(w for *_, w in kernel) / len(kernel)
        names.append(f"gabor{i}")
        out = out.join(convolve(voxels, by, [(dy, dx, w - mean) for dy, dx, w in kernel]).withColumnRenamed("value", names[-1]), [*by, "y", "x"], "left")
    spline = [(-2, 1 / 16), (-1, 1 / 4), (0, 3 / 8), (1, 1 / 4), (2, 1 / 16)]
    now = voxels.select(*by, "y", "x", "value")
    for i in range(4):
        step = 2**i
        smooth = cut(convolve(convolve(now, by, [(0, k * step, w) for k, w in spline]), by, [(k * step, 0, w) for k, w in spline]))
        names.append(f"wave{i}")
        detail = now.join(smooth.withColumnRenamed("value", "s"), [*by, "y", "x"]).select(*by, "y", "x", (F.col("value") - F.col("s")).alias(names[-1]))
        out, now = cut(out.join(detail, [*by, "y", "x"], "left")), smooth
    return out.groupBy(*by, "label").agg(*[F.avg(F.col(n) * F.col(n)).alias(n) for n in names])


def object_coloc(ab: DataFrame, by: list[str], ta: float, tb: float) -> DataFrame:
    """(by, label, n, pearson, m1, m2) of the pixels of each object; shares are null where a channel sums to 0."""
    share = lambda v, o, t: F.sum(F.when(F.col(o) > t, F.col(v)).otherwise(0.0)) / F.nullif(F.sum(v), F.lit(0.0))
    return ab.where("label > 0").groupBy(*by, "label").agg(F.count("*").alias("n"), correlation("a", "b").alias("pearson"), share("a", "b", tb).alias("m1"), share("b", "a", ta).alias("m2"))


def threshold_sweep(voxels: DataFrame, by: list[str], thresholds: list[float]) -> DataFrame:
    """(by, threshold, area, mean, iou): the mask at each threshold in one pass; iou: mean overlap with the masks of the neighbouring ones.

    Masks of rising thresholds are nested, so their intersection over union is the ratio of their areas.
    """
    ts = sorted(thresholds)
    v = F.col("value")
    one = voxels.groupBy(*by).agg(*[x for i, t in enumerate(ts) for x in (F.sum((v >= t).cast("long")).alias(f"n{i}"), F.avg(F.when(v >= t, v)).alias(f"m{i}"))])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("area"), F.col(f"m{i}").alias("mean")) for i, t in enumerate(ts)])
    long = one.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    w = W.partitionBy(*by).orderBy("threshold")
    lower, upper = F.lag("area").over(w), F.lead("area").over(w)
    near = F.array_compact(F.array(F.when(lower > 0, F.col("area") / lower), F.when(F.col("area") > 0, upper / F.col("area"))))
    return long.withColumn("iou", F.when(F.size(near) > 0, F.aggregate(near, F.lit(0.0), lambda s, x: s + x) / F.size(near)))


def sweep_choice(sweep: DataFrame, by: list[str]) -> DataFrame:
    """(by, knee, steepest, stable): where areas bend and step most, and the threshold of the steadiest mask (ties: the smallest)."""
    k = knee(sweep.withColumn("area", F.col("area").cast("double")), by, "threshold", "area")
    return k.join(sweep.groupBy(*by).agg(F.max_by("threshold", F.struct(F.round("iou", 9), -F.col("threshold"))).alias("stable")), by)


def split_quality(voxels: DataFrame, by: list[str], bins: int = 256) -> DataFrame:
    """(by, foreground, background_sd, snr) on either side of the Otsu split of a histogram from the least to the largest value.

    snr is 0 where the background doesn't vary. A constant image has no split and no row.
    """
    span = voxels.groupBy(*by).agg(F.min("value").alias("__lo"), F.max("value").alias("__hi")).where("__hi > __lo")
    v = voxels.join(span, by).withColumn("__bin", F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins).cast("int")))
    split = otsu(v.groupBy(*by, "__bin").agg(F.count("*").alias("c")), by, "__bin", "c")
    over = F.col("__bin") > F.col("threshold")
    s = v.join(split, by).groupBy(*by).agg(F.avg(F.when(over, F.col("value"))).alias("foreground"), F.stddev_pop(F.when(~over, F.col("value"))).alias("background_sd"))
    return s.withColumn("snr", F.when(F.col("background_sd") > 0, F.col("foreground") / F.col("background_sd")).otherwise(0.0))


def permutation_p(df: DataFrame, by: list[str], id: str, group: str, value: str, rounds: int = 199, seed: int = 1, rows: int = 200_000) -> DataFrame:
    """(by, observed, p): the spread of group means (largest less smallest) against label shuffles; (as large + 1) / (rounds + 1).

    How many of a value's rows a group gets under a shuffle is a draw without replacement, so a shuffle of labels is drawn
    stretch by stretch: first how many labels of each group fall to each stretch of about `rows` rows, then their places within it.
    Draws are seeded by shuffle and stretch, and rows lie in a stretch by their id, so a run repeats whatever its partitions.
    """
    spread = lambda d, keys: d.groupBy(*keys, group).agg(F.avg(value).alias("__m")).groupBy(*keys).agg((F.max("__m") - F.min("__m")).alias("observed"))
    kind = dict(df.dtypes)
    # avg passes over missing values, and groups of missing values only have no mean
    held = df.withColumn("__s", F.xxhash64(F.lit(seed), id))
    parts = cut(df.groupBy(*by).agg(F.ceil(F.count("*") / rows).cast("int").alias("__parts")))
    placed = cut(held.join(F.broadcast(parts), by).withColumn("__p", F.pmod("__s", F.col("__parts"))).select(*by, id, group, value, "__p"))
    sizes = placed.groupBy(*by, "__p").agg(F.count("*").alias("n"))
    labels = placed.groupBy(*by, F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), F.col(group).isNull().alias("none")).agg(F.count("*").alias("n"))
    # a row for each stretch and each group
    plan = sizes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__p", "n"))).alias("parts")).join(labels.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("none", "g", "n"))).alias("labels")), by)
    rounds_of = plan.select("*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("__sim")).repartition(*by, "__sim")
    keys = ", ".join(f"`{c}` {kind[c]}" for c in by)

    def deal(batches):
        for df in batches:
            for _, r in df.iterrows():
                left = np.array([x["n"] for x in r["labels"]], dtype=np.int64)
                rng = np.random.default_rng([seed, int(r["__sim"])])
                out = []
                for x in r["parts"]:
                    got = rng.multivariate_hypergeometric(left, int(x["n"]), method="marginals")
                    left = left - got
                    out.append(got.tolist())
                yield pd.DataFrame({**{c: [r[c]] * len(out) for c in by}, "__sim": r["__sim"], "__p": [x["__p"] for x in r["parts"]], "counts": out})

    dealt = rounds_of.mapInPandas(deal, f"{keys}, `__sim` int, `__p` long, counts array<long>")

    def draw(key: tuple, values: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        v = values.sort_values([id, value], kind="stable")[value].to_numpy(float)
        known, v = ~np.isnan(v), np.nan_to_num(v)
        out = []
        for sim, n in zip(counts["__sim"], counts["counts"], strict=True):
            rng = np.random.default_rng([seed, int(sim), int(key[-1])])
            label = rng.permutation(np.repeat(np.arange(len(n)), n))
            out.append(pd.DataFrame({"__sim": sim, "__g": np.arange(len(n)), "__v": np.bincount(label, v, len(n)), "__n": np.bincount(label, known, len(n)).astype(np.int64)}))
        got = pd.concat(out) if out else pd.DataFrame({"__sim": [], "__g": [], "__v": [], "__n": []})
        return got.assign(**{c: k for c, k in zip(by, key, strict=False)})[[*by, "__sim", "__g", "__v", "__n"]]

    sums = placed.select(*by, "__p", id, value).groupBy(*by, "__p").cogroup(dealt.select(*[F.col(c).alias(c) for c in (*by, "__p", "__sim", "counts")]).groupBy(*by, "__p")).applyInPandas(draw, f"{keys}, `__sim` int, `__g` int, `__v` double, `__n` long")
    means = sums.groupBy(*by, "__sim", "__g").agg((F.sum("__v") / F.nullif(F.sum("__n"), F.lit(0))).alias("__m"))
    null = means.groupBy(*by, "__sim").agg((F.max("__m") - F.min("__m")).alias("null"))
    seen = spread(df, by)
    return seen.join(null.hint("merge"), by).groupBy(*by, "observed").agg(((F.sum((F.round("null", 9) >= F.round("observed", 9)).cast("int")) + 1) / (rounds + 1)).alias("p"))
