"""Profiles of intensity within objects: every voxel falls at once into the bins of all profiles of its object's own frame.

An object's frame is its centre, its box and the axes of its own voxels. Voxels meet objects by place, or,
for whole boxes, by the cubes of space that a box touches; their sums by bin are combined before they move.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvox.functions.lineage import cut, few
from tabvox.operators.tensors import eigen3

AXES = "xyz"


@dataclass(frozen=True)
class Profile:
    """Settings. region: `box` (all voxels of an object's box) or `object`; pad: per cent by which a box grows on
    each side, within the image; normal: `range`, `mean` or `z`; ring: per cent of the brightest angle that a present one has."""

    region: str = "box"
    radial: int = 20
    angular: int = 12
    shells: int = 3
    axis: int = 50
    pad: float = 0.0
    normal: str = "range"
    ring: float = 50.0

    def __post_init__(self):
        if self.region not in ("box", "object") or self.normal not in ("range", "mean", "z"):
            raise ValueError("region: box or object; normal: range, mean or z")
        if min(self.radial, self.angular, self.shells, self.axis) < 1:
            raise ValueError("every profile needs a bin")

    def bins(self) -> dict[str, int]:
        return {"radial": self.radial, "shell": self.shells, "angular": self.angular, **{a: self.axis for a in AXES}, **{f"axis{k}": self.axis for k in (1, 2, 3)}}


def frames(labels: DataFrame, by: list[str], extent: DataFrame, scale: tuple[float, float, float] = (1.0, 1.0, 1.0), pad: float = 0.0) -> DataFrame:
    """(by, label, n, cx.., x0.., x1.., far, e1..e3, half1..half3, elongation, flatness) of positive labels (by, z, y, x, label).

    scale: steps along x, y, z. extent: (by, x_lo, x_hi, ..) of the images, which a padded box stays in. far: from the
    centre to the box's farthest corner; half: the largest projection of a corner on an axis. e1: the longest axis.
    """
    o = labels.where("label > 0").groupBy(*by, "label")
    step = dict(zip(AXES, scale, strict=True))
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    o = o.agg(
        F.count("*").alias("n"),
        *[F.avg(a).alias(f"c{a}") for a in AXES],
        *[f(a).alias(f"{a}{i}") for a in AXES for i, f in enumerate((F.min, F.max))],
        *[(F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) * step[a] * step[b]).alias(f"m{a}{b}") for a, b in pairs],
    )
    if by:
        o = o.join(few(extent), by)
    else:
        o = o.crossJoin(F.broadcast(extent))
    grown = {a: F.round(pad / 100 * (F.col(f"{a}1") - F.col(f"{a}0") + 1)).cast("int") for a in AXES}
    o = o.withColumns({f"{a}0": F.greatest(F.col(f"{a}_lo"), F.col(f"{a}0") - grown[a]) for a in AXES} | {f"{a}1": F.least(F.col(f"{a}_hi"), F.col(f"{a}1") + grown[a]) for a in AXES})
    o = o.withColumn("e", eigen3(*[f"m{a}{b}" for a, b in pairs]))
    side = lambda a, i: (F.col(f"{a}{i}") - F.col(f"c{a}")) * step[a]
    far = F.sqrt(sum((F.pow(F.greatest(F.abs(side(a, 0)), F.abs(side(a, 1))), 2) for a in AXES), F.lit(0.0)))

    def half(k):
        ends = [[side(a, i) * F.col(f"e.v{k}")[j] for i in (0, 1)] for j, a in enumerate(AXES)]
        return F.greatest(F.abs(sum((F.greatest(*x) for x in ends), F.lit(0.0))), F.abs(sum((F.least(*x) for x in ends), F.lit(0.0))))

    value = lambda k: F.col("e.values")[k]
    return o.select(
        *by, "label", "n", *[f"c{a}" for a in AXES], *[f"{a}{i}" for a in AXES for i in (0, 1)],
        F.when(far > 0, far).otherwise(1.0).alias("far"),
        *[F.col(f"e.v{k}").alias(f"e{k}") for k in (1, 2, 3)],
        *[F.greatest(F.lit(1e-9), half(k)).alias(f"half{k}") for k in (1, 2, 3)],
        F.when(value(1) > 1e-12, F.sqrt(value(0) / value(1))).alias("elongation"),
        F.when(value(2) > 1e-12, F.sqrt(value(1) / value(2))).alias("flatness"),
    )


def _met(frame: DataFrame, labels: DataFrame, voxels: DataFrame, by: list[str], region: str, size: int) -> DataFrame:
    """Voxels with the frames of the objects whose region they are in."""
    if region == "object":
        own = labels.where("label > 0").select(*by, "label", "z", "y", "x").join(voxels.hint("merge"), [*by, "z", "y", "x"])
        return own.join(frame.hint("merge"), [*by, "label"])
    cubes = frame
    for a in AXES:
        cubes = cubes.withColumn(f"t{a}", F.explode(F.sequence(F.floor(F.col(f"{a}0") / size), F.floor(F.col(f"{a}1") / size))))
    cut_up = voxels.withColumns({f"t{a}": F.floor(F.col(a) / size) for a in AXES})
    inside = " AND ".join(f"{a} BETWEEN {a}0 AND {a}1" for a in AXES)
    return cut_up.join(cubes.hint("merge"), [*by, *[f"t{a}" for a in AXES]]).where(inside)


def profiles(labels: DataFrame, voxels: DataFrame, by: list[str], source: str, how: Profile | None = None, scale: tuple[float, float, float] = (1.0, 1.0, 1.0), size: int = 32) -> dict[str, DataFrame]:
    """Profiles of each object of labels (by, z, y, x, label) in each channel of voxels (by, channel, z, y, x, value).

    curves: (by, label, channel, profile, bin, n, mean, normed) of `radial`, `shell`, `angular`, `x`, `y`, `z`, and `axis1` to
    `axis3` (longest to shortest), only bins that hold voxels; axes point to where the source channel is brighter.
    summary: (by, label, channel, core_edge, peak, polarity, ring, uniformity, inner, middle, outer, axis_polarity, pearson,
    manders, elongation, flatness); pearson and manders are against the source channel, null if it has no voxel there.
    Voxels without a finite value count nowhere.
    """
    how = how or Profile()
    bins = how.bins()
    v = voxels.select(*by, "channel", "z", "y", "x", F.col("value").cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")
    extent = voxels.groupBy(*by).agg(*[f(a).alias(f"{a}_{n}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    frame = cut(frames(labels, by, extent, scale, how.pad))
    first = v.where(F.col("channel") == source).select(*by, "z", "y", "x", F.col("value").alias("first"))
    met = _met(frame, labels, v.join(first.hint("merge"), [*by, "z", "y", "x"], "left"), by, how.region, size)

    d = {a: (F.col(a) - F.col(f"c{a}")) * s for a, s in zip(AXES, scale, strict=True)}
    met = met.withColumns({f"d{a}": d[a] for a in AXES})
    met = met.withColumns({f"p{k}": sum((F.col(f"d{a}") * F.col(f"e{k}")[j] for j, a in enumerate(AXES)), F.lit(0.0)) for k in (1, 2, 3)})
    share = F.sqrt(sum((F.col(f"d{a}") * F.col(f"d{a}") for a in AXES), F.lit(0.0))) / F.col("far")
    # marginal axes reach from -1 to 1, each side as long as the box's there
    offset = {a: F.col(a) - F.col(f"c{a}") for a in AXES}
    signed = {a: offset[a] / F.greatest(F.lit(1e-9), F.when(offset[a] < 0, F.col(f"c{a}") - F.col(f"{a}0")).otherwise(F.col(f"{a}1") - F.col(f"c{a}"))) for a in AXES}
    signed |= {f"axis{k}": F.col(f"p{k}") / F.col(f"half{k}") for k in (1, 2, 3)}
    turn = F.pmod(F.round(F.atan2("dy", "dx") / (2 * math.pi), 12), F.lit(1.0))
    place = {"radial": share, "shell": share, "angular": turn, **{n: (t + 1) / 2 for n, t in signed.items()}}
    bin_ = {n: F.greatest(F.lit(0), F.least(F.lit(bins[n] - 1), F.floor(F.round(t * bins[n], 9)).cast("int"))) for n, t in place.items()}
    rows = met.select(
        *by, "label", "channel", "value", "first", *[f"d{a}" for a in AXES], *[f"p{k}" for k in (1, 2, 3)],
        F.inline(F.array(*[F.struct(F.lit(n).alias("profile"), b.alias("bin")) for n, b in bin_.items()])),
    )
    x, y = F.col("value"), F.col("first")
    both = lambda e: F.sum(F.when(y.isNotNull(), e))
    parts = {"n": F.count("*"), "s": F.sum(x), "ss": F.sum(x * x), **{f"s{c}": F.sum(x * F.col(c)) for c in ("dx", "dy", "dz", "p1", "p2", "p3")}}
    parts |= {"m": F.count(y), "a": F.sum(y), "b": both(x), "aa": F.sum(y * y), "bb": both(x * x), "ab": both(x * y)}
    per = cut(rows.groupBy(*by, "label", "channel", "profile", "bin").agg(*[e.alias(n) for n, e in parts.items()], F.min(x).alias("low"), F.max(x).alias("high")))

    key = [*by, "label"]
    total = per.where("profile = 'radial'").groupBy(*key, "channel").agg(*[F.sum(n).alias(n) for n in parts], F.min("low").alias("low"), F.max("high").alias("high"))
    turned = total.where(F.col("channel") == source).select(*key, *[(F.col(f"sp{k}") < 0).alias(f"turn{k}") for k in (1, 2, 3)])
    total = total.join(turned, key, "left").withColumns({f"turn{k}": F.coalesce(f"turn{k}", F.lit(False)) for k in (1, 2, 3)})

    mean, sd = F.col("t_s") / F.col("t_n"), F.sqrt(F.greatest(F.lit(0.0), F.col("t_ss") / F.col("t_n") - F.pow(F.col("t_s") / F.col("t_n"), 2)))
    raw = F.col("s") / F.col("n")
    normed = {
        "range": F.when(F.col("t_high") > F.col("t_low"), (raw - F.col("t_low")) / (F.col("t_high") - F.col("t_low"))),
        "mean": F.when(mean != 0, raw / mean),
        "z": F.when(sd > 0, (raw - mean) / sd),
    }[how.normal]
    whole = total.select(*key, "channel", *[F.col(c).alias(f"t_{c}") for c in ("n", "s", "ss", "low", "high")], "turn1", "turn2", "turn3")
    back = F.lit(False)
    for k in (1, 2, 3):
        back = F.when(F.col("profile") == f"axis{k}", F.col(f"turn{k}")).otherwise(back)
    at = F.when(back, how.axis - 1 - F.col("bin")).otherwise(F.col("bin"))
    curves = per.join(whole, [*key, "channel"]).select(*key, "channel", "profile", at.alias("bin"), "n", raw.alias("mean"), F.coalesce(normed, F.lit(0.0)).alias("normed"))

    of = lambda name, when=None: F.when((F.col("profile") == name) & (F.lit(True) if when is None else when), F.col("mean"))
    b, n = F.col("bin"), how.radial
    core, edge = F.coalesce(F.avg(of("radial", b < n // 3)), F.lit(0.0)), F.coalesce(F.avg(of("radial", b >= 2 * n // 3)), F.lit(0.0))
    angles = F.collect_list(of("angular"))
    round_ = F.avg(of("angular"))
    shape = curves.groupBy(*key, "channel").agg(
        F.when(edge > 0, core / edge).alias("core_edge"),
        ((F.max_by(F.when(F.col("profile") == "radial", b), F.when(F.col("profile") == "radial", F.struct(F.round("mean", 9), -b))) + 0.5) / n).alias("peak"),
        F.when(F.array_max(angles) > 0, F.size(F.filter(angles, lambda m: m >= how.ring / 100 * F.array_max(angles))) / how.angular).alias("ring"),
        F.when(round_ > 0, F.greatest(F.lit(0.0), 1 - F.stddev_pop(of("angular")) / round_)).alias("uniformity"),
        *[F.max(of("shell", b == k)).alias(name) for name, k in (("inner", 0), ("middle", how.shells // 2), ("outer", how.shells - 1))],
    )
    c = F.col
    va, vb = c("aa") - c("a") * c("a") / c("m"), c("bb") - c("b") * c("b") / c("m")
    reach = F.sqrt(sum((F.pow(c(f"sd{a}") / c("s"), 2) for a in AXES), F.lit(0.0)))
    along = c("sp1") / c("s") / c("half1")
    numbers = total.join(frame.select(*key, "far", "half1", "elongation", "flatness"), key).select(
        *key, "channel",
        F.when(c("s") > 0, reach / c("far")).alias("polarity"),
        F.when(c("s") > 0, F.when(c("turn1"), -along).otherwise(along)).alias("axis_polarity"),
        F.when((c("m") > 0) & (va > 0) & (vb > 0), (c("ab") - c("a") * c("b") / c("m")) / F.sqrt(va * vb)).alias("pearson"),
        F.when(c("aa") * c("bb") > 0, c("ab") / F.sqrt(c("aa") * c("bb"))).alias("manders"),
        "elongation", "flatness",
    )
    return {"curves": curves, "summary": shape.join(numbers, [*key, "channel"])}
