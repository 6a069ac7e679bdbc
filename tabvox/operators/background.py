"""Signal over background, and how even the background is, from counts of distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def signal_db(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(by, snr_db): 20 log10 of foreground less background mean over the background's deviation (1 if it doesn't vary).

    The sides are those of the value that best splits the values' counts (ties: the smallest); that value is
    foreground. 0 where a side is empty or the ratio isn't positive. Windows run over the distinct values of a group.
    """
    counts = pixels.where("value IS NOT NULL").groupBy(*by, F.col("value").cast("double").alias("value")).agg(F.count("*").alias("c"))
    all_, upto = W.partitionBy(*by), W.partitionBy(*by).orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    v, c = F.col("value"), F.col("c")
    run = counts.withColumns({"w": F.sum("c").over(upto), "s": F.sum(c * v).over(upto), "n": F.sum("c").over(all_), "t": F.sum(c * v).over(all_)})
    rest = F.col("n") - F.col("w")
    between = F.when(rest > 0, F.col("w") * rest * F.pow(F.col("s") / F.col("w") - (F.col("t") - F.col("s")) / rest, 2))
    split = F.max_by("value", F.struct(F.round(between / F.pow(F.col("n"), 2), 9), -v)).over(all_)
    fore = v >= F.when(F.count(between).over(all_) > 0, split)
    sums = run.withColumn("fore", fore).groupBy(*by).agg(*[F.sum(F.when(x, e)).alias(n) for n, x, e in (("fn", F.col("fore"), c), ("fs", F.col("fore"), c * v), ("bn", ~F.col("fore"), c), ("bs", ~F.col("fore"), c * v), ("bb", ~F.col("fore"), c * v * v))])
    mean = F.col("bs") / F.col("bn")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("bb") / F.col("bn") - mean * mean))
    ratio = (F.col("fs") / F.col("fn") - mean) / F.when(sd < 1e-6, 1.0).otherwise(sd)
    return sums.select(*by, F.when(ratio > 0, 20 * F.log10(ratio)).otherwise(0.0).alias("snr_db"))


def background_cv(pixels: DataFrame, by: list[str], tiles: int = 4) -> DataFrame:
    """(by, background_cv): deviation over mean of the tiles' background, the upper median of a tile's values under the image's mean.

    An image is cut into tiles * tiles; pixels beyond whole tiles count in none, nor do tiles without a positive background. 0 without any.
    """
    some = pixels.where("value IS NOT NULL").select(*by, "y", "x", F.col("value").cast("double").alias("value"))
    whole = some.groupBy(*by).agg(F.avg("value").alias("mean"), *[f(a).alias(f"{a}{i}") for a in "yx" for i, f in enumerate((F.min, F.max))])
    side = {a: F.greatest(F.lit(1), F.floor((F.col(f"{a}1") - F.col(f"{a}0") + 1) / tiles)) for a in "yx"}
    cut = some.join(whole.hint("merge"), by).withColumns({f"t{a}": F.floor((F.col(a) - F.col(f"{a}0")) / side[a]) for a in "yx"})
    counts = cut.where((F.col("value") < F.col("mean")) & (F.col("ty") < tiles) & (F.col("tx") < tiles)).groupBy(*by, "ty", "tx", "value").agg(F.count("*").alias("c"))
    tile = W.partitionBy(*by, "ty", "tx")
    run = counts.withColumns({"w": F.sum("c").over(tile.orderBy("value")), "n": F.sum("c").over(tile)})
    medians = run.where(F.col("w") > F.floor(F.col("n") / 2)).groupBy(*by, "ty", "tx").agg(F.min("value").alias("m")).where("m > 0")
    cv = medians.groupBy(*by).agg(F.when(F.avg("m") > 1e-6, F.stddev_pop("m") / F.avg("m")).alias("cv"))
    return whole.select(*by).join(cv, by, "left").select(*by, F.coalesce("cv", F.lit(0.0)).alias("background_cv"))
