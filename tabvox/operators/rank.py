"""Ranks, scores over groups, outliers and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabvox.functions.lineage import cut, few


def counts_below(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """Add below: the sum of n over smaller values of the group, for distinct (by, value, n).

    A window per group would sort a hot group in one task. Instead rows are range-partitioned by group
    and value; each range is summed on its own, and the sums of the ranges before it are added. Only
    these, a row for a group and range, meet in a window over the group. Nulls come first.
    """
    # a written table, so that the ranges that rows lie in don't change between their two uses
    placed = cut(counts.repartitionByRange(*[F.col(c) for c in by], F.col(value)).withColumn("__range", F.spark_partition_id()))
    before = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy(*by, "__range").agg(F.sum("n").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    ranges = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__r"), "__before")
    test = F.col("__range") == F.col("__r")
    for c in by:
        test = test & F.col(c).eqNullSafe(F.col(f"__{c}"))
    own = W.partitionBy(*by, "__range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    inside = placed.withColumn("__in", F.coalesce(F.sum("n").over(own), F.lit(0)))
    return inside.join(ranges, test).select(*counts.columns, (F.col("__before") + F.col("__in")).alias("below"))


def midrank(df: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """Average ranks of ties, and ties: the number of equal values."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    ranks = counts_below(counts, by, value).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*by, value])], F.col("n").alias("ties"), (F.col("below") + (F.col("n") + 1) / 2.0).alias(out))
    test = F.lit(True)
    for i, c in enumerate([*by, value]):
        test = test & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return df.join(ranks, test).drop(*[f"__k{i}" for i in range(len(by) + 1)])


def composite_pick(df: DataFrame, by: str, series: str, channel: str, value: str) -> DataFrame:
    """(by, series, score, pick): mean over channels of each series' rank; the first and last of each group, MIN_MAX if they are one."""
    ranked = df.withColumn("r", F.row_number().over(W.partitionBy(by, channel).orderBy(value, series)))
    score = ranked.groupBy(by, series).agg(F.avg("r").alias("score"))
    up, down = W.partitionBy(by).orderBy("score", series), W.partitionBy(by).orderBy(F.desc("score"), F.desc(series))
    out = score.withColumns({"a": F.row_number().over(up), "z": F.row_number().over(down)}).where("a = 1 OR z = 1")
    return out.select(by, series, "score", F.when((F.col("a") == 1) & (F.col("z") == 1), "MIN_MAX").when(F.col("a") == 1, "MIN").otherwise("MAX").alias("pick"))


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, q): the continuous percentiles of present values as an array, from ranks in ranges: no task holds a group's values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    total = few(counts.groupBy(*by).agg(F.sum("n").alias("__total")).withColumnsRenamed({c: f"__k{i}" for i, c in enumerate(by)}))
    test = F.lit(True)
    for i, c in enumerate(by):
        test = test & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    ranked = counts_below(counts, by, value).join(total, test)
    places = [F.lit(p) * (F.col("__total") - 1) for p in shares]
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col(value).cast("double")))
    got = ranked.groupBy(*by).agg(*[x for i, p in enumerate(places) for x in (at(F.floor(p)).alias(f"__a{i}"), at(F.ceil(p)).alias(f"__b{i}"), F.max(p - F.floor(p)).alias(f"__f{i}"))])
    mixed = [F.when(F.col(f"__f{i}") == 0, F.col(f"__a{i}")).otherwise((1 - F.col(f"__f{i}")) * F.col(f"__a{i}") + F.col(f"__f{i}") * F.col(f"__b{i}")) for i in range(len(shares))]
    return got.select(*by, F.array(*mixed).alias("q"))


def population_scale(df: DataFrame, by: list[str], value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Add scaled: value between two percentiles as 0..1; an empty span counts as 1."""
    # groups without a value keep their rows
    q = few(df.select(*by).distinct().join(quantiles(df, by, value, [low, high]).hint("merge"), by, "left"))
    a, b = F.col("q")[0], F.when(F.col("q")[1] <= F.col("q")[0], F.col("q")[0] + 1).otherwise(F.col("q")[1])
    return df.join(q, by).withColumn("scaled", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(value) - a) / (b - a)))).drop("q")


def morphology_score(sphericity: Column, pb: Column, sri: Column, volume: Column) -> Column:
    """Composite of four scaled features."""
    return 0.35 * (1 - sphericity) + 0.30 * pb + 0.20 * sri + 0.15 * volume


def shape_distance(df: DataFrame, by: list[str], moments: list[str], intensity: str, score: str) -> DataFrame:
    """Add smsd, the z-scored distance of the moments from their means, and imdi, |z(intensity) - z(score)|."""
    w = W.partitionBy(*by)
    z = lambda c: F.when(F.stddev_samp(c).over(w) > 0, (F.col(c) - F.avg(c).over(w)) / F.stddev_samp(c).over(w)).otherwise(0.0)
    return df.withColumns({"smsd": F.sqrt(sum((z(m) * z(m) for m in moments), F.lit(0.0))), "imdi": F.abs(z(intensity) - z(score))})


def territory_share(df: DataFrame, by: list[str], territory: str) -> DataFrame:
    """Add tdr: the territory times their number over their sum, over positive ones."""
    w = W.partitionBy(*by)
    t = F.when(F.col(territory) > 0, F.col(territory))
    return df.withColumn("tdr", t * F.count(t).over(w) / F.sum(t).over(w))


def robust_outliers(df: DataFrame, by: list[str], value: str, least: int = 3, cut: float = 3.0) -> DataFrame:
    """Add score and outlier: distance from the median by 1.4826 MAD, else by IQR / 1.349; groups without a scale are dropped."""
    q = df.groupBy(*by).agg(F.count(value).alias("n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).where(F.col("n") >= least)
    joined = df.join(q, by)
    mad = joined.groupBy(*by).agg(F.percentile(F.abs(F.col(value) - F.col("q")[1]), 0.5).alias("mad"))
    scale = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("q")[2] > F.col("q")[0], (F.col("q")[2] - F.col("q")[0]) / 1.349)
    out = joined.join(mad, by).withColumn("score", F.abs(F.col(value) - F.col("q")[1]) / scale).where("score IS NOT NULL")
    return out.withColumn("outlier", F.col("score") > cut).drop("n", "q", "mad")


def otsu(df: DataFrame, by: list[str], bin: str, count: str) -> DataFrame:
    """(by, threshold, between): the last bin of the lower class with the largest variance between classes; ties: the smallest."""
    w = W.partitionBy(*by).orderBy(bin).rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy(*by)
    x = df.withColumns({"w0": F.sum(count).over(w), "s0": F.sum(F.col(count) * F.col(bin)).over(w), "n": F.sum(count).over(all_), "s": F.sum(F.col(count) * F.col(bin)).over(all_)})
    m0, m1 = F.col("s0") / F.col("w0"), (F.col("s") - F.col("s0")) / (F.col("n") - F.col("w0"))
    x = x.where("w0 < n").withColumn("between", F.col("w0") * (F.col("n") - F.col("w0")) * F.pow(m0 - m1, 2) / F.pow(F.col("n"), 2))
    return x.groupBy(*by).agg(F.max_by(F.struct(F.col(bin).alias("threshold"), "between"), F.struct(F.round("between", 9), -F.col(bin))).alias("m")).select(*by, "m.threshold", "m.between")


def knee(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, knee, steepest): where the curve, both axes scaled to 0..1, rises farthest over the diagonal, and where it steps most."""
    w, o = W.partitionBy(*by), W.partitionBy(*by).orderBy(x)
    s = lambda c: (F.col(c) - F.min(c).over(w)) / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0))
    d = df.withColumns({"d": F.round(s(y) - s(x), 9), "step": F.round(F.abs(F.col(y) - F.lag(y).over(o)), 9)})
    return d.groupBy(*by).agg(F.max_by(x, F.struct("d", -F.col(x))).alias("knee"), F.max_by(x, F.struct("step", -F.col(x))).alias("steepest"))


def top_shifts(df: DataFrame, by: list[str], order: list, most: int = 6) -> DataFrame:
    """The first rows of each group in order, with more: how many are left out."""
    w = W.partitionBy(*by)
    return df.withColumns({"place": F.row_number().over(w.orderBy(*order)), "more": F.greatest(F.lit(0), F.count("*").over(w) - most)}).where(F.col("place") <= most)


def best_point(df: DataFrame, by: list[str], keys: list[Column]) -> DataFrame:
    """The one row of each group that is largest by the keys, in turn."""
    return df.groupBy(*by).agg(F.max(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.struct(*[c for c in df.columns if c not in by]).alias("row"))).alias("m")).select(*by, "m.row.*")


def systematic(df: DataFrame, x: str, step: int) -> DataFrame:
    """Every step-th row by x, from half a step on."""
    return df.where(F.col(x) % step == step // 2)


def ragged_export(df: DataFrame, metric: str, condition: str, conditions: list[str], value: str, order: list[str]) -> DataFrame:
    """(metric, row, one column for each condition): the values of each condition one below the other."""
    rows = df.withColumn("row", F.row_number().over(W.partitionBy(metric, condition).orderBy(*order)))
    return rows.groupBy(metric, "row").pivot(condition, conditions).agg(F.first(value))


def condition_order(df: DataFrame, animal: str, condition: str) -> DataFrame:
    """(condition, ord): conditions numbered by the first animal that has them; blank ones have no number."""
    firsts = df.where(F.trim(condition) != "").groupBy(condition).agg(F.min(animal).alias("__first"))
    # a row for each condition
    return firsts.select(condition, F.row_number().over(W.orderBy("__first", condition)).alias("ord"))
