"""Roll-ups of object, intensity and curve tables. Inputs hold null for missing numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabvox.functions.scalar import safe_divide


def drop_placeholders(objects: DataFrame, volume: str = "volume", animal: str = "animal") -> DataFrame:
    """Rows of objects that were found: a positive volume and a name that isn't blank."""
    return objects.where((F.col(volume) > 0) & (F.trim(F.col(animal)) != ""))


def master_objects(objects: DataFrame, by: list[str], pixel_size: float = 1.0) -> DataFrame:
    """Counts, totals and means of objects per group; means are over present values."""
    return drop_placeholders(objects).groupBy(*by).agg(
        F.count("*").alias("count"), F.sum("volume").alias("volume_total"), F.sum("surface").alias("surface_total"), F.sum("intden").alias("intden_total"),
        F.avg("volume").alias("volume_mean"), F.avg("mean").alias("mean_mean"), F.avg(safe_divide(F.col("surface"), F.col("volume"))).alias("sa_v_mean"),
        (F.avg("x") * pixel_size).alias("x_mean"), (F.avg("y") * pixel_size).alias("y_mean"), F.avg("z").alias("z_mean"),
    )


def coloc_summary(objects: DataFrame, by: list[str], overlap: str = "overlap", threshold: float = 30.0) -> DataFrame:
    """Mean overlap, how many lie over the threshold, their share and the rest."""
    o = F.col(overlap)
    out = drop_placeholders(objects).groupBy(*by).agg(F.avg(o).alias("overlap_mean"), F.sum(F.when(o > threshold, 1).otherwise(0)).alias("coloc_n"), F.count("*").alias("n"))
    return out.select(*by, "overlap_mean", "coloc_n", (100.0 * F.col("coloc_n") / F.col("n")).alias("coloc_pct"), (F.col("n") - F.col("coloc_n")).alias("non_coloc_n"))


def metric_rule(name: str) -> str:
    """How a column is rolled up, from its name: mode, flag, total or mean."""
    low = name.lower()
    if low in ("cluster", "classlabel") or low.endswith("_classlabel"):
        return "mode"
    if low == "marker" or low.startswith("has") or "coloc" in low:
        return "flag"
    if low.endswith(("count", "_n", "hits")) or "contains" in low:
        return "total"
    return "mean"


def metric_rollup(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, stat, value): each column by its rule, in one pass over the unpivoted table."""
    long = df.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(by, metrics, "metric", "value").where(F.col("value").isNotNull())
    rules = F.create_map(*[F.lit(x) for m in metrics for x in (m, metric_rule(m))])
    stats = long.groupBy(*by, "metric").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.bool_and(F.col("value").isin(0.0, 1.0)).alias("binary"))
    rule = rules[F.col("metric")]
    pair = lambda s, v: F.struct(F.lit(s).alias("stat"), v.alias("value"))
    rows = F.when((rule == "flag") & F.col("binary"), F.array(pair("count", F.col("total")), pair("pct", 100 * F.col("mean")))).when(rule == "total", F.array(pair("total", F.col("total")), pair("mean", F.col("mean")))).when(rule == "mode", F.array()).otherwise(F.array(pair("mean", F.col("mean"))))
    out = stats.select(*by, "metric", F.explode(rows).alias("r")).select(*by, "metric", "r.stat", "r.value")
    modes = [m for m in metrics if metric_rule(m) == "mode"]
    for m in modes:
        out = out.unionByName(modal(df, by, m).select(*by, F.lit(m).alias("metric"), F.lit("mode").alias("stat"), F.col("mode").cast("double").alias("value")))
    return out


def modal(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Most frequent rounded value of each group; the smallest of several."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.round(value).cast("long").alias("v")).agg(F.count("*").alias("n"))
    return counted.groupBy(*by).agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("mode"))


def class_fractions(df: DataFrame, by: list[str], value: str, cap: int = 16) -> DataFrame:
    """(by, class, fraction) of classes 0..cap-1 that occur; labels of cap and more count in the denominator only."""
    v = F.round(value).cast("int")
    valid = df.where(v >= 0).withColumn("class", v)
    w = W.partitionBy(*by)
    return valid.groupBy(*by, "class").agg(F.count("*").alias("n")).withColumn("fraction", F.col("n") / F.sum("n").over(w)).where(F.col("class") < cap).drop("n")


def mean_of_means(df: DataFrame, by: list[str], section: str, value: str) -> DataFrame:
    """Mean over sections of each section's mean."""
    return df.groupBy(*by, section).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.avg("m").alias("value"))


def granularity_sets(df: DataFrame, levels: list[list[str]], aggs: list[Column]) -> DataFrame:
    """One pass over several groupings: columns that a level lacks are null, grouping_id tells levels apart."""
    columns = sorted({c for level in levels for c in level}, key=lambda c: min(level.index(c) for level in levels if c in level))
    sets = [[F.col(c) for c in level] for level in levels]
    return df.groupingSets(sets, *columns).agg(F.grouping_id().alias("level"), *aggs)


def distinct_sections(df: DataFrame, animal: str, keys: list[str]) -> DataFrame:
    """How many sections an animal has: the first of keys that isn't blank names the section."""
    key = F.coalesce(*[F.nullif(F.trim(F.col(k).cast("string")), F.lit("")) for k in keys])
    return df.groupBy(animal).agg(F.countDistinct(key).alias("num_sections"))


def per_mm3(master: DataFrame, volumes: DataFrame, sections: DataFrame, animal: str, metrics: list[str], mode: str = "both") -> DataFrame:
    """Divide summable metrics by number of sections and mean volume; animals without a volume get null.

    mode: raw, normalised or both. volumes and sections have one row for each animal.
    """
    out = master.join(volumes, animal, "left").join(sections, animal, "left")
    made = [safe_divide(safe_divide(F.col(m), F.col("num_sections")), F.col("volume_mm3")).alias(f"{m}_permm3") for m in metrics]
    keep = [c for c in master.columns if mode != "normalised" or c not in metrics]
    return out.select(*keep, *(made if mode != "raw" else []))


def roi_volumes(rois: DataFrame, animal: str) -> DataFrame:
    """Mean volume of each animal's regions: the given one, else area times depth."""
    v = F.coalesce(F.col("volume_mm3"), F.col("area_um2") * F.col("depth_um") / 1e9, F.col("area_px") * F.col("pixel_um") * F.col("pixel_um") * F.col("depth_um") / 1e9)
    return rois.groupBy(animal).agg(F.avg(v).alias("volume_mm3"))


def lineage(df: DataFrame, by: list[str], run: str = "run_id") -> DataFrame:
    """The distinct runs behind each group, sorted, joined by semicolons."""
    return df.groupBy(*by).agg(F.concat_ws(";", F.array_sort(F.collect_set(run))).alias("runs"))


def is_summed(metric: Column) -> Column:
    """Totals and counts are summed over an animal's parts, anything else is averaged."""
    low = F.lower(metric)
    return low.rlike("(total|count)$") & ~low.rlike("permm3|%|fraction|ratio|mean")


def animal_collapse(long: DataFrame, by: list[str], metric: str = "metric", value: str = "value", override: dict[str, str] | None = None) -> DataFrame:
    """Collapse (by, metric) to one value: sum or mean by the metric's name, or by override (SUM, MEAN, AUTO)."""
    summed = is_summed(F.col(metric))
    for name, how in (override or {}).items():
        if how.upper() != "AUTO":
            summed = F.when(F.col(metric) == name, F.lit(how.upper() == "SUM")).otherwise(summed)
    return long.groupBy(*by, metric).agg(F.sum(value).alias("s"), F.avg(value).alias("m")).select(*by, metric, F.when(summed, F.col("s")).otherwise(F.col("m")).alias(value))


def superplot(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """n, mean, sample sd and standard error."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))


def five_figure(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """n, mean, standard error, median, quartiles and their distance, quantiles interpolated."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"), q.alias("q"))
    return out.select(*by, "n", "mean", "sem", F.col("q")[1].alias("median"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def population_summary(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n, mean, sd, min, max)."""
    long = df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], features, "feature", "value")
    return long.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))


def entropy(df: DataFrame, by: list[str], cluster: str) -> DataFrame:
    """Shannon entropy of the clusters in bits; 0 with fewer than two."""
    p = F.col("n") / F.sum("n").over(W.partitionBy(*by))
    return df.where(F.col(cluster).isNotNull()).groupBy(*by, cluster).agg(F.count("*").alias("n")).withColumn("p", p).groupBy(*by).agg(F.abs(F.sum(-F.col("p") * F.log2("p"))).alias("entropy"))


def patterns(df: DataFrame, section: str, hits: list[str]) -> DataFrame:
    """(section, pattern, n, pct): which partners each object hits, as `B + C`, or None."""
    named = F.concat_ws(" + ", F.array_sort(F.array_compact(F.array(*[F.when(F.col(h) > 0, F.lit(h)) for h in hits]))))
    counted = df.select(section, F.when(named == "", "None").otherwise(named).alias("pattern")).groupBy(section, "pattern").agg(F.count("*").alias("n"))
    return counted.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy(section)))


def cluster_profile(df: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"{f}_mean") for f in features])


def curve_summary(df: DataFrame, by: list[str], curve: str) -> DataFrame:
    """(by, bin, n, mean, sem) of curves of equal length, NaN and null left out."""
    long = df.select(*by, F.posexplode(curve).alias("bin", "value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy(*by, "bin").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.stddev_pop("value") / F.sqrt(F.count("value"))).alias("sem"))


def regression(df: DataFrame, by: list[str], y: str, x: str, least: int = 10) -> DataFrame:
    """Slope, intercept and R2 of groups of `least` pairs with some spread in x; else null."""
    ok = (F.regr_count(F.col(y), F.col(x)) >= least) & (F.regr_sxx(F.col(y), F.col(x)) > 1e-10)
    return df.groupBy(*by).agg(F.regr_count(F.col(y), F.col(x)).alias("n"), F.when(ok, F.regr_slope(F.col(y), F.col(x))).alias("slope"), F.when(ok, F.regr_r2(F.col(y), F.col(x))).alias("r2"))


def nearest_rank(df: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """Smallest value whose cumulative count reaches ceil(p n)."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(*by).orderBy(value)
    total = W.partitionBy(*by)
    ranked = counted.withColumns({"upto": F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0)), "n": F.sum("c").over(total)})
    return ranked.where(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n")))).groupBy(*by).agg(F.min(value).alias("value"))


def gini(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Gini coefficient; null with a negative value, 0 if all are zero."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("c").over(w), F.lit(0))
    # sum of ranks of c equal values after `before` smaller ones
    ranks = F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2
    agg = counted.withColumn("r", ranks * F.col(value)).groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col(value)).alias("s"), F.sum("r").alias("r"), F.min(value).alias("least"))
    return agg.select(*by, F.when(F.col("least") < 0, None).when(F.col("s") == 0, 0.0).otherwise(2 * F.col("r") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def least_squares(df: DataFrame, by: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """Coefficients of y = a x1 + b x2 from the Gram sums, in closed form; null if they are dependent."""
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    g = df.groupBy(*by).agg(s(x1, x1).alias("s11"), s(x1, x2).alias("s12"), s(x2, x2).alias("s22"), s(x1, y).alias("t1"), s(x2, y).alias("t2"))
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    return g.select(*by, F.when(F.abs(det) > 1e-9, (F.col("t1") * F.col("s22") - F.col("t2") * F.col("s12")) / det).alias("a"), F.when(F.abs(det) > 1e-9, (F.col("t2") * F.col("s11") - F.col("t1") * F.col("s12")) / det).alias("b"))


def top_share_mean(df: DataFrame, by: list[str], value: str, share: float = 0.01) -> DataFrame:
    """Mean of the brightest share of values, one at least; ties at the border are all in."""
    n = W.partitionBy(*by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    ahead = F.coalesce(F.sum("c").over(n.orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    top = counted.withColumns({"ahead": ahead, "n": F.sum("c").over(n)}).where(F.col("ahead") < F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("n"))))
    return top.groupBy(*by).agg((F.sum(F.col("c") * F.col(value)) / F.sum("c")).alias("top_mean"))


def detections(df: DataFrame, size: str, low: float, high: float, least: dict[str, float]) -> DataFrame:
    """Rows of a size from low to high (high of 0 or less: no bound) whose named columns reach their least values."""
    test = F.col(size) >= low
    test = test & (F.col(size) <= high) if high > 0 else test
    for c, v in least.items():
        test = test & (F.col(c) >= v)
    return df.where(test)


def percent_within(df: DataFrame, by: list[str], classes: list[str]) -> DataFrame:
    """(by, classes, n, pct): counts of classes and their share of the group, windowed over counts only."""
    n = df.groupBy(*by, *classes).agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100 * F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def pair_summary(objects: DataFrame, by: list[str], pairs: dict[tuple[str, str], tuple[str, str]]) -> DataFrame:
    """(by, source, target, objects, coloc, coloc_pct, contains, contains_pct) of the pairs' (flag, count) columns, in one pass."""
    hits = {}
    for i, (flag, held) in enumerate(pairs.values()):
        hits |= {f"c{i}": F.col(flag) == 1, f"h{i}": F.col(held) > 0}
    sums = objects.groupBy(*by).agg(F.count("*").alias("objects"), *[F.sum(F.coalesce(h, F.lit(False)).cast("long")).alias(n) for n, h in hits.items()])
    pct = lambda c: 100 * F.col(c) / F.col("objects")
    rows = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), "objects", F.col(f"c{i}").alias("coloc"), pct(f"c{i}").alias("coloc_pct"), F.col(f"h{i}").alias("contains"), pct(f"h{i}").alias("contains_pct")) for i, (s, t) in enumerate(pairs)])
    return sums.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
