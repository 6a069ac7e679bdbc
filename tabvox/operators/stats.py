"""Hypothesis tests for all metrics at once. Input: (metric, condition, subject, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabvox.functions import dist
from tabvox.functions.scalar import norm_cdf
from tabvox.operators.rank import midrank


def groups(df: DataFrame) -> DataFrame:
    """(metric, condition, n, mean, var) of present values."""
    return df.where(F.col("value").isNotNull()).groupBy("metric", "condition").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))


def eligibility(df: DataFrame, least: int = 3) -> DataFrame:
    """(metric, groups, smallest, reason): reason is null where tests may run."""
    g = groups(df).groupBy("metric").agg(F.count("*").alias("groups"), F.min("n").alias("smallest"))
    return g.withColumn("reason", F.when(F.col("groups") < 2, "fewer than two groups").when(F.col("smallest") < least, f"a group has fewer than {least}"))


def normality(df: DataFrame, least: int = 8, critical: float = 5.991) -> DataFrame:
    """(metric, condition, n, k2, normal): D'Agostino and Pearson's omnibus statistic."""
    m = df.where(F.col("value").isNotNull()).groupBy("metric", "condition").agg(F.count("value").alias("n"), F.avg("value").alias("mu"))
    x = df.join(m, ["metric", "condition"]).groupBy("metric", "condition", "n").agg(*[F.avg(F.pow(F.col("value") - F.col("mu"), k)).alias(f"m{k}") for k in (2, 3, 4)])
    n = F.col("n").cast("double")
    skew, kurt = F.col("m3") / F.pow("m2", 1.5), F.col("m4") / F.pow("m2", 2)
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (b2 - 1))
    alpha = F.sqrt(2 / (w2 - 1))
    zs = F.log(y / alpha + F.sqrt(F.pow(y / alpha, 2) + 1)) / F.sqrt(F.log(F.sqrt(w2)))
    xk = (kurt - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / (F.pow(n + 1, 2) * (n + 3) * (n + 5)))
    sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / sb * (2 / sb + F.sqrt(1 + 4 / (sb * sb)))
    inner = (1 - 2 / a) / (1 + xk * F.sqrt(2 / (a - 4)))
    zk = ((1 - 2 / (9 * a)) - F.signum(inner) * F.pow(F.abs(inner), 1 / 3)) / F.sqrt(2 / (9 * a))
    ok = (n >= least) & (F.col("m2") > 0)
    return x.select("metric", "condition", "n", F.when(ok, zs * zs + zk * zk).alias("k2")).withColumn("normal", F.coalesce(F.col("k2") < critical, F.lit(False)))


def pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each two conditions of a metric, side by side: a_ before b_ in order."""
    a = df.select("metric", *[F.col(c).alias(f"a_{c}") for c in ("condition", *columns)])
    b = df.select("metric", *[F.col(c).alias(f"b_{c}") for c in ("condition", *columns)])
    return a.join(b, "metric").where("a_condition < b_condition")


def welch(df: DataFrame) -> DataFrame:
    """(metric, a_condition, b_condition, t, df, p, difference, low, high): Welch's test of each two groups with a 95 % interval.

    Constant groups: p is 1 if they are equal, else 0; t and df are null.
    """
    g = pairs(groups(df).where("n >= 2"), ["n", "mean", "var"])
    va, vb = F.col("a_var") / F.col("a_n"), F.col("b_var") / F.col("b_n")
    g = g.withColumns({"difference": F.col("b_mean") - F.col("a_mean"), "v": va + vb, "df": F.when(va + vb > 0, F.pow(va + vb, 2) / (va * va / (F.col("a_n") - 1) + vb * vb / (F.col("b_n") - 1)))})
    g = g.withColumn("t", F.when(F.col("v") > 0, -F.col("difference") / F.sqrt("v")))
    p = F.when(F.col("v") > 0, dist.t_p("t", "df")).otherwise(F.when(F.col("difference") == 0, 1.0).otherwise(0.0))
    half = dist.t_975("df") * F.sqrt("v")
    return g.select("metric", "a_condition", "b_condition", "t", "df", p.alias("p"), "difference", (F.col("difference") - half).alias("low"), (F.col("difference") + half).alias("high"))


def anova(df: DataFrame) -> DataFrame:
    """(metric, f, d1, d2, p)."""
    g = groups(df)
    total = g.groupBy("metric").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.count("*").alias("k"), F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ssw"))
    ssb = g.join(total.select("metric", "grand"), "metric").groupBy("metric").agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ssb"))
    out = total.join(ssb, "metric").withColumns({"d1": F.col("k") - 1, "d2": F.col("n") - F.col("k")}).withColumn("f", F.when((F.col("ssw") > 0) & (F.col("d2") > 0), (F.col("ssb") / F.col("d1")) / (F.col("ssw") / F.col("d2"))))
    return out.select("metric", "f", "d1", "d2", dist.f_p("f", "d1", "d2").alias("p"))


def _pair_rows(df: DataFrame) -> DataFrame:
    """Rows of each two conditions: (metric, a_condition, b_condition, side, value)."""
    names = df.select("metric", "condition").distinct()
    two = pairs(names, [])
    side = lambda s: df.join(two, "metric").where(F.col("condition") == F.col(f"{s}_condition")).select("metric", "a_condition", "b_condition", F.lit(s).alias("side"), "value")
    return side("a").union(side("b"))


def mann_whitney(df: DataFrame) -> DataFrame:
    """(metric, a_condition, b_condition, u, z, p): tie-corrected normal approximation without continuity correction."""
    by = ["metric", "a_condition", "b_condition"]
    r = midrank(_pair_rows(df.where(F.col("value").isNotNull())), by, "value")
    g = r.groupBy(*by).agg(F.sum(F.when(F.col("side") == "a", F.col("rank"))).alias("ra"), F.count(F.when(F.col("side") == "a", 1)).alias("na"), F.count(F.when(F.col("side") == "b", 1)).alias("nb"), F.sum(F.pow(F.col("ties"), 2) - 1).alias("tie"))
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    u = F.col("ra") - na * (na + 1) / 2
    n = na + nb
    var = na * nb / 12 * ((n + 1) - F.col("tie") / (n * (n - 1)))
    z = F.when(var > 0, (u - na * nb / 2) / F.sqrt(var)).otherwise(0.0)
    out = g.select(*by, F.least(u, na * nb - u).alias("u"), z.alias("z"))
    return out.withColumn("p", F.least(F.lit(1.0), 2 * (1 - norm_cdf(F.abs("z")))))


def kruskal(df: DataFrame) -> DataFrame:
    """(metric, h, k): tie-corrected; all values equal give 0."""
    r = midrank(df.where(F.col("value").isNotNull()), ["metric"], "value")
    g = r.groupBy("metric", "condition").agg(F.count("*").alias("n"), F.sum("rank").alias("r"), F.sum(F.pow(F.col("ties"), 2) - 1).alias("tie")).groupBy("metric").agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("tie").alias("tie"), F.count("*").alias("k"))
    n = F.col("n").cast("double")
    c = 1 - F.col("tie") / (n * n * n - n)
    return g.select("metric", F.when(c > 0, (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / c).otherwise(0.0).alias("h"), "k")


def differences(df: DataFrame) -> DataFrame:
    """(metric, a_condition, b_condition, subject, d = a - b) of subjects with both values."""
    a = df.where(F.col("value").isNotNull()).select("metric", "subject", F.col("condition").alias("a_condition"), F.col("value").alias("a"))
    b = df.where(F.col("value").isNotNull()).select("metric", "subject", F.col("condition").alias("b_condition"), F.col("value").alias("b"))
    return a.join(b, ["metric", "subject"]).where("a_condition < b_condition").select("metric", "a_condition", "b_condition", "subject", (F.col("a") - F.col("b")).alias("d"))


def paired_t(df: DataFrame) -> DataFrame:
    """(metric, a_condition, b_condition, n, t, p)."""
    g = differences(df).groupBy("metric", "a_condition", "b_condition").agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    g = g.withColumn("t", F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n"))))
    return g.select("metric", "a_condition", "b_condition", "n", "t", dist.t_p("t", (F.col("n") - 1).cast("double")).alias("p"))


def wilcoxon(df: DataFrame, exact_to: int = 25) -> DataFrame:
    """(metric, a_condition, b_condition, n, w, p): Pratt's ranks of zeros; exact up to exact_to nonzero differences, else normal with a correction of one half."""
    by = ["metric", "a_condition", "b_condition"]
    # nine digits, by steps that any engine takes alike; larger values have no tenth
    size = F.when(F.abs("d") < 4e6, F.floor(F.abs("d") * 1e9 + 0.5) / 1e9).otherwise(F.abs("d"))
    r = midrank(differences(df).withColumn("abs", size), by, "abs")
    g = r.groupBy(*by).agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("down"), F.count(F.when(F.col("d") != 0, 1)).alias("n"), F.sum(F.when(F.col("d") != 0, F.col("rank") * F.col("rank")).otherwise(0.0)).alias("rr"))
    # the ranks of groups small enough for the exact distribution, at most exact_to of each
    few = r.where("d <> 0").join(g.where(F.col("n").between(1, exact_to)).select(*by), by, "left_semi").groupBy(*by).agg(F.collect_list((2 * F.col("rank")).cast("int")).alias("twice"))
    g = g.join(few, by, "left").withColumn("w", F.least("up", "down"))
    z = (F.abs(F.col("w") - (F.col("up") + F.col("down")) / 2) - 0.5) / F.sqrt(F.col("rr") / 4)
    normal = F.least(F.lit(1.0), 2 * (1 - norm_cdf(F.greatest(F.lit(0.0), z))))
    return g.select(*by, "n", "w", F.when(F.col("n") == 0, 1.0).when(F.col("n") <= exact_to, dist.wilcoxon_exact_p("w", "twice")).otherwise(normal).alias("p"))


def rm_anova(df: DataFrame) -> DataFrame:
    """(metric, f, d1, d2, p) of balanced repeated measures: subjects present in every condition."""
    from tabvox.operators.joins import complete_cases

    d = complete_cases(df.where(F.col("value").isNotNull()), ["metric"], "subject", "condition")
    w = lambda *c: F.avg("value").over(W.partitionBy("metric", *c))
    x = d.withColumns({"g": w(), "s": w("subject"), "c": w("condition")})
    t = x.groupBy("metric").agg(F.countDistinct("subject").alias("n"), F.countDistinct("condition").alias("k"), F.sum(F.pow(F.col("c") - F.col("g"), 2)).alias("ssc"), F.sum(F.pow(F.col("value") - F.col("s") - F.col("c") + F.col("g"), 2)).alias("sse"))
    t = t.withColumns({"d1": F.col("k") - 1, "d2": (F.col("k") - 1) * (F.col("n") - 1)}).withColumn("f", F.when((F.col("sse") > 0) & (F.col("d2") > 0), (F.col("ssc") / F.col("d1")) / (F.col("sse") / F.col("d2"))))
    return t.select("metric", "f", "d1", "d2", dist.f_p("f", "d1", "d2").alias("p"))


def friedman(df: DataFrame) -> DataFrame:
    """(metric, chi2, k): ranks within subjects present in every condition, tie-corrected."""
    from tabvox.operators.joins import complete_cases

    r = midrank(complete_cases(df.where(F.col("value").isNotNull()), ["metric"], "subject", "condition"), ["metric", "subject"], "value")
    g = r.groupBy("metric", "condition").agg(F.sum("rank").alias("r"), F.count("*").alias("n"), F.sum(F.pow(F.col("ties"), 2) - 1).alias("tie")).groupBy("metric").agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.max("n").cast("double").alias("n"), F.count("*").cast("double").alias("k"), F.sum("tie").alias("tie"))
    n, k = F.col("n"), F.col("k")
    c = 1 - F.col("tie") / (n * k * (k * k - 1))
    return g.select("metric", F.when(c > 0, (12 / (n * k * (k + 1)) * F.col("rr") - 3 * n * (k + 1)) / c).otherwise(0.0).alias("chi2"), k.cast("long").alias("k"))


def bonferroni(df: DataFrame, p: str = "p") -> DataFrame:
    """Add adjusted: p times the number of comparisons of the metric, 1 at most."""
    return df.withColumn("adjusted", F.least(F.lit(1.0), F.col(p) * F.count(p).over(W.partitionBy("metric"))))


def tukey(df: DataFrame) -> DataFrame:
    """(metric, a_condition, b_condition, q, k, df, p) of Tukey and Kramer."""
    g = groups(df)
    t = g.groupBy("metric").agg(F.count("*").alias("k"), (F.sum("n") - F.count("*")).cast("double").alias("df"), (F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))) / (F.sum("n") - F.count("*"))).alias("ms"))
    x = pairs(g, ["n", "mean"]).join(t, "metric")
    q = F.when(F.col("ms") > 0, F.abs(F.col("a_mean") - F.col("b_mean")) / F.sqrt(F.col("ms") / 2 * (1 / F.col("a_n") + 1 / F.col("b_n"))))
    return x.select("metric", "a_condition", "b_condition", q.alias("q"), "k", "df").withColumn("p", dist.tukey_p("q", F.col("k").cast("double"), "df"))


def dunn(df: DataFrame, least: int = 3) -> DataFrame:
    """(metric, a_condition, b_condition, z, adjusted): pooled ranks, Bonferroni over the pairs with `least` values each."""
    r = midrank(df.where(F.col("value").isNotNull()), ["metric"], "value")
    g = r.groupBy("metric", "condition").agg(F.count("*").alias("n"), F.avg("rank").alias("mean"), F.sum(F.pow(F.col("ties"), 2) - 1).alias("tie"))
    t = g.groupBy("metric").agg(F.sum("n").cast("double").alias("total"), F.sum("tie").alias("tie"))
    x = pairs(g.where(F.col("n") >= least), ["n", "mean"]).join(t, "metric")
    n = F.col("total")
    var = (n * (n + 1) / 12 - F.col("tie") / (12 * (n - 1))) * (1 / F.col("a_n") + 1 / F.col("b_n"))
    x = x.withColumn("z", F.when(var > 0, (F.col("a_mean") - F.col("b_mean")) / F.sqrt(var)).otherwise(0.0))
    return bonferroni(x.select("metric", "a_condition", "b_condition", "z", (2 * (1 - norm_cdf(F.abs("z")))).alias("p")))


def route(df: DataFrame, paired: bool = False, assume: str = "auto") -> DataFrame:
    """(metric, test, statistic, p) by the gate: normal groups get t or F tests, others rank tests; skipped metrics keep their reason as test."""
    from tabvox.functions.scalar import chi2_tail

    gate = eligibility(df).join(normality(df).groupBy("metric").agg(F.bool_and("normal").alias("normal")), "metric")
    gate = gate.withColumn("normal", F.lit(assume == "normal") if assume != "auto" else F.col("normal"))
    ok = lambda normal, many: gate.where(F.col("reason").isNull() & (F.col("normal") == normal) & ((F.col("groups") > 2) == many)).select("metric")
    chi = lambda c, k: chi2_tail(F.col(c), F.col(k) - 1)
    two_n, two_s = (paired_t, wilcoxon) if paired else (welch, mann_whitney)
    many_n, many_s, stat = (rm_anova, friedman, "chi2") if paired else (anova, kruskal, "h")
    out = two_n(df).join(ok(True, False), "metric", "left_semi").select("metric", F.lit(two_n.__name__).alias("test"), F.col("t").alias("statistic"), "p")
    out = out.union(two_s(df).join(ok(False, False), "metric", "left_semi").select("metric", F.lit(two_s.__name__), F.col("w" if paired else "u"), "p"))
    out = out.union(many_n(df).join(ok(True, True), "metric", "left_semi").select("metric", F.lit(many_n.__name__), "f", "p"))
    out = out.union(many_s(df).join(ok(False, True), "metric", "left_semi").select("metric", F.lit(many_s.__name__), stat, chi(stat, "k")))
    return out.union(gate.where(F.col("reason").isNotNull()).select("metric", F.concat(F.lit("skipped: "), "reason"), F.lit(None).cast("double"), F.lit(None).cast("double")))
