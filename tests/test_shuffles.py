"""Shuffles of labels without a row for each site and shuffle."""

import numpy as np
from pyspark.sql import functions as F

from tabvox.operators import corrections as C
from tabvox.operators import points as P


def test_interaction_p_of_many_sites_with_few_edges(spark):
    # half of 200 000 sites are a, half b; 30 edges: a shuffle has n or more edges a-a with the binomial's tail
    types = spark.range(200_000).select(F.lit(1).alias("section"), "id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("type"))
    edges = spark.createDataFrame([(1, 2 * k, 1000 + 2 * k) for k in range(12)] + [(1, 2001 + 2 * k, 4000 + 2 * k) for k in range(18)], "section int, a long, b long")
    got = {(r["t"], r["u"]): (r["n"], r["p"]) for r in P.interaction_p(edges, types, ["section"]).collect()}
    rng = np.random.default_rng(3)
    for (t, u), share in ((("a", "a"), 0.25), (("a", "b"), 0.5)):
        n, p = got[t, u]
        assert n == {"aa": 12, "ab": 18}[t + u]
        assert abs(p - (rng.binomial(30, share, 100_000) >= n).mean()) < 0.05


def test_permutation_p_is_uniform_in_stretches(spark):
    rng = np.random.default_rng(2)
    rows = [(f"m{m}", i, "abc"[i % 3], float(v)) for m in range(30) for i, v in enumerate(rng.normal(size=60))]
    df = spark.createDataFrame(rows, "m string, id int, c string, v double")
    p = [r["p"] for r in C.permutation_p(df, ["m"], "id", "c", "v", 99, rows=7).collect()]
    assert len(p) == 30 and 0.3 < np.mean(p) < 0.7
