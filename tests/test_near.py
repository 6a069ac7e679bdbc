"""Neighbours in tiles against brute force; heaps of copies, whose pairs nobody could list."""

import numpy as np
from pyspark.sql import functions as F

from tabvox.operators import near as N
from tabvox.operators import points as P

COLS = "section int, id int, x double, y double"


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(s, int(i), float(x), float(y)) for s in (1, 2) for i, (x, y) in enumerate(np.r_[rng.random((150, 2)) * 10, np.exp(rng.normal(0, 3, (100, 2))), rng.integers(0, 4, (50, 2))])]
    p = spark.createDataFrame([*rows, (1, 900, None, 1.0), (3, 1, 5.0, 5.0)], COLS)
    got = {(r[0], r[1]): (r[2], r[3]) for r in N.nearest(p, p, ["section"], ["x", "y"], exclude_self=True).collect()}
    assert len(got) == 602 and got[1, 900] == got[3, 1] == (None, None)
    for s, i, x, y in rows:
        d, j = min((np.sqrt((x - u) ** 2 + (y - v) ** 2), k) for t, k, u, v in rows if t == s and k != i)
        assert got[s, i] == (j, d)


def test_heap_of_copies(spark):
    # 60 000 rows at one place: 3.6 thousand million pairs
    heap = spark.range(60_000).select(F.lit(1).alias("section"), F.col("id").cast("int"), F.lit(5.0).alias("x"), F.lit(5.0).alias("y"))
    p = heap.union(spark.createDataFrame([(1, 60_000, 0.0, 0.0), (1, 60_001, 10.0, 10.0)], COLS))
    got = P.nn_distance(p, ["section"], 1.0).groupBy("nearest", "distance").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(0, 0.0): 59_999, (1, 0.0): 1, (0, 50**0.5): 2}
    n = 60_000
    assert {r["r"]: r["pairs"] for r in N.pair_counts(p, ["section"], [1.0, 8.0]).collect()} == {1.0: n * (n - 1), 8.0: n * (n - 1) + 4 * n}


def test_pairs_leave_out_repeated_ids(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 1, 0.0, 0.0), (1, 2, 0.0, 1.0), (1, 3, 9.0, 9.0)], COLS)
    assert N.pair_counts(p, ["section"], [1.0]).first()["pairs"] == 4
    assert N.pair_counts(p, ["section"], [2.0]).first()["pairs"] == 6
