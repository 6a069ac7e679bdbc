"""Boxes in tiles against brute force; heaps whose pairs nobody could list."""

import numpy as np
from pyspark.sql import functions as F

from tabvox.operators import spatial as S

COLS = "section int, label int, x0 double, x1 double, y0 double, y1 double"
SIZE = {"x": 4.0, "y": 4.0}


def boxes(rng, n, first):
    x, y = rng.integers(0, 60, n), rng.integers(-30, 30, n)
    w, h = rng.integers(0, 9, n) * rng.integers(1, 6, n), rng.integers(0, 5, n)
    return [(int(s), first + i, float(a), float(a + u), float(b), float(b + v)) for i, (s, a, u, b, v) in enumerate(zip(rng.integers(1, 3, n), x, w, y, h, strict=True))]


def meet(p, q):
    return max(0.0, min(p[3], q[3]) - max(p[2], q[2]) + 1) * max(0.0, min(p[5], q[5]) - max(p[4], q[4]) + 1)


def test_overlap_and_first_box_against_brute_force(spark):
    rng = np.random.default_rng(4)
    a, b = boxes(rng, 150, 0), boxes(rng, 200, 1000)
    a += [(3, 900, 0.0, 1.0, 0.0, 1.0), (1, 901, None, 1.0, 0.0, 1.0)]
    left, right = spark.createDataFrame(a, COLS), spark.createDataFrame(b, COLS)
    got = {r["label"]: (r["partner"], r["pct"]) for r in S.box_overlap(left, right, ["section"], SIZE).collect()}
    points = left.select("section", "label", F.col("x0").alias("x"), F.col("y0").alias("y"))
    first = {r["label"]: r["box"] for r in S.point_in_box(points, right, ["section"], SIZE).collect()}
    assert len(got) == len(first) == 152
    for p in a[:-1]:
        found = [(-100 * meet(p, q) / meet(p, p), q[1]) for q in b if q[0] == p[0] and meet(p, q) > 0]
        want = min(found, default=(0.0, None))
        assert got[p[1]] == (want[1], -want[0] + 0.0)
        at = (*p[:2], p[2], p[2], p[4], p[4])
        assert first[p[1]] == min((q[1] for q in b if q[0] == p[0] and meet(at, q) > 0), default=None)
    assert got[901] == (None, 0.0) and first[901] is None


def test_heap_of_boxes(spark):
    # 60 000 boxes at one place on both sides: 3.6 thousand million pairs
    heap = spark.range(60_000).select(F.lit(1).alias("section"), F.col("id").cast("int").alias("label"), *[F.lit(v).alias(c) for c, v in (("x0", 5.0), ("x1", 9.0), ("y0", 5.0), ("y1", 6.0))])
    got = S.box_overlap(heap, heap, ["section"], SIZE).groupBy("partner", "pct").count().collect()
    assert [tuple(r) for r in got] == [(0, 100.0, 60_000)]
