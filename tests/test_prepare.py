"""Preparation, corrections in order, and silhouettes against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabvox.operators import points as P
from tabvox.operators import prepare as Q
from tabvox.plans.points import FEATURES, _vectors


def test_rename_keeps_new_values(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 3.0, 4.0)], "id int, RawIntDen double, IntDen_Unfiltered double")
    assert sorted(map(tuple, Q.rename_legacy(df).collect())) == [(1, 2.0), (2, 4.0)]
    assert Q.rename_legacy(df.drop("IntDen_Unfiltered")).columns == ["id", "IntDen_Unfiltered"]


def test_prefix_and_slices(spark):
    df = spark.createDataFrame([("A", "v"), ("A", "A_v"), (None, "v"), ("", "v")], "c string, m string")
    assert sorted(r[0] for r in df.select(Q.prefixed(F.col("c"), F.col("m"))).collect()) == ["A_v", "A_v", "v", "v"]
    z = spark.range(1, 6).withColumnRenamed("id", "z")
    assert [r.z for r in Q.z_subset(z, 2, 2).collect()] == [2]
    with pytest.raises(ValueError):
        Q.z_subset(z, 3, 2)


def test_flags_keep_both_comparators(spark):
    df = spark.createDataFrame([(30.0, 30.0), (31.0, 29.0), (None, None)], "v double, b double")
    assert [(r.v_flag, r.b_flag) for r in Q.threshold_flags(df, ["v"], ["b"]).collect()] == [(0, 1), (1, 0), (0, 0)]


def test_unknown_correction(spark):
    with pytest.raises(KeyError):
        Q.correct(spark.range(1), [], [("nothing", {})])


@pytest.mark.parametrize("block", [7, 2000])
def test_silhouette(spark, block):
    rng = random.Random(3)
    rows = [(i, i % 3 if i else 9, rng.gauss(i % 3, 1), rng.gauss(0, 1)) for i in range(60)]
    got = {r["id"]: r["silhouette"] for r in P.silhouette(spark.createDataFrame(rows, "id int, c int, f0 double, f1 double"), "id", "c", ["f0", "f1"], block).collect()}
    for i, c, *p in rows:
        by = {}
        for j, d, *q in rows:
            if i != j:
                by.setdefault(d, []).append(math.dist(p, q))
        mean = {k: sum(v) / len(v) for k, v in by.items()}
        b = min(v for k, v in mean.items() if k != c)
        assert got[i] == pytest.approx((b - mean[c]) / max(mean[c], b) if c in mean else 0.0)
    alone = spark.createDataFrame(rows, "id int, c int, f0 double, f1 double").where("c = 1")
    assert {r["silhouette"] for r in P.silhouette(alone, "id", "c", ["f0", "f1"]).collect()} == {0.0}


def test_vectors_hold_all_elements(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("embedding IS NOT NULL")
    assert e.agg(F.max(F.size("embedding"))).first()[0] == len(FEATURES) == len(_vectors(spark, "/root/testdata/sf0.001").columns) - 2
