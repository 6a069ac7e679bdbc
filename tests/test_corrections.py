"""Ranks with skew, chance correlation, envelopes, depth and sweeps against plain versions on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabvox.functions import names as N
from tabvox.operators import corrections as C
from tabvox.operators import points as P
from tabvox.operators.rank import midrank
from tabvox.sources import results as T


def grid(spark, f, n=20, name="value"):
    return spark.createDataFrame([(1, y, x, float(f(y, x))) for y in range(n) for x in range(n)], f"g int, y int, x int, {name} double")


def test_midrank_of_a_hot_group_with_ties_and_nulls(spark):
    rnd = random.Random(5)
    data = [(i, "hot" if i % 3 else f"k{i % 7}", None if i % 41 == 0 else float(rnd.randrange(60))) for i in range(900)]
    df = spark.createDataFrame(data, "id int, k string, v double").repartition(7)
    got = {r.id: (r["rank"], r.ties) for r in midrank(df, ["k"], "v").collect()}
    key = lambda v: (v is not None, v or 0.0)
    for i, k, v in data:
        same = [w for _, c, w in data if c == k]
        below, ties = sum(key(w) < key(v) for w in same), sum(key(w) == key(v) for w in same)
        assert got[i] == (below + (ties + 1) / 2, ties)


def test_midrank_without_rows(spark):
    assert midrank(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0


def test_identical_channels_correlate_beyond_chance(spark):
    rnd = random.Random(1)
    a = grid(spark, lambda y, x: rnd.random() * 255, name="a")
    got = C.chance_correlation(a.withColumn("b", F.col("a")), ["g"], rounds=100).first()
    assert got.pearson == pytest.approx(1) and got.p == pytest.approx(1 / 101)


def test_constant_channel_has_no_p(spark):
    ab = grid(spark, lambda y, x: y, name="a").withColumn("b", F.lit(3.0))
    assert C.chance_correlation(ab, ["g"], rounds=3).first().p is None


def test_envelope_takes_off_what_contaminants_explain(spark):
    v = grid(spark, lambda y, x: 10 * (y + 1), name="c1").withColumn("target", F.col("c1"))
    out = C.envelope(v, ["g"], ["c1"], dominant=0.0, level=1.0, bins=4, least=1)
    assert out.agg(F.max(F.col("adjusted") - F.col("target"))).first()[0] <= 0
    assert out.where("c1 = 200").agg(F.max("adjusted")).first()[0] == 0


def test_local_ratio_falls_back_to_the_group(spark):
    v = grid(spark, lambda y, x: 100, name="c1").withColumn("target", F.col("c1") / 2)
    for reach, least in ((1, 4), (1, 100)):
        assert [r[0] for r in C.local_ratio(v, ["g"], 1000, 1000, reach, least).select("corrected").distinct().collect()] == [0.0]


def test_rim_is_brighter_than_the_core(spark):
    v = grid(spark, lambda y, x: 150 if min(y, x, 19 - y, 19 - x) < 5 else 25)
    got = C.depth_profile(v, v, ["g"], 1.0, 4.0)
    s = got["summary"].first()
    assert s.rim_core == pytest.approx(6) and s.slope < 0 and s.edge > 0 and s.peak == 0.5
    assert got["bins"].count() == 5


def test_sweep_of_a_ramp(spark):
    s = C.threshold_sweep(grid(spark, lambda y, x: y), ["g"], [0.0, 5.0, 10.0, 30.0]).orderBy("threshold").collect()
    assert [r.area for r in s] == [400, 300, 200, 0]
    assert s[1].iou == pytest.approx((300 / 400 + 200 / 300) / 2) and s[3].iou == 0 and s[3]["mean"] is None


def test_split_of_two_levels(spark):
    q = C.split_quality(grid(spark, lambda y, x: 200 + x % 2 if y > 9 else x % 2), ["g"]).first()
    assert q.foreground == pytest.approx(200.5) and q.background_sd == pytest.approx(0.5) and q.snr == pytest.approx(401)
    assert C.split_quality(grid(spark, lambda y, x: 7), ["g"]).count() == 0


def test_mark_correlation_of_a_shifted_channel(spark):
    a = grid(spark, lambda y, x: 10 if x % 8 == 0 else 0, name="a")
    b = grid(spark, lambda y, x: 10 if x % 8 == 0 else 0, name="b")
    assert C.mark_correlation(a.join(b, ["g", "y", "x"]), ["g"], 3).first().radius == 0


def test_permutation_p_of_far_groups(spark):
    df = spark.createDataFrame([(1, i, "a" if i < 20 else "b", float(i)) for i in range(40)], "m int, id int, c string, v double")
    r = C.permutation_p(df, ["m"], "id", "c", "v", 99).first()
    assert r.observed == pytest.approx(20) and r.p == pytest.approx(0.01)


def test_texture_vector_of_stripes_prefers_their_direction(spark):
    v = grid(spark, lambda y, x: 100 if x % 4 < 2 else 0, 24)
    t = C.texture_vector(v, v.withColumn("label", F.lit(1)), ["g"]).first()
    assert t.gabor0 > 3 * t.gabor2 and all(math.isfinite(t[f"wave{i}"]) for i in range(4))


def test_saved_centroids_assign_as_the_model_does(spark):
    df = spark.createDataFrame([(i, float(i % 3 * 10), float(i % 2)) for i in range(60)], "id int, f0 double, f1 double")
    got, model = P.kmeans(df, ["f0", "f1"], 3)
    again = P.assign(df, P.centroids(model, ["f0", "f1"], spark), ["f0", "f1"])
    assert again.join(got.select("id", F.col("cluster").alias("c")), "id").where("cluster <> c").count() == 0


def test_curve_measures_of_odd_curves(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, []), (3, None), (4, [0.0, 0.0]), (5, [None, 4.0, float("nan")])], "id int, c array<double>")
    got = {r.id: r.m for r in df.select("id", N.curve_measures(F.col("c")).alias("m")).collect()}
    assert got[1].core_edge == pytest.approx(1 / 3) and got[1].peak == pytest.approx(2.5 / 3) and got[1].ring == pytest.approx(2 / 3)
    assert got[2].peak is None and got[4].ring is None and got[4].uniformity is None
    assert got[5].peak == pytest.approx(0.5) and got[5].uniformity == 1


def test_junk_files_and_grammar(spark):
    df = spark.createDataFrame([("a.csv",), (".DS_Store",), ("~$a.xlsx",), (None,), ("mouse-M7_treated",)], "n string")
    assert [r.n for r in df.where(~T.junk_file(F.col("n"))).collect()] == ["a.csv", "mouse-M7_treated"]
    g = df.select(N.grammar(F.col("n"), {"animal": [(r"(M\d+)", 0.5)], "group": [("_(.+)$", 0.4)]}, {"group": ["Treated"]}).alias("g")).collect()
    assert g[4].g.animal.value == "M7" and g[4].g.group.value == "Treated" and g[3].g.animal is None and g[1].g.group is None
