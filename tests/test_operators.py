"""Small fixtures and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from tabvox.functions import names as N
from tabvox.functions.scalar import chi2_sf, finite, morph_predicate, num_or_zero
from tabvox.operators import aggregate as A
from tabvox.operators import joins as J
from tabvox.operators import pixels as K
from tabvox.operators import points as P
from tabvox.operators import spatial as S
from tabvox.sources import tables as T


def test_parse_modes(spark):
    df = spark.createDataFrame([("1.5",), ("",), ("x",), ("NaN",), (None,), ("Infinity",)], "v string")
    assert [r[0] for r in df.select(finite(F.col("v"))).collect()] == [1.5, None, None, None, None, None]
    assert [r[0] for r in df.select(num_or_zero(F.col("v"))).collect()] == [1.5, 0, 0, 0, 0, 0]


def test_placeholders_are_left_out(spark):
    df = spark.createDataFrame([("a", v, 5.0, 1.0, 0.5, 1.0, 1.0, 1.0) for v in (0.0, None, 10.0)], "animal string, volume double, surface double, intden double, mean double, x double, y double, z double")
    r = A.master_objects(df, ["animal"]).first()
    assert (r["count"], r["volume_total"], r["surface_total"]) == (1, 10.0, 5.0)


def test_mode_takes_the_smallest_tie(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 1.0)], "animal string, v double")
    assert A.modal(df, ["animal"], "v").first()["mode"] == 1


def test_five_figures(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 10)], "value double").withColumn("g", F.lit(1))
    r = A.five_figure(df, ["g"]).first()
    assert (r["median"], r["q1"], r["q3"], r["iqr"]) == (5, 3, 7, 4)


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "section int, id int, x double, y double")
    assert S.radius_join(empty, empty, ["section"], 1.0, ["x", "y"]).count() == 0
    assert S.nearest(empty, empty, ["section"], ["x", "y"]).count() == 0
    assert A.gini(empty, ["section"], "x").count() == 0


def test_nearest_without_partner_is_null(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 2, 5.0, 5.0)], "section int, id int, x double, y double")
    b = spark.createDataFrame([(1, 9, 300.0, 400.0)], "section int, id int, x double, y double")
    got = {r["id"]: (r["nearest"], r["distance"]) for r in S.nearest(a, b, ["section"], ["x", "y"]).collect()}
    assert got == {1: (9, 500.0), 2: (None, None)}


def test_boxes(spark):
    cols = "g int, label int, x0 double, x1 double, y0 double, y1 double"
    a, b = spark.createDataFrame([(1, 1, 0.0, 3.0, 0.0, 2.0)], cols), spark.createDataFrame([(1, 2, 2.0, 5.0, 0.0, 2.0)], cols)
    assert S.box_overlap(a, b, ["g"], {"x": 4.0, "y": 4.0}).first()["pct"] == pytest.approx(50.0)


def test_ripley_below_for_grid_above_for_clusters(spark):
    grid = [(1, 4 * i + j, 0.2 * (i + 1), 0.2 * (j + 1)) for i in range(4) for j in range(4)]
    cols = "section int, id int, x double, y double"
    unit = spark.createDataFrame([(1, 16, 0.0, 1.0, 0.0, 1.0, 1.0), (2, 9, 0.0, 1.0, 0.0, 1.0, 1.0)], "section int, n int, x0 double, x1 double, y0 double, y1 double, area double")
    k = P.ripley(spark.createDataFrame(grid, cols), unit.where("section = 1"), ["section"], [0.1]).first()["k"]
    assert k < math.pi * 0.01
    triples = [(2, 3 * i + j, x + 0.005 * j, y + 0.005 * (j % 2)) for i, (x, y) in enumerate([(0.3, 0.3), (0.5, 0.7), (0.7, 0.4)]) for j in range(3)]
    k = P.ripley(spark.createDataFrame(triples, cols), unit.where("section = 2"), ["section"], [0.03]).first()["k"]
    assert k > math.pi * 0.0009


def test_kde_of_one_point(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "section int, x double, y double")
    got = {(r["px"], r["py"]): r["density"] for r in P.kde(p, ["section"], 2, 2, 1.0).collect()}
    for (x, y), d in got.items():
        assert d == pytest.approx(math.exp(-(x * x + y * y) / 2) / (2 * math.pi))
    assert len(got) == 4


def test_uniform_and_checkerboard(spark):
    flat = spark.range(1024).select(F.lit(1).alias("g"), (F.col("id") / 32).cast("int").alias("y"), (F.col("id") % 32).cast("int").alias("x"))
    r = K.patchiness(flat.withColumn("value", F.lit(7.0)), ["g"], [4]).first()
    assert r["cv"] == 0 and r["lacunarity"] == pytest.approx(0)
    board = flat.withColumn("value", ((F.floor(F.col("y") / 4) + F.floor(F.col("x") / 4)) % 2).cast("double"))
    r = K.patchiness(board, ["g"], [4]).first()
    assert r["cv"] > 0.7 and r["lacunarity"] > 0.5


def test_identical_channels(spark):
    ab = spark.range(400).select(F.lit(1).alias("g"), (F.col("id") % 20 + 1.0).alias("a")).withColumn("b", F.col("a"))
    r = K.manders(ab, ["g"], 0.0, 0.0).first()
    assert r["pearson"] == pytest.approx(1) and r["m1"] == 1 and r["m2"] == 1


def test_components_of_a_spiral(spark):
    rows = [(1, 0, x) for x in range(9)] + [(1, y, 8) for y in range(9)] + [(1, 8, x) for x in range(9)] + [(1, y, 0) for y in range(2, 9)] + [(1, 4, 4)]
    got = {(r["y"], r["x"]): r["label"] for r in K.components(spark.createDataFrame(rows, "g int, y int, x int").distinct(), ["g"]).collect()}
    assert len(set(got.values())) == 2 and got[4, 4] == 4 * 2**32 + 4


def test_near_names(spark):
    df = spark.createDataFrame([("Mouse 12",), ("mouse-13",), ("rat 1234567",), ("Mouse12",), (None,), ("",)], "n string")
    got = {(r["a"], r["b"]) for r in J.near_names(df, "n").collect()}
    assert got == {("Mouse 12", "Mouse12"), ("Mouse 12", "mouse-13"), ("Mouse12", "mouse-13")}


def test_append_checks_headers(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "r")], "x int, run_id string")
    assert J.append_tables(a, b).count() == 2
    with pytest.raises(ValueError):
        J.append_tables(a, spark.createDataFrame([(1,)], "y int"))


def test_predicates_and_tails(spark):
    df = spark.createDataFrame([(12.0, 0.5), (9.0, 0.9), (None, 0.9)], "volume double, sph double")
    assert df.where(morph_predicate("volume>=10; unknown<3", {"volume": "volume"})).count() == 1
    r = spark.range(1).select(chi2_sf(F.lit(5.991), 2).alias("a"), chi2_sf(F.lit(3.841), 1).alias("b"), chi2_sf(F.lit(7.815), 3).alias("c")).first()
    assert all(v == pytest.approx(0.05, abs=1e-3) for v in r)


def test_names(spark):
    r = spark.createDataFrame([("E-M1_LH_SCN",), ("odd",), (None,)], "n string").select(N.parse_image_name(F.col("n")).alias("s")).select("s.*").collect()
    assert (r[0]["experiment"], r[0]["animal"], r[0]["hemisphere"], r[0]["region"]) == ("E", "M1", "LH", "SCN")
    assert r[1]["animal"] == "odd" and r[1]["hemisphere"] is None


def test_csv_round_trip(spark, tmp_path):
    p = str(tmp_path / "Ch1.csv")
    with open(p, "w") as f:
        f.write(' Animal Name ,Volume\n"M ""1""\nx",2\n,\nM2,bad\n')
    df = T.typed(T.read_measurements(spark, p), ["Volume"])
    assert [(r[0], r[1]) for r in df.collect()] == [('M "1"\nx', 2.0), ("M2", None)]


def test_roster(spark, tmp_path):
    p = str(tmp_path / "roster.csv")
    with open(p, "w") as f:
        f.write("Animal_ID,Sex,Group\nM1,f,ctrl\nM2,m,\n")
    got = {tuple(r) for r in T.read_roster(spark, p).collect()}
    assert got == {("M1", "Sex", "f"), ("M1", "Group", "ctrl"), ("M2", "Sex", "m")}
