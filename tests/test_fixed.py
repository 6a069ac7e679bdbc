"""Nested JSON, tails of any degrees of freedom and thresholds, against plain Python."""

import itertools
import json

import numpy as np
from pyspark.sql import functions as F

from tabvox.functions.names import flatten_json
from tabvox.functions.scalar import chi2_sf, chi2_tail
from tabvox.operators import pixels as K
from tabvox.operators.stats import route


def leaves(v, path=""):
    if isinstance(v, (dict, list)) and v:
        for k, x in v.items() if isinstance(v, dict) else enumerate(v):
            yield from leaves(x, f"{path}[{k}]" if isinstance(v, list) else f"{path}.{k}" if path else k)
    else:
        yield path, json.dumps(v) if isinstance(v, (dict, list)) else None if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def test_flatten_json_keeps_every_leaf(spark):
    texts = [
        '{"a":"[draft] x","b":"{curly","c":{},"n":null,"d":{"e":{"f":{"g":{"h":1}}}}}', '[1,[2,{"k":[]}],"[3]"]', '{"k":{"v":true,"path":[null,{"x":"{}"}]}}', '"plain"', "12", "{}", "[]",
    ]
    df = spark.createDataFrame(list(enumerate(texts)) + [(90, "not { json"), (91, None), (92, "")], "k int, v string")
    got = {}
    for r in flatten_json(df, "k", "v").collect():
        got.setdefault(r["k"], set()).add((r["path"], r["value"]))
    for i, t in enumerate(texts):
        assert got[i] == set(leaves(json.loads(t))), t
    assert (got[90], got[91], got[92]) == ({("", "not { json")}, {("", None)}, {("", "")})
    assert flatten_json(df.where("false"), "k", "v").count() == 0


def test_chi2_tail_for_any_df(spark):
    x = [0.0, 0.5, 3.0, 20.0, 77.7]
    df = spark.createDataFrame([(k, v) for k in range(1, 41) for v in x], "k int, x double")
    got = {(r["k"], r["x"]): r["p"] for r in df.select("k", "x", chi2_tail(F.col("x"), F.col("k")).alias("p")).collect()}
    for k in (1, 2, 3, 6, 11, 12, 40):
        want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(chi2_sf(F.col("x"), k)).collect()]
        assert np.allclose([got[k, v] for v in x], want, atol=1e-9)
    assert abs(got[40, 77.7] - 0.000318) < 5e-5 and abs(got[11, 0.0] - 1) < 1e-8


def test_route_with_many_groups(spark):
    r = np.random.default_rng(0)
    for n in (12, 40):
        rows = [("m", f"s{g}-{i}", f"c{g}", float(r.exponential() ** 3)) for g in range(n) for i in range(6)]
        df = spark.createDataFrame(rows, "metric string, subject string, condition string, value double")
        row = route(df, assume="ranks").first()
        assert row["test"] == "kruskal" and 0 < row["p"] <= 1


def test_costes_equals_plain_bisection(spark):
    r = np.random.default_rng(8)
    rows, want = [], {}
    for g, steps in itertools.product((1, 2), (7, 25)):
        a = np.round(r.gamma(2, 20, 400), 3)
        b = np.round(0.7 * a + r.normal(0, 12, 400) + 5 * g, 3)
        slope, cut = np.polyfit(a, b, 1)
        lo, hi = a.min(), a.max()
        for _ in range(steps):
            t = (lo + hi) / 2
            m = (a < t) | (b < slope * t + cut)
            c = np.corrcoef(a[m], b[m])[0, 1] if m.sum() > 1 else np.nan
            lo, hi = (lo, t) if c > 0.01 else (t, hi)
        want[f"{g}-{steps}"] = (hi, slope * hi + cut)
        rows += [(f"{g}-{steps}", float(x), float(y)) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    for steps in (7, 25):
        got = {x["g"]: (x["ta"], x["tb"]) for x in K.costes(df.where(f"g LIKE '%-{steps}'"), ["g"], steps=steps).collect()}
        assert set(got) == {f"1-{steps}", f"2-{steps}"} and all(np.allclose(got[g], want[g], atol=1e-6) for g in got)
    flat = spark.createDataFrame([("x", 1.0, 1.0), ("x", 1.0, 2.0), ("y", None, 1.0)], "g string, a double, b double")
    assert K.costes(flat, ["g"]).count() == 0


def test_form_of_boxes(spark):
    rows = [(1, z, y, x, 5) for z in range(2) for y in range(4) for x in range(12)] + [(1, 9, 9, 9, 6)]
    got = {r["label"]: r for r in K.form3d(spark.createDataFrame(rows, "g int, z int, y int, x int, label int"), ["g"]).collect()}
    box = got[5]
    assert (box["n"], box["faces"]) == (96, 2 * (8 + 24 + 48))
    # semi-axes of a box of whole steps go as sqrt(side**2 - 1)
    assert np.allclose((box["elongation"], box["flatness"]), (np.sqrt(143 / 15), np.sqrt(15 / 3)))
    d = np.sqrt([(z - 0.5) ** 2 + (y - 1.5) ** 2 + (x - 5.5) ** 2 for _, z, y, x, k in rows if k == 5])
    assert np.allclose((box["centre_least"], box["centre_most"], box["centre_mean"], box["centre_sd"]), (d.min(), d.max(), d.mean(), d.std()))
    assert np.isclose(box["sphericity"] ** 3, box["compactness"]) and got[6]["elongation"] is None and got[6]["centre_most"] == 0


def test_sholl_summary(spark):
    c = spark.createDataFrame([("a", 2.0, 3), ("a", 1.0, 2), ("a", 3.0, 3), ("b", 1.0, 0)], "g string, r double, crossings long")
    assert [tuple(r) for r in K.sholl_summary(c, ["g"]).collect()] == [("a", 3, 2.0, 2, 1.5)]
