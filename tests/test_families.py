"""Families of measures against plain arrays, the plan that unites them, and presets."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabvox.operators import families as M


def _image(seed, height=23, width=19, holes=0.1):
    r = np.random.default_rng(seed)
    a = r.integers(0, 50, (height, width)).astype(float)
    b = np.roll(a, 2, 1) + r.normal(0, 3, a.shape)
    a[r.random(a.shape) < holes] = np.nan
    return a, b


def _table(spark, images):
    rows = [(g, y - 5, x + 3, float(a[y, x]), float(b[y, x])) for g, (a, b) in images.items() for y in range(a.shape[0]) for x in range(a.shape[1]) if np.isfinite(a[y, x])]
    return spark.createDataFrame(rows, "g int, y int, x int, value double, partner double")


def _r(pairs):
    a, b = np.array(pairs).T
    return np.corrcoef(a, b)[0, 1]


def _pairs(a, b, dy, dx):
    h, w = a.shape
    return [(a[y, x], b[y + dy, x + dx]) for y in range(h) for x in range(w) if 0 <= y + dy < h and 0 <= x + dx < w and np.isfinite(a[y, x]) and np.isfinite(b[y + dy, x + dx])]


def test_families_equal_plain_arrays(spark):
    images = {1: _image(1), 2: _image(2, 9, 30, 0.0)}
    keys = ["intensity", "gradient", "granularity", "moran", "glcm", "crosscorr"]
    settings = {"granularity": {"lags": [1, 3]}, "glcm": {"levels": 6, "low": 0.0, "high": 50.0}, "crosscorr": {"reach": 4}}
    got = {r["g"]: r for r in M.measure(_table(spark, images), ["g"], keys, settings, size=8).collect()}
    assert set(got) == set(images)
    for g, (a, b) in images.items():
        r, b = got[g], np.where(np.isfinite(a), b, np.nan)
        v = a[np.isfinite(a)]
        assert np.allclose([r["intensity_n"], r["intensity_mean"], r["intensity_sd"], r["intensity_cv"]], [v.size, v.mean(), v.std(), v.std() / v.mean()])
        for lag in (1, 3):
            assert np.isclose(r[f"granularity_lag{lag}"], _r(_pairs(a, a, 0, lag)))
        near = _pairs(a, a, 0, 1) + _pairs(a, a, 1, 0)
        assert np.isclose(r["moran_i"], v.size / len(near) * sum((p - v.mean()) * (q - v.mean()) for p, q in near) / ((v - v.mean()) ** 2).sum())
        q = np.zeros((6, 6))
        for d in M.DIRECTIONS:
            for s, t in _pairs(a, a, *d):
                i, j = int(s / 50 * 6), int(t / 50 * 6)
                q[i, j] += 1
                q[j, i] += 1
        q /= q.sum()
        i, j = np.indices(q.shape)
        assert np.isclose(r["glcm_contrast"], (q * (i - j) ** 2).sum())
        assert np.isclose(r["glcm_entropy"], -(q[q > 0] * np.log2(q[q > 0])).sum())
        assert np.isclose(r["glcm_correlation"], _r([(s, t) for s in range(6) for t in range(6) for _ in range(round(q[s, t] * 1e4))]), atol=0.02)
        cross = {d: _r(_pairs(a, b, 0, d)) for d in range(-4, 5)}
        assert np.isclose(r["crosscorr_zero"], cross[0])
        assert r["crosscorr_shift"] == max(cross, key=cross.get) == 2
        h, w = a.shape
        grads = [((a[y, x + 1] - a[y, x - 1]) / 2, (a[y + 1, x] - a[y - 1, x]) / 2) for y in range(1, h - 1) for x in range(1, w - 1) if np.isfinite(a[y, x])]
        grads = np.array([p for p in grads if np.isfinite(p).all()])
        t = grads.T @ grads
        low, high = np.linalg.eigvalsh(t)
        assert np.isclose(r["gradient_coherency"], (high - low) / np.trace(t))


@pytest.mark.parametrize("degrees", [0, 30, 75, 120, 165])
def test_lines_have_their_direction(spark, degrees):
    """Stripes whose lines run at an angle, counter-clockwise on the screen."""
    y, x = np.indices((40, 40))
    a = np.radians(degrees)
    across = x * np.sin(a) + y * np.cos(a)
    image = 20 + 10 * np.sin(across * 2 * np.pi / 8)
    r = M.measure(_table(spark, {1: (image, image)}), ["g"], ["anisotropy", "gradient"], size=16).first()
    assert min(abs(r["anisotropy_angle"] - degrees), 180 - abs(r["anisotropy_angle"] - degrees)) < 3
    assert r["anisotropy_coherency"] > 0.9 and r["anisotropy_entropy"] < 0.4
    noise = M.measure(_table(spark, {1: _image(4, 40, 40, 0.0)}), ["g"], ["anisotropy"], size=16).first()
    assert noise["anisotropy_coherency"] < 0.5 and noise["anisotropy_entropy"] > 0.8


def test_tiles_do_not_show(spark):
    t = _table(spark, {1: _image(7, 30, 30)})
    one, many = (M.measure(t, ["g"], ["anisotropy", "moran", "glcm"], size=n).first().asDict() for n in (64, 7))
    assert all(np.isclose(one[k], many[k]) for k in one)


def test_five_families_move_pixels_once(spark):
    t = _table(spark, {1: _image(1)})
    plan = M.measure(t, ["g"], ["intensity", "gradient", "anisotropy", "granularity", "moran", "glcm"])._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert sum("ty" in line for line in moves) == 1
    assert all("ty" in line or "name" in line or "hashpartitioning(g" in line for line in moves) and len(moves) <= 3


def test_odd_groups(spark):
    t = spark.createDataFrame([(None, 0, 0, 1.0, "c"), (1, 0, 0, None, "c"), (2, 0, 0, 4.0, "c"), (2, 0, 1, 4.0, "c")], "g int, y int, x int, value double, name string")
    got = {r["g"]: r for r in M.measure(t, ["g"], ["intensity", "moran", "granularity"]).collect()}
    assert got[1]["intensity_n"] is None and got[1]["moran_i"] is None
    assert got[2]["intensity_sd"] == 0 and got[2]["moran_i"] is None and got[2]["granularity_lag1"] is None
    assert got[None]["intensity_mean"] == 1.0
    assert M.measure(t.where("false"), ["g"], ["glcm", "gradient"]).count() == 0


def test_a_family_of_ones_own(spark):
    try:
        M.register(M.Family("brightest", lambda s: ["share"], lambda s: 0, lambda v, p, s: {"n": int(np.isfinite(v(0, 0)).sum()), "over": int((v(0, 0) > s["cut"]).sum())}, lambda t, s: {"share": t["over"] / t["n"] if t["n"] else None}, {"cut": 40.0}))
        a, b = _image(3)
        got = M.measure(_table(spark, {1: (a, b)}), ["g"], ["brightest"], {"brightest": {"cut": 25.0}}).first()
        assert np.isclose(got["brightest_share"], (a > 25).sum() / np.isfinite(a).sum())
        with pytest.raises(ValueError):
            M.register(M.FAMILIES["brightest"])
    finally:
        M.FAMILIES.pop("brightest", None)


def test_presets(spark, tmp_path):
    made = {"name": "texture", "families": ["glcm", "moran"], "settings": {"glcm": {"levels": 4, "high": 50.0}}}
    (tmp_path / "a.json").write_text(json.dumps(made, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"name": "spread", "families": ["intensity"]}))
    got = M.read_presets(spark, str(tmp_path))
    assert set(got) == {"texture", "spread"}
    t = _table(spark, {1: _image(1)})
    assert got["texture"].measure(t, ["g"]).first() == M.measure(t, ["g"], made["families"], made["settings"]).first()
    for bad in ({"name": "x", "families": ["nothing"]}, {"name": "x", "families": ["glcm"], "settings": {"glcm": {"depth": 1}}}, {"name": "x", "families": [], "more": 1}):
        with pytest.raises(ValueError):
            M.preset_of(json.dumps(bad))
    (tmp_path / "c.json").write_text(json.dumps(made))
    with pytest.raises(ValueError):
        M.read_presets(spark, str(tmp_path))
