"""The forward model against a dense solve, and sums over windows of tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabvox.operators import tiles
from tabvox.operators.forward import forward_model


def plane(n=40, seed=3):
    r = np.random.default_rng(seed)
    a1, a2 = r.integers(50, 400, (n, n)), r.integers(20, 300, (n, n))
    s1 = np.where(r.random((n, n)) < 0.2, r.integers(800, 3000, (n, n)), r.integers(0, 60, (n, n))) + (0.4 * a1 + 0.1 * a2).astype(int)
    s2 = np.where(r.random((n, n)) < 0.2, r.integers(600, 2000, (n, n)), r.integers(0, 40, (n, n))) + (0.2 * a2).astype(int)
    signal = np.where(r.random((n, n)) < 0.1, 5000, 0)
    t = (0.5 * a1 + 0.3 * a2 + 0.08 * s1 + 0.05 * s2 + signal + r.integers(0, 5, (n, n))).astype(int)
    t[3, 4] = 65535
    return t, a1, a2, s1, s2


def percentile(x, p):
    x = np.sort(x.ravel())
    return x[max(1, int(np.ceil(p * len(x)))) - 1]


def clamp(x):
    return np.floor(np.clip(x, 0, 65535) + 0.5)


def dense(t, autos, sources, reach, least, quiet, bright, rounds=1):
    t, autos, sources = t.astype(float), [a.astype(float) for a in autos], [s.astype(float) for s in sources]
    free = np.max([t, *autos, *sources], 0) < 65535
    lit = np.max(autos, 0) > 0

    def lsq(y, xs, m):
        k = np.linalg.lstsq(np.stack([x[m] for x in xs], 1), y[m], rcond=None)[0]
        return np.maximum(0, k)

    pure = []
    for s in sources:
        k = lsq(s, autos, free & (s <= percentile(s, quiet)) & lit)
        pure.append(clamp(s - sum(c * a for c, a in zip(k, autos))))
    q, bleed = free & (t <= percentile(t, quiet)), None
    for _ in range(rounds):
        rest = t if bleed is None else np.maximum(0, t - sum(b * p for b, p in zip(bleed, pure)))
        whole = lsq(rest, autos, q & lit)
        first = np.zeros_like(t)
        for y in range(t.shape[0]):
            for x in range(t.shape[1]):
                w = np.zeros_like(q)
                w[max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1] = True
                w &= q
                k = lsq(rest, autos, w) if w.sum() >= max(3, least) else whole
                first[y, x] = t[y, x] - sum(c * a[y, x] for c, a in zip(k, autos))
        first = clamp(first)
        pool = free & (first <= percentile(first, quiet)) & np.any([p >= percentile(p, bright) for p in pure], 0) & (np.max(pure, 0) > 0)
        bleed = lsq(first, pure, pool)
    return clamp(first - sum(b * p for b, p in zip(bleed, pure))), bleed


@pytest.mark.parametrize("rounds", [1, 3])
def test_equals_dense_solve(spark, rounds):
    t, *rest = plane()
    rows = [(1, y, x, *map(int, (t[y, x], *(c[y, x] for c in rest)))) for y in range(40) for x in range(40)]
    v = spark.createDataFrame(rows, "g int, y int, x int, t int, a1 int, a2 int, s1 int, s2 int")
    got = forward_model(v, ["g"], "t", ["a1", "a2"], ["s1", "s2"], reach=4, least_local=12, least_bleed=10, rounds=rounds, tolerance=0.0).collect()
    want, bleed = dense(t, rest[:2], rest[2:], 4, 12, 0.5, 0.9, rounds)
    assert len(got) == 1600
    assert np.allclose([got[0]["bleed_1"], got[0]["bleed_2"]], bleed, atol=1e-6)
    assert sum(abs(r["corrected"] - want[r["y"], r["x"]]) > 1 for r in got) == 0  # a half may be rounded either way
    assert sum(r["corrected"] != want[r["y"], r["x"]] for r in got) <= 8


def test_odd_planes(spark):
    v = spark.createDataFrame([], "g int, y int, x int, t int, a int, s int")
    assert forward_model(v, ["g"], "t", ["a"], ["s"]).count() == 0
    # without autos nothing is taken off; a plane of one pixel is explained by its autos
    v = spark.createDataFrame([(1, 0, 0, 10, 0, 0), (1, 0, 1, None, None, 5), (2, 0, 0, 7, 3, 2)], "g int, y int, x int, t int, a int, s int")
    got = {(r["g"], r["x"]): r["corrected"] for r in forward_model(v, ["g"], "t", ["a"], ["s"], reach=1).collect()}
    assert got == {(1, 0): 10.0, (1, 1): 0.0, (2, 0): 0.0}
    with pytest.raises(ValueError):
        forward_model(v, ["g"], "t", [], ["s"])


def test_windows_across_tiles(spark):
    r = np.random.default_rng(1)
    places = [(int(y), int(x)) for y, x in {(*p,) for p in r.integers(-20, 45, (900, 2)).tolist()}]
    df = spark.createDataFrame([(0, y, x, float((y * 7 + x * 3) % 11)) for y, x in places], "g int, y int, x int, v double")
    got = tiles.tiled(df, ["g"], ["v"], 3, lambda a: {"s": tiles.box_sums(np.nan_to_num(a["v"]), 3)}, ["s"], size=16)
    value = {(y, x): (y * 7 + x * 3) % 11 for y, x in places}
    want = {p: sum(value.get((p[0] + i, p[1] + j), 0) for i in range(-3, 4) for j in range(-3, 4)) for p in places}
    assert {(r["y"], r["x"]): round(r["s"], 6) for r in got.collect()} == want
    assert df.count() == got.count() and [f.dataType for f in got.schema][:3] == [f.dataType for f in df.schema][:3]
