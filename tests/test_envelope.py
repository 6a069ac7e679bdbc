"""Envelopes of random patterns, whose tiles are made and counted by themselves, against whole patterns and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabvox.operators import near as N
from tabvox.operators import points as P

RADII = [0.0, 0.5, 1.0, 4.0]


def brute(q, qe, p, pe, r, same):
    d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(axis=2))
    hit = (np.triu(d <= r, 1) if same else d <= r) * (d <= r)
    return int(((qe[:, None] >= r).astype(int) + (pe[None] >= r))[hit.astype(bool)].sum())


@pytest.mark.parametrize("n,size", [(700, 3), (700, 12), (60, 100), (1, 5)])
def test_even_pairs_against_brute_force(n, size):
    rng = np.random.default_rng(n + size)
    p, q = rng.random((n, 2)) * size, rng.random((n // 2, 2)) * size + (0.7 * size, 0)
    p[: n // 10] = np.round(p[: n // 10])  # distances that equal radii, and copies
    e, qe = np.minimum(p, size - p).min(axis=1), rng.random(len(q)) * size
    for edge in (e, np.full(n, np.inf)):
        assert N.even_pairs(p, edge, p, edge, RADII, n / size**2, chunk=64) == [brute(p, edge, p, edge, r, True) for r in RADII]
        assert N.even_pairs(q, qe, p, edge, RADII, n / size**2, chunk=64) == [brute(q, qe, p, edge, r, False) for r in RADII]


@pytest.mark.parametrize("shape", [(1, 1), (1, 4), (3, 1), (5, 4)])
def test_tiles_add_up_to_the_pattern(shape):
    low, high, n = np.array([-3.0, 10.0]), np.array([17.0, 35.0]), 1500
    tiles = [(i, j) for i in range(shape[0]) for j in range(shape[1])]
    whole = np.concatenate([N.random_tile([1, 2, 3], n, low, high, shape, t) for t in tiles])
    assert len(whole) == n and (whole >= low).all() and (whole <= high).all()
    e = np.minimum(whole - low, high - whole).min(axis=1)
    got = np.sum([N.random_pairs([1, 2, 3], n, low, high, shape, t, RADII) for t in tiles], axis=0)
    assert got.tolist() == [[int((e >= r).sum()) for r in RADII], [brute(whole, e, whole, e, r, True) for r in RADII]]


def windows(spark, n):
    return spark.createDataFrame([(1, n, 0.0, 100.0, 0.0, 100.0, 1e4), (None, n, 0.0, 100.0, 0.0, 100.0, 1e4), (2, 1, 0.0, 1.0, 0.0, 1.0, 1.0), (3, 5, None, None, None, None, None), (4, 5, 0.0, float("inf"), 0.0, 1.0, float("inf"))], "section int, n long, x0 double, x1 double, y0 double, y1 double, area double")


def test_envelope_is_about_the_area_of_the_disc(spark):
    got = {(r["section"], r["r"]): r for r in P.csr_envelope(windows(spark, 3000), ["section"], RADII, simulations=100, rows=1000).collect()}
    assert set(got) == {(s, r) for s in (1, 2, 3, 4) for r in RADII}
    assert all(got[s, r]["k_lower"] is None for s in (2, 3, 4) for r in RADII)
    for r in RADII[1:]:
        disc, k = np.pi * r * r, got[1, r]
        # pairs are about a Poisson number, of n * (n - 1) * disc / area / 2
        wide = 2 * 1.96 * disc / np.sqrt(3000 * 2999 * disc / 1e4 / 2)
        assert k["k_lower"] < disc < k["k_upper"] and 0.6 * wide < k["k_upper"] - k["k_lower"] < 1.9 * wide
        assert k["l_lower"] < 0 < k["l_upper"]


def test_envelope_ships_no_points(spark):
    n = 20_000
    context = spark.sparkContext
    store = context._jsc.sc().statusStore()
    before = {s.stageId() for s in stages(context, store)}
    assert P.csr_envelope(windows(spark, n).where("section = 1"), ["section"], RADII[1:], rows=5000).where(F.col("k_upper") > 0).count() == len(RADII) - 1
    context._jsc.sc().listenerBus().waitUntilEmpty()
    written = sum(s.shuffleWriteRecords() for s in stages(context, store) if s.stageId() not in before)
    assert written < n  # a row a tile and radius; the patterns have 25 * n points


def stages(context, store):
    found = store.stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]
