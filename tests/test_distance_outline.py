"""Distances, outlines and their measures against brute force."""

import numpy as np
import pytest

from tabvox.operators import distance, outline


def test_lower_envelope():
    r = np.random.default_rng(2)
    for _ in range(200):
        at = np.unique(r.integers(-9, 30, r.integers(1, 15))).astype(float)
        h = r.integers(0, 60, len(at)).astype(float)
        got = distance.lower_envelope(at, h, -12, 33)
        c = np.arange(-12, 34)
        assert np.allclose(got, ((c[:, None] - at) ** 2 + h).min(1))


@pytest.mark.parametrize("axes", [["y", "x"], ["z", "y", "x"]])
def test_distance_equals_nearest(spark, axes):
    r = np.random.default_rng(len(axes))
    mask = [(g, *map(int, p)) for g in (1, 2) for p in r.integers(0, 14, (9, len(axes)))]
    places = [(g, *map(int, p)) for g in (1, 2, 3) for p in r.integers(-4, 20, (150, len(axes)))]
    kind = "g int, " + ", ".join(f"{a} int" for a in axes)
    scale = {"z": 3.0} if "z" in axes else {}
    got = distance.distances(spark.createDataFrame(places, kind), spark.createDataFrame(mask + mask[:3], kind), ["g"], axes, scale).collect()
    assert len(got) == len(places)
    w = np.array([scale.get(a, 1.0) for a in axes])
    for row in got:
        near = [np.sqrt((((np.array(m[1:]) - [row[a] for a in axes]) * w) ** 2).sum()) for m in mask if m[0] == row["g"]]
        assert row["distance"] is None if not near else abs(row["distance"] - min(near)) < 1e-9


def test_shell_measures(spark):
    d = spark.createDataFrame([(1, 0.0, 4.0), (1, 1.9, 6.0), (1, 2.0, 3.0), (1, 7.0, 1.0), (1, None, 9.0), (1, 3.0, None)], "g int, distance double, value double")
    got = distance.shell_measures(d, ["g"], 2.0, shells=3)
    assert {(r["shell"], r["n"], r["mean"]) for r in got["shells"].collect()} == {(0, 2, 5.0), (1, 1, 3.0)}
    row = got["summary"].first()
    assert (row["slope"], row["auc"]) == (-1.0, 16.0)
    assert distance.shell_measures(d.where("false"), ["g"], 2.0)["summary"].count() == 0


def test_outlines_equal_brute_force(spark):
    r = np.random.default_rng(5)
    objects = {}
    for k in range(1, 201):
        n = int(r.integers(1, 40))
        spread = r.integers(1, 12, 2)
        objects[k] = sorted({(int(y), int(x)) for y, x in r.integers(0, spread, (n, 2))})
    rows = [(1, z, y, x, k) for k, ps in objects.items() for y, x in ps for z in (0, 1)]
    df = spark.createDataFrame(rows + [(1, 0, 5, 5, 0)], "g int, z int, y int, x int, label int")
    got = {r["label"]: r for r in outline.outlines(df, ["g"], pixel=0.5).collect()}
    assert set(got) == {k for k, ps in objects.items() if len(ps) >= 3}
    for k, o in got.items():
        p = np.array(objects[k], float)[:, ::-1]
        pair = p[:, None] - p[None]
        assert abs(o["feret"] / 0.5 - np.sqrt((pair**2).sum(-1)).max()) < 1e-9
        # the least width is perpendicular to a side of the hull, so to a line through two pixels
        sides = pair.reshape(-1, 2)
        sides = sides[(sides != 0).any(1)]
        normal = np.stack([-sides[:, 1], sides[:, 0]], 1) / np.linalg.norm(sides, axis=1)[:, None]
        reach = normal @ p.T
        assert abs(o["least_feret"] / 0.5 - (reach.max(1) - reach.min(1)).min()) < 1e-9
        hull = np.array(o["hull"], float)
        for a, b in zip(hull, np.roll(hull, -1, 0), strict=True):  # every pixel lies on the left of every side
            assert len(hull) < 3 or ((b - a)[0] * (p - a)[:, 1] - (b - a)[1] * (p - a)[:, 0] >= 0).all()
        assert {tuple(c) for c in hull} <= {tuple(c) for c in p}
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, np.roll(hull, -1, 0), strict=True))) / 2
        assert abs(o["hull_area"] / 0.25 - max(area, len(p))) < 1e-9 and abs(o["solidity"] - len(p) / max(area, len(p))) < 1e-9


def test_outlines_of_lines_and_nothing(spark):
    df = spark.createDataFrame([(0, 3, x, 7) for x in range(6)] + [(0, i, i, 8) for i in range(4)], "g int, y int, x int, label int")
    got = {r["label"]: r for r in outline.outlines(df, ["g"]).collect()}
    assert (got[7]["feret"], got[7]["least_feret"], got[7]["feret_angle"], got[7]["solidity"]) == (5.0, 0.0, 0.0, 1.0)
    assert abs(got[8]["feret"] - 18**0.5) < 1e-12 and got[8]["feret_angle"] == 45.0
    assert outline.outlines(df.where("false"), ["g"]).count() == 0


def gliding(mask, sides):
    """Plain loops over every box."""
    h, w = mask.shape
    pad = -(-max(h, w) // 4)
    m = np.pad(mask, pad)
    found, lacs = [], []
    for r in sides:
        if r <= max(h, w):
            found.append((r, sum(mask[y : y + r, x : x + r].any() for y in range(0, h, r) for x in range(0, w, r))))
        if r <= min(m.shape):
            mass = np.array([m[y : y + r, x : x + r].sum() for y in range(m.shape[0] - r + 1) for x in range(m.shape[1] - r + 1)], float)
            lacs.append(mass.var() / mass.mean() ** 2 + 1)
    slope = np.polyfit(np.log([r for r, _ in found]), np.log([n for _, n in found]), 1)[0]
    return -slope, np.mean(lacs), np.std(lacs, ddof=1)


def test_fractal_equals_plain_loops(spark):
    r = np.random.default_rng(4)
    masks = {1: r.random((9, 21)) < 0.4, 2: np.ones((40, 33), bool), 3: r.random((50, 12)) < 0.2, 4: np.ones((7, 30), bool)}
    rows = []
    for k, m in masks.items():
        m[0, 0] = m[-1, -1] = m[-1, 0] = True
        rows += [(1, int(y) + 30 * k, int(x) + 11, k) for y, x in np.argwhere(m)]
    df = spark.createDataFrame(rows + rows[:9], "g int, y int, x int, label int")
    from tabvox.operators.fractal import SIDES, fractal

    got = {row["label"]: row for row in fractal(df, ["g"], size=16).collect()}
    assert set(got) == {1, 2, 3}  # the fourth is too low
    for k, row in got.items():
        want = gliding(masks[k], SIDES)
        assert np.allclose((row["dimension"], row["lacunarity"], row["lacunarity_sd"]), want, atol=1e-9)
    assert got[2]["reliable"] and got[2]["dimension"] > 1.6
    assert fractal(df.where("false"), ["g"]).count() == 0
