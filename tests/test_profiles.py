"""Profiles of objects against loops over their voxels."""

import numpy as np
import pytest

from tabvox.operators.profiles import Profile, profiles


def _tables(spark, lab, images):
    places = list(np.ndindex(lab.shape))
    labels = [(1, *map(int, p), int(lab[p])) for p in places if lab[p] or sum(p) % 2]
    voxels = [(1, c, *map(int, p), float(a[p]), "k") for c, a in images.items() for p in places if np.isfinite(a[p])]
    return spark.createDataFrame(labels, "g int, z int, y int, x int, label int"), spark.createDataFrame(voxels, "g int, channel string, z int, y int, x int, value double, label string")


def _plain(lab, images, label, source, how, scale):
    own = np.argwhere(lab == label)[:, ::-1].astype(float)  # x, y, z
    s, c = np.array(scale), own.mean(0)
    top = np.array(lab.shape[::-1]) - 1
    lo, hi = own.min(0), own.max(0)
    grow = np.floor(how.pad / 100 * (hi - lo + 1) + 0.5)
    lo, hi = np.maximum(0, lo - grow), np.minimum(top, hi + grow)
    corners = (np.array(np.meshgrid(*zip(lo, hi, strict=True))).reshape(3, -1).T - c) * s
    far = np.sqrt((corners**2).sum(1)).max() or 1.0
    m = (own - c) * s
    values, vectors = np.linalg.eigh(m.T @ m / len(m))
    e = vectors[:, ::-1].T
    e = np.array([-v if v[np.argmax(np.abs(v) > 1e-9)] < 0 else v for v in e])
    half = np.maximum(1e-9, np.abs(corners @ e.T).max(0))
    bins = how.bins()
    curves, totals, skew = {}, {}, np.zeros(3)
    for channel, image in images.items():
        got = {n: [[] for _ in range(k)] for n, k in bins.items()}
        rows = []
        for p in np.ndindex(lab.shape):
            q = np.array(p[::-1], float)
            if not np.isfinite(image[p]) or (lab[p] != label if how.region == "object" else (q < lo).any() or (q > hi).any()):
                continue
            d, v = (q - c) * s, image[p]
            pr = e @ d
            t = {"radial": np.linalg.norm(d) / far, "angular": np.mod(np.arctan2(d[1], d[0]) / (2 * np.pi), 1)}
            t["shell"] = t["radial"]
            for i, a in enumerate("xyz"):
                o = q[i] - c[i]
                t[a] = (1 + o / max(1e-9, c[i] - lo[i] if o < 0 else hi[i] - c[i])) / 2
            for k in (1, 2, 3):
                t[f"axis{k}"] = (1 + pr[k - 1] / half[k - 1]) / 2
            for n, k in bins.items():
                got[n][int(min(k - 1, max(0, np.floor(round(t[n] * k, 9)))))].append(v)
            rows.append((v, images[source][p], d, pr))
        curves[channel], totals[channel] = got, rows
        if channel == source:
            skew = sum(v * pr for v, _, _, pr in rows)
    return curves, totals, skew, far, half, values[::-1]


@pytest.mark.parametrize("how", [Profile(radial=7, angular=5, axis=9, pad=30.0), Profile(region="object", radial=6, angular=4, axis=5, normal="z"), Profile(normal="mean", axis=4)])
def test_profiles_equal_loops(spark, how):
    r = np.random.default_rng(8)
    lab = np.zeros((5, 14, 13), int)
    lab[1:4, 2:6, 1:9] = 1
    lab[0:5, 7:13, 6:9] = 2
    lab[(r.random(lab.shape) < 0.25) & (lab > 0)] = 0
    lab[2, 11, 1] = 3
    images = {"A": r.integers(1, 30, lab.shape).astype(float), "B": r.normal(5, 4, lab.shape)}
    images["A"][r.random(lab.shape) < 0.1] = np.nan
    scale = (0.5, 0.5, 1.5)
    labels, voxels = _tables(spark, lab, images)
    got = profiles(labels, voxels, ["g"], "A", how, scale, size=4)
    curves = {(x["label"], x["channel"], x["profile"], x["bin"]): x for x in got["curves"].collect()}
    summary = {(x["label"], x["channel"]): x for x in got["summary"].collect()}
    seen = 0
    for label in (1, 2, 3):
        per, totals, skew, far, half, values = _plain(lab, images, label, "A", how, scale)
        for channel in images:
            rows = totals[channel]
            if not rows:
                continue
            v = np.array([x[0] for x in rows])
            # a single voxel has no axes of its own
            for name, k in how.bins().items():
                if label == 3 and name.startswith("axis"):
                    continue
                back = name.startswith("axis") and skew[int(name[4]) - 1] < 0
                for i, inside in enumerate(per[channel][name]):
                    x = curves.get((label, channel, name, k - 1 - i if back else i))
                    if not inside:
                        assert x is None
                        continue
                    seen += 1
                    mean = np.mean(inside)
                    norm = {"range": (mean - v.min()) / (v.max() - v.min()) if v.max() > v.min() else 0, "mean": mean / v.mean(), "z": (mean - v.mean()) / v.std() if v.std() > 0 else 0}[how.normal]
                    assert x["n"] == len(inside) and np.isclose(x["mean"], mean) and np.isclose(x["normed"], norm, atol=1e-6)
            x = summary[label, channel]
            if v.sum() > 0:
                pull = sum(q[0] * q[2] for q in rows) / v.sum()
                assert np.isclose(x["polarity"], np.linalg.norm(pull) / far)
                if label != 3:
                    along = sum(q[0] * q[3][0] for q in rows) / v.sum() / half[0]
                    assert np.isclose(x["axis_polarity"], -along if skew[0] < 0 else along)
                    assert np.isclose(x["elongation"], np.sqrt(values[0] / values[1])) and np.isclose(x["flatness"], np.sqrt(values[1] / values[2]))
            both = np.array([(q[0], q[1]) for q in rows if np.isfinite(q[1])])
            if len(both) > 2:
                assert np.isclose(x["pearson"], np.corrcoef(both.T)[0, 1])
                assert np.isclose(x["manders"], (both[:, 0] * both[:, 1]).sum() / np.sqrt((both**2).sum(0).prod()))
            means = [np.mean(b) for b in per[channel]["radial"] if b]
            assert np.isclose(x["peak"], ([i for i, b in enumerate(per[channel]["radial"]) if b][int(np.argmax(means))] + 0.5) / how.radial)
            angles = [np.mean(b) for b in per[channel]["angular"] if b]
            if max(angles) > 0:
                assert np.isclose(x["ring"], sum(m >= max(angles) / 2 for m in angles) / how.angular)
    assert seen > 150


def test_odd_tables(spark):
    labels, voxels = _tables(spark, np.ones((1, 2, 2), int), {"A": np.full((1, 2, 2), np.nan), "B": np.full((1, 2, 2), 2.0)})
    got = profiles(labels, voxels, ["g"], "A")
    x = got["summary"].collect()
    assert len(x) == 1 and x[0]["pearson"] is None and x[0]["uniformity"] == 1.0
    assert {q["normed"] for q in got["curves"].collect()} == {0.0}
    assert profiles(labels.where("false"), voxels, ["g"], "A")["summary"].count() == 0
    with pytest.raises(ValueError):
        Profile(region="ball")
