"""The spectrum's peak and directions in space against plain arrays and patterns that are known."""

import numpy as np
import pytest

from tabvox.operators.spectrum import peak_wave, spectrum
from tabvox.operators.tensors import anisotropy3d, eigen3


def _pixels(spark, images):
    rows = [(g, y + 7, x - 4, float(a[y, x])) for g, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "g string, y int, x int, value double")


def test_stripes_have_their_wavelength_and_angle(spark):
    images = {}
    for degrees in (0, 40, 90, 150):
        y, x = np.indices((72, 72))
        a = np.radians(degrees)
        images[str(degrees)] = 50 + 20 * np.cos(2 * np.pi * (x * np.sin(a) + y * np.cos(a)) / 12)
    for r in spectrum(_pixels(spark, images), ["g"]).collect():
        # a wave between two frequencies of the image goes to the nearest of the grid
        assert abs(1 / r["wavelength"] - 1 / 12) <= 0.5 * 2**0.5 / 72
        assert int(r["g"]) % 90 or abs(r["wavelength"] - 12) < 1e-6
        assert min(abs(r["angle"] - int(r["g"])), 180 - abs(r["angle"] - int(r["g"]))) < 6
        assert r["stripiness"] > 100 and 0.2 < r["peak"] < 1


def test_spectrum_equals_a_plain_transform(spark):
    r = np.random.default_rng(3)
    images = {"a": r.normal(0, 1, (9, 14)), "b": r.normal(5, 2, (30, 41))}
    images["b"][r.random((30, 41)) < 0.2] = np.nan
    images["b"][0, 0] = images["b"][-1, -1] = 1.0
    got = {x["g"]: x for x in spectrum(_pixels(spark, images), ["g"], scale=(0.5, 0.25)).collect()}
    for g, a in images.items():
        h, w = a.shape
        v = np.nan_to_num(a - np.nanmean(a)) * np.outer(*(0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)) for n in (h, w)))
        y, x = np.indices((h, w))
        waves = {}
        for ky in range(h // 2 + 1):
            for kx in range(-((w - 1) // 2), w // 2 + 1):
                if ky > 0 or kx > 0:
                    waves[ky, kx] = abs((v * np.exp(-2j * np.pi * (ky * y / h + kx * x / w))).sum()) ** 2
        ky, kx = max(waves, key=waves.get)
        assert np.isclose(got[g]["wavelength"], 1 / np.hypot(ky / (h * 0.5), kx / (w * 0.25)))
        assert np.isclose(got[g]["stripiness"], waves[ky, kx] / np.median(list(waves.values())))
        assert np.isclose(got[g]["peak"], waves[ky, kx] / sum(waves.values()))


def test_large_images_are_reduced_to_blocks(spark):
    y, x = np.indices((40, 70))
    image = 9 + np.sin(2 * np.pi * x / 20)
    blocks = image.reshape(20, 2, 70)[:, :, :].mean(1)
    blocks = np.stack([blocks[:, i : i + 4].mean(1) for i in range(0, 70, 4)], 1)
    got = spectrum(_pixels(spark, {"a": image}), ["g"], side=20).first()
    assert np.isclose(got["wavelength"], peak_wave(blocks, (2, 4))["wavelength"]) and abs(got["wavelength"] - 20) < 6


def test_odd_images(spark):
    rows = [(None, y, x, float(x % 2), "c") for y in range(6) for x in range(6)] + [("flat", y, x, 3.0, "c") for y in range(6) for x in range(6)]
    rows += [("small", 0, 0, 1.0, "c"), ("null", 0, 0, None, "c"), ("nan", 0, 0, float("nan"), "c")]
    t = spark.createDataFrame(rows, "g string, y int, x int, value double, wavelength string")
    got = {r["g"]: tuple(r)[1:] for r in spectrum(t, ["g"]).collect()}
    assert got["flat"] == (None, None, 0.0, 0.0)
    assert got["small"] == got["null"] == got["nan"] == (None,) * 4
    assert 2 <= got[None][0] < 3
    assert spectrum(t.where("false"), ["g"]).count() == 0


def test_eigenvectors(spark):
    r = np.random.default_rng(1)
    tensors = [m @ m.T for m in r.normal(0, 1, (20, 3, 3))]
    rows = [(i, *(float(t[a, b]) for a, b in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)))) for i, t in enumerate(tensors)] + [(-1, None, 1.0, 1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "i int, xx double, yy double, zz double, xy double, xz double, yz double")
    for row in df.select("i", eigen3("xx", "yy", "zz", "xy", "xz", "yz").alias("e")).collect():
        if row["i"] < 0:
            assert row["e"]["values"] is None
            continue
        assert row["e"]["values"] == sorted(row["e"]["values"], reverse=True)
        for value, v in zip(row["e"]["values"], (row["e"]["v1"], row["e"]["v2"], row["e"]["v3"]), strict=True):
            assert np.allclose(tensors[row["i"]] @ v, value * np.array(v)) and np.isclose(np.linalg.norm(v), 1)


@pytest.mark.parametrize("scale", [(1.0, 1.0, 1.0), (2.0, 0.5, 0.25)])
def test_directions_in_space(spark, scale):
    r = np.random.default_rng(6)
    z, y, x = np.indices((6, 9, 8))
    wave = 20 + 5 * np.sin(2 * np.pi * (0.5 * x + 0.8 * y + 0.33 * z) / 7)
    images = {"wave": wave, "noise": r.normal(10, 3, wave.shape), "thin": wave[:4]}
    rows = [(g, *map(int, p), float(a[p])) for g, a in images.items() for p in np.ndindex(a.shape) if g != "noise" or r.random() > 0.15]
    kept = {g: np.full(a.shape, np.nan) for g, a in images.items()}
    for g, *p, v in rows:
        kept[g][tuple(p)] = v
    t = spark.createDataFrame(rows + [("noise", 0, 0, 99, None)], "g string, z int, y int, x int, value double")
    got = {q["g"]: q for q in anisotropy3d(t, ["g"], scale).collect()}
    assert got["thin"]["coherency"] is None and got["thin"]["angle"] is None
    for g in ("wave", "noise"):
        a, tensor, bins = kept[g], np.zeros((3, 3)), np.zeros(18)
        at = lambda p: a[p] if all(0 <= i < n for i, n in zip(p, a.shape)) and np.isfinite(a[p]) else None  # noqa: E731, B023
        for p in zip(*np.nonzero(np.isfinite(a))):
            grad = []
            for axis in (2, 1, 0):
                near = [at(tuple(int(q) + s * (i == axis) for i, q in enumerate(p))) for s in (1, -1)]
                known = sum(n is not None for n in near)
                up, down = (a[p] if n is None else n for n in near)
                grad.append((up - down) / (scale[axis] * max(1, known)))
            grad = np.array(grad)
            tensor += np.outer(grad, grad)
            if np.hypot(*grad[:2]) > 1e-9:
                bins[min(17, int(np.mod(np.arctan2(grad[1], grad[0]) + np.pi / 2, np.pi) / np.pi * 18 + 1e-9))] += 1
        values, vectors = np.linalg.eigh(tensor)
        assert np.isclose(got[g]["coherency"], (values[2] - values[1]) / values.sum())
        assert np.isclose(got[g]["angle"], np.degrees(np.mod(np.arctan2(vectors[1, 2], vectors[0, 2]) + np.pi / 2, np.pi)))
        f = bins[bins > 0] / bins.sum()
        assert np.isclose(got[g]["entropy"], -(f * np.log(f)).sum() / np.log(18))
    assert got["wave"]["coherency"] > 0.6 > got["noise"]["coherency"]
    assert anisotropy3d(t.where("false"), ["g"]).count() == 0
