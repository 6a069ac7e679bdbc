"""Families of measures on pixels: each declares what it reads around a pixel; one plan serves all that are asked.

A family gives sums over the pixels of a tile and, from the totals of a group, its columns. `measure`
takes the widest reach of the families asked for, sends each pixel once to the tiles that it lies in or
borders on, and lets every family sum there: however many families, pixels move once, and what moves
afterwards are sums.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvox.operators.tiles import tile_sums

Settings = dict


class Around:
    """A tile's values and those around them, NaN where there is no pixel."""

    def __init__(self, whole: np.ndarray, reach: int):
        self.whole, self.reach = whole, reach

    def __call__(self, dy: int, dx: int, border: int = 0) -> np.ndarray:
        """The values that far below and to the right of the tile with so wide a border."""
        r = self.reach - border
        return self.whole[r + dy : self.whole.shape[0] - r + dy, r + dx : self.whole.shape[1] - r + dx]


@dataclass(frozen=True)
class Family:
    """key; settings with their defaults; columns, reach, sums and finish as functions of the settings.

    partner: whether sums also reads the column `partner`, another channel at the same places.
    """

    key: str
    columns: Callable[[Settings], list[str]]
    reach: Callable[[Settings], int]
    sums: Callable[[Around, Around | None, Settings], dict[str, float]]
    finish: Callable[[dict[str, float], Settings], dict[str, float]]
    settings: Settings = field(default_factory=dict)
    partner: bool = False


FAMILIES: dict[str, Family] = {}


def register(family: Family) -> Family:
    """Make a family known by its key, which must be new."""
    if family.key in FAMILIES:
        raise ValueError(f"a family {family.key} exists")
    FAMILIES[family.key] = family
    return family


def chosen(families: list[str], settings: dict[str, Settings] | None = None) -> list[tuple[Family, Settings]]:
    """The families of the keys with their settings; unknown keys and settings are errors."""
    settings = settings or {}
    if unknown := (set(families) | set(settings)) - set(FAMILIES):
        raise ValueError(f"unknown families: {sorted(unknown)}")
    out = []
    for key in dict.fromkeys(families):
        family, own = FAMILIES[key], settings.get(key, {})
        if unknown := set(own) - set(family.settings):
            raise ValueError(f"unknown settings of {key}: {sorted(unknown)}")
        out.append((family, {**family.settings, **own}))
    return out


def measure(pixels: DataFrame, by: list[str], families: list[str], settings: dict[str, Settings] | None = None, size: int = 256) -> DataFrame:
    """(by, <key>_<column>...) of each group of pixels (by, y, x, value; partner if a family needs it).

    y and x are whole numbers, and a place occurs once in its group. A null or missing pixel isn't counted, nor
    are pairs with one. What a group has too little of is null.
    """
    asked = chosen(families, settings)
    names = [(f"{f.key}_{c}", f.key, c) for f, s in asked for c in f.columns(s)]
    reach = max((f.reach(s) for f, s in asked), default=0)
    values = ["value", *(["partner"] if any(f.partner for f, _ in asked) else [])]

    def run(arrays):
        value, partner = (Around(arrays[name], reach) if name in arrays else None for name in ("value", "partner"))
        return {f"{f.key}.{k}": float(x) for f, s in asked for k, x in f.sums(value, partner, s).items()}

    totals = tile_sums(pixels, by, values, reach, run, size)

    def close(pdf):
        got: dict[str, dict[str, float]] = {f.key: defaultdict(float) for f, _ in asked}
        for name, total in zip(pdf["name"], pdf["total"], strict=True):
            key, _, part = name.partition(".")
            if key:
                got[key][part] = total
        row = {c: pdf[c].iloc[0] for c in by}
        done = {f.key: f.finish(got[f.key], s) for f, s in asked}
        for column, key, c in names:
            x = done[key].get(c)
            row[column] = float(x) if x is not None and np.isfinite(x) else None
        return pd.DataFrame([row], columns=[*by, *[n for n, *_ in names]])

    schema = T.StructType([*[pixels.schema[c] for c in by], *[T.StructField(n, T.DoubleType()) for n, *_ in names]])
    return totals.groupBy(*by).applyInPandas(close, schema)


# -- sums that several families use --


def _pairs(a: np.ndarray, b: np.ndarray, name: str) -> dict[str, float]:
    """Sums over the places where both are there."""
    both = np.isfinite(a) & np.isfinite(b)
    a, b = a[both], b[both]
    return {f"{name}n": len(a), f"{name}a": a.sum(), f"{name}b": b.sum(), f"{name}aa": a @ a, f"{name}bb": b @ b, f"{name}ab": a @ b}


def _pearson(t: dict[str, float], name: str) -> float | None:
    n = t.get(f"{name}n", 0)
    if n < 2:
        return None
    a, b = t[f"{name}a"] / n, t[f"{name}b"] / n
    va, vb = t[f"{name}aa"] / n - a * a, t[f"{name}bb"] / n - b * b
    return (t[f"{name}ab"] / n - a * b) / np.sqrt(va * vb) if va > 1e-12 * abs(t[f"{name}aa"] / n) and vb > 1e-12 * abs(t[f"{name}bb"] / n) else None


# -- the families --


def _spread(t, s):
    n = t.get("n", 0)
    if not n:
        return {}
    mean = t["a"] / n
    sd = np.sqrt(max(0.0, t["aa"] / n - mean * mean))
    return {"n": n, "mean": mean, "sd": sd, "cv": sd / mean if mean else None}


register(Family("intensity", lambda s: ["n", "mean", "sd", "cv"], lambda s: 0, lambda v, p, s: _pairs(v(0, 0), v(0, 0), ""), _spread))


def _gradients(v, p, s):
    gx, gy = (v(0, 1) - v(0, -1)) / 2, (v(1, 0) - v(-1, 0)) / 2
    there = np.isfinite(gx) & np.isfinite(gy) & np.isfinite(v(0, 0))
    gx, gy = gx[there], gy[there]
    steep = np.hypot(gx, gy) > s["least"]
    angle = np.mod(np.arctan2(gy[steep], gx[steep]) + np.pi / 2, np.pi)
    bins = np.bincount(np.minimum(s["bins"] - 1, np.floor(angle / np.pi * s["bins"] + 1e-9)).astype(int), minlength=s["bins"])
    return {"xx": gx @ gx, "yy": gy @ gy, "xy": gx @ gy, **{f"h{i}": c for i, c in enumerate(bins)}}


def _orientation(t, s):
    trace = t.get("xx", 0.0) + t.get("yy", 0.0)
    if trace <= 0:
        return {}
    root = np.hypot(t["xx"] - t["yy"], 2 * t["xy"])
    h = np.array([t.get(f"h{i}", 0.0) for i in range(s["bins"])])
    share = h[h > 0] / h.sum() if h.sum() else h[:0]
    # the structure runs across the gradient
    angle = np.degrees(np.mod(np.arctan2(2 * t["xy"], t["xx"] - t["yy"]) / 2 + np.pi / 2, np.pi))
    return {"coherency": root / trace, "angle": angle, "entropy": float(-(share * np.log(share)).sum() / np.log(s["bins"])) if len(share) else None}


register(Family("gradient", lambda s: ["coherency", "angle", "entropy"], lambda s: 1, _gradients, _orientation, {"bins": 18, "least": 1e-12}))



def _smoothed(a: np.ndarray, sigma: float, reach: int) -> np.ndarray:
    """Gaussian means of a over the places that are there, without the border of that reach."""
    w = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))

    def along(x, axis):
        n = x.shape[axis] - 2 * reach
        return sum(k * np.take(x, range(i, i + n), axis) for i, k in enumerate(w))

    there = np.isfinite(a)
    weight = along(along(there.astype(float), 0), 1)
    total = along(along(np.where(there, a, 0.0), 0), 1)
    return np.divide(total, weight, out=np.full_like(total, np.nan), where=weight > 0)


def _tensors(v, p, s):
    r = math.ceil(3 * s["sigma"])
    gx, gy = (v(0, 1, r) - v(0, -1, r)) / 2, (v(1, 0, r) - v(-1, 0, r)) / 2
    gone = ~(np.isfinite(gx) & np.isfinite(gy))
    xx, yy, xy = (_smoothed(np.where(gone, np.nan, g), s["sigma"], r) for g in (gx * gx, gy * gy, gx * gy))
    here = v(0, 0)
    steep = np.isfinite(here) & (xx + yy > s["least"])
    xx, yy, xy, weight = xx[steep], yy[steep], xy[steep], np.maximum(0.0, here[steep])
    twice = np.arctan2(2 * xy, yy - xx)
    angle = np.mod(twice / 2, np.pi)
    bins = np.bincount(np.minimum(s["bins"] - 1, np.floor(angle / np.pi * s["bins"] + 1e-9)).astype(int), minlength=s["bins"])
    return {
        "n": len(xx), "coherency": (np.hypot(xx - yy, 2 * xy) / (xx + yy)).sum(), "weight": weight.sum(),
        "sin": (weight * np.sin(twice)).sum(), "cos": (weight * np.cos(twice)).sum(), "sin1": np.sin(twice).sum(), "cos1": np.cos(twice).sum(),
        **{f"h{i}": c for i, c in enumerate(bins)},
    }


def _directions(t, s):
    if not t["n"]:
        return {}
    one = "" if t["weight"] > 0 else "1"
    share = np.array([t[f"h{i}"] for i in range(s["bins"])]) / t["n"]
    share = share[share > 0]
    angle = np.degrees(np.mod(np.arctan2(t[f"sin{one}"], t[f"cos{one}"]) / 2, np.pi))
    return {"coherency": t["coherency"] / t["n"], "angle": angle, "entropy": float(-(share * np.log(share)).sum() / np.log(s["bins"]))}


# tensors smoothed around each pixel: their mean coherency, the direction of lines weighted by intensity
# (counter-clockwise, as rows run down) and the entropy of directions
register(Family("anisotropy", lambda s: ["coherency", "angle", "entropy"], lambda s: math.ceil(3 * s["sigma"]) + 1, _tensors, _directions, {"sigma": 2.0, "bins": 18, "least": 1e-12}))


register(
    Family(
        "granularity",
        lambda s: [f"lag{k}" for k in s["lags"]],
        lambda s: max(s["lags"], default=0),
        lambda v, p, s: {k: x for lag in s["lags"] for k, x in _pairs(v(0, 0), v(0, lag), f"{lag}.").items()},
        lambda t, s: {f"lag{k}": _pearson(t, f"{k}.") for k in s["lags"]},
        {"lags": [1, 2, 4, 8]},
    )
)


def _contiguous(v, p, s):
    one = _pairs(v(0, 0), v(0, 0), "")
    right, below = _pairs(v(0, 0), v(0, 1), ""), _pairs(v(0, 0), v(1, 0), "")
    return {"n": one["n"], "a": one["a"], "aa": one["aa"], **{f"w{k}": right[k] + below[k] for k in ("n", "a", "b", "ab")}}


def _moran(t, s):
    n = t.get("n", 0)
    if not n or not t["wn"]:
        return {}
    mean = t["a"] / n
    spread = t["aa"] - n * mean * mean
    cross = t["wab"] - mean * (t["wa"] + t["wb"]) + mean * mean * t["wn"]
    return {"i": n / t["wn"] * cross / spread if spread > 1e-12 * abs(t["aa"]) else None}


register(Family("moran", lambda s: ["i"], lambda s: 1, _contiguous, _moran))

#: Directions of co-occurrence: right, below, and the two diagonals.
DIRECTIONS = [(0, 1), (1, 0), (1, 1), (1, -1)]


def _cooccurrence(v, p, s):
    n = s["levels"]
    level = lambda a: np.clip(np.floor((a - s["low"]) / (s["high"] - s["low"]) * n), 0, n - 1)
    counts = np.zeros(n * n)
    here = v(0, 0)
    for dy, dx in DIRECTIONS:
        there = v(dy, dx)
        both = np.isfinite(here) & np.isfinite(there)
        a, b = level(here[both]).astype(int), level(there[both]).astype(int)
        counts += np.bincount(a * n + b, minlength=n * n) + np.bincount(b * n + a, minlength=n * n)
    return {str(i): counts[i] for i in np.flatnonzero(counts)}


def _texture(t, s):
    n = s["levels"]
    q = np.zeros(n * n)
    for i, c in t.items():
        q[int(i)] = c
    if q.sum() == 0:
        return {}
    q = (q / q.sum()).reshape(n, n)
    i, j = np.indices((n, n))
    mean = (q * i).sum()
    var = (q * (i - mean) ** 2).sum()
    some = q[q > 0]
    return {
        "contrast": (q * (i - j) ** 2).sum(),
        "homogeneity": (q / (1 + (i - j) ** 2)).sum(),
        "energy": (q * q).sum(),
        "entropy": float(-(some * np.log2(some)).sum()),
        "correlation": (q * (i - mean) * (j - mean)).sum() / var if var > 0 else None,
    }


register(Family("glcm", lambda s: ["contrast", "homogeneity", "energy", "entropy", "correlation"], lambda s: 1, _cooccurrence, _texture, {"levels": 32, "low": 0.0, "high": 256.0}))


def _shifts(s):
    return range(-s["reach"], s["reach"] + 1)


def _peak(t, s):
    r = {d: _pearson(t, f"{d}.") for d in _shifts(s)}
    known = [(round(x, 9), -abs(d), d) for d, x in r.items() if x is not None]
    return {"zero": r[0], "shift": max(known)[2] if known else None, "peak": max(known)[0] if known else None}


register(
    Family(
        "crosscorr",
        lambda s: ["zero", "shift", "peak"],
        lambda s: s["reach"],
        lambda v, p, s: {k: x for d in _shifts(s) for k, x in _pairs(v(0, 0), p(0, d), f"{d}.").items()},
        _peak,
        {"reach": 12},
        partner=True,
    )
)


# -- presets --


@dataclass(frozen=True)
class Preset:
    """A named choice of families with settings; checked against the registered ones when it is made."""

    name: str
    families: tuple[str, ...]
    settings: dict[str, Settings] = field(default_factory=dict)

    def __post_init__(self):
        chosen(list(self.families), self.settings)

    def measure(self, pixels: DataFrame, by: list[str]) -> DataFrame:
        return measure(pixels, by, list(self.families), self.settings)


def preset_of(text: str) -> Preset:
    """A preset from JSON: {"name": ..., "families": [...], "settings": {family: {setting: value}}}."""
    made = json.loads(text)
    if unknown := set(made) - {"name", "families", "settings"}:
        raise ValueError(f"unknown entries of a preset: {sorted(unknown)}")
    return Preset(made["name"], tuple(made["families"]), made.get("settings", {}))


def read_presets(spark: SparkSession, path: str) -> dict[str, Preset]:
    """Presets by name from a folder of JSON files, one each; two of one name are an error."""
    out: dict[str, Preset] = {}
    for row in spark.read.text(path, wholetext=True).select(F.col("value")).toLocalIterator():
        preset = preset_of(row["value"])
        if preset.name in out:
            raise ValueError(f"two presets are named {preset.name}")
        out[preset.name] = preset
    return out
