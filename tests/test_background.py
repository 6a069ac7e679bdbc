"""Signal over background and evenness of the background against plain arrays."""

import numpy as np

from tabvox.operators.background import background_cv, signal_db


def test_background(spark):
    r = np.random.default_rng(2)
    images = {"a": r.integers(0, 40, (18, 13)).astype(float), "b": np.where(r.random((12, 12)) < 0.3, 200.0, 10.0 + r.integers(0, 5, (12, 12))), "flat": np.full((8, 8), 3.0)}
    t = spark.createDataFrame([(g, y + 2, x, float(a[y, x])) for g, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])] + [("a", 0, 0, None)], "g string, y int, x int, value double")
    db, cv = ({q["g"]: q[1] for q in f(t, ["g"]).collect()} for f in (signal_db, background_cv))
    for g, a in images.items():
        v = np.sort(a.ravel())
        best = None
        for s in np.unique(v)[:-1]:
            low, high = v[v <= s], v[v > s]
            score = round(len(low) * len(high) * (low.mean() - high.mean()) ** 2 / len(v) ** 2, 9)
            best = max(best or (score, -s), (score, -s))
        want = 0.0
        if best and (v < -best[1]).any():
            low, high = v[v < -best[1]], v[v >= -best[1]]
            ratio = (high.mean() - low.mean()) / (low.std() if low.std() >= 1e-6 else 1.0)
            want = 20 * np.log10(ratio) if ratio > 0 else 0.0
        assert np.isclose(db[g], want)
        h, w = a.shape[0] // 4, a.shape[1] // 4
        tiles = [np.sort((p := a[i * h : i * h + h, j * w : j * w + w])[p < a.mean()]) for i in range(4) for j in range(4)]
        m = np.array([x[len(x) // 2] for x in tiles if len(x) and x[len(x) // 2] > 0])
        assert np.isclose(cv[g], m.std() / m.mean() if len(m) else 0.0)
    assert signal_db(t.where("false"), ["g"]).count() == background_cv(t.where("false"), ["g"]).count() == 0
