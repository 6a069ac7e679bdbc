"""Objects at all thresholds against a flood fill at each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabvox.operators.levels import contract, object_counts, roc_of_counts


def flood(value, t):
    todo = {p for p, v in value.items() if v is not None and v >= t}
    n, voxels = 0, len(todo)
    while todo:
        n += 1
        stack = [todo.pop()]
        while stack:
            z, y, x = stack.pop()
            for q in [(z + a, y + b, x + c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]:
                if q in todo:
                    todo.remove(q)
                    stack.append(q)
    return voxels, n


def test_contract_keeps_the_forest():
    r = np.random.default_rng(3)
    for _ in range(100):
        n, m = int(r.integers(2, 12)), int(r.integers(1, 30))
        a, b, w = r.integers(0, n, m), r.integers(0, n, m), r.integers(1, 5, m)
        fixed = r.random(n) < 0.4

        def kruskal(edges, done=()):
            root = list(range(n))

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            out = []
            for wt, i, j in sorted(edges, reverse=True):
                if find(i) != find(j):
                    root[find(i)] = find(j)
                    out.append(wt)
            return sorted(out)

        used, p, q, left = contract(n, a, b, w, fixed)
        whole = kruskal(zip(w.tolist(), a.tolist(), b.tolist()))
        assert sorted(used.tolist() + kruskal(zip(left.tolist(), p.tolist(), q.tolist()))) == whole
        assert fixed[p].all() and fixed[q].all()


@pytest.mark.parametrize("side,density", [(3, 0.5), (4, 0.15), (64, 0.5)])
def test_object_counts_equal_flood_fill(spark, side, density):
    r = np.random.default_rng(side)
    values = {}
    for g, shape in ((1, (3, 14, 17)), (2, (1, 20, 9)), (3, (2, 2, 2))):
        for p in np.ndindex(shape):
            if r.random() < density:
                values[g, (p[0] - 1, p[1] - 5, p[2] + 2)] = None if r.random() < 0.02 else float(r.integers(0, 9))
    values[4, (0, 0, 0)] = 0.0
    df = spark.createDataFrame([(g, *p, v) for (g, p), v in values.items()], "g int, z int, y int, x int, value double")
    steps = [1.0, 3.0, 4.5, 7.0, 20.0]
    got = {(x["g"], x["threshold"]): (x["voxels"], x["objects"]) for x in object_counts(df, ["g"], steps, side=side).collect()}
    groups = {g for g, _ in values}
    assert got == {(g, t): flood({p: v for (h, p), v in values.items() if h == g}, t) for g in groups for t in steps}
    assert object_counts(df.where("false"), ["g"], steps).count() == 0


def test_roc_of_counts(spark):
    rows = [(t, c, n) for t, counts in ((1.0, (3, 1, 9, 8)), (2.0, (0, 1, 4, 2)), (3.0, (0, 0, 2, 1)), (4.0, (0, 0, 1, 0))) for c, n in zip((True, True, False, False), counts)]
    got = {r["threshold"]: r for r in roc_of_counts(spark.createDataFrame(rows, "threshold double, control boolean, n long"), "n", 0.1).collect()}
    assert [t for t, r in got.items() if r["best"]] == [3.0] and (got[2.0]["fpr"], got[3.0]["retention"], got[3.0]["mean_metric"]) == (0.5, 1.0, 1.5)
    none = roc_of_counts(spark.createDataFrame(rows, "threshold double, control boolean, n long").where("threshold < 3"), "n", 0.1)
    assert [r["threshold"] for r in none.where("best").collect()] == [2.0]
    assert none.where(F.lit(False)).count() == 0
