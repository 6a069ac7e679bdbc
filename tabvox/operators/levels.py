"""Objects at all thresholds at once: a maximum spanning forest of the voxels, contracted in growing boxes.

At a threshold there are as many objects as voxels that reach it, less the edges of a maximum spanning
forest that do, where an edge between neighbours weighs what the darker of them does. So one forest
gives the number of objects at every threshold. A node all of whose edges are known may be merged along
its heaviest one, which every such forest has; in a box only voxels at its faces have edges beyond it,
so a box sends on no more than its faces hold, and each round joins boxes twice as wide.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tabvox.functions.lineage import cut

_AXES = ("z", "y", "x")
_HALF = [(dz, dy, dx) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dz, dy, dx) > (0, 0, 0)]


def contract(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge the nodes that aren't fixed along heaviest edges: weights of the edges used, and the edges (a, b, w) left between fixed nodes."""
    used, fixed = [], fixed.copy()
    while True:
        keep = a != b
        a, b, w = a[keep], b[keep], w[keep]
        # of several edges between two nodes only the heaviest can be in a forest
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((-w, hi, lo))
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)
        a, b, w = lo[order][first], hi[order][first], w[order][first]
        src, dst, edge = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(np.arange(len(a)), 2)
        free = ~fixed[src]
        if not free.any():
            return np.concatenate(used) if used else np.zeros(0, w.dtype), a, b, w
        src, dst, edge = src[free], dst[free], edge[free]
        order = np.lexsort((edge, -w[edge], src))  # ties go to the smaller edge, so that choices can't run in a ring
        best = order[np.diff(src[order], prepend=-1) > 0]
        parent = np.arange(n)
        parent[src[best]] = dst[best]
        ring = (parent[parent] == np.arange(n)) & (parent > np.arange(n))  # two that chose the same edge
        parent[ring] = np.flatnonzero(ring)
        used.append(w[np.unique(edge[best])])
        while (parent != parent[parent]).any():
            parent = parent[parent]
        a, b = parent[a], parent[b]


def object_counts(voxels: DataFrame, by: list[str], thresholds: list[float], side: int = 64) -> DataFrame:
    """(by, threshold, voxels, objects): of the voxels (by, z, y, x, value) that reach each threshold, in how many 26-connected objects they lie.

    Coordinates are whole numbers, a place occurs once in its group; groups and thresholds without a voxel
    give 0, nulls and NaN reach none.
    """
    steps = sorted(set(map(float, thresholds)))
    if not steps:
        raise ValueError("at least one threshold is needed")
    groups = [F.col(c) for c in by]
    level = reduce(lambda s, t: s + F.when(F.col("value") >= t, 1).otherwise(0), steps, F.lit(0)).cast("long")
    v = voxels.select(*by, *[F.col(a).cast("long").alias(a) for a in _AXES], F.when(~F.isnan("value"), level).otherwise(0).alias("w")).where("w > 0")
    least = v.agg(*[F.min(a).alias(a) for a in _AXES]).first()  # boxes grow from there, so that one holds all in the end
    v = v.withColumns({a: F.col(a) - F.lit(least[a] or 0) for a in _AXES})
    ends = [T.StructField(f"{e}_{a}", T.LongType()) for e in "ab" for a in _AXES]
    schema = T.StructType([*[voxels.schema[c] for c in by], *ends, T.StructField("w", T.LongType()), T.StructField("n", T.LongType())])
    places = [f.name for f in ends]

    def rows(key, used, a, b, w):
        """Rows of weights that are settled (n of each) and of edges that are left (n is 0)."""
        weight, n = np.unique(used, return_counts=True)
        out = pd.DataFrame({**dict.fromkeys(places, 0), "w": weight.astype(np.int64), "n": n.astype(np.int64)}, index=range(len(weight)))
        left = pd.DataFrame(np.hstack([a, b]).astype(np.int64), columns=places).assign(w=np.asarray(w, np.int64), n=0)
        out = pd.concat([out, left], ignore_index=True)
        for c, k in zip(by, key, strict=True):
            out[c] = k
        return out[schema.names]

    def voxel_box(pdf: pd.DataFrame) -> pd.DataFrame:
        """A box of voxels with a border of one: its own edges are contracted, those beyond it stay."""
        corner = pdf[["bz", "by_", "bx"]].iloc[0].to_numpy() * side - 1
        at = pdf[list(_AXES)].to_numpy() - corner
        grid = np.full((side + 2,) * 3, -1, np.int64)
        grid[tuple(at.T)] = np.arange(len(at))
        w, own = pdf["w"].to_numpy(), ((at >= 1) & (at <= side)).all(1)
        pairs = []
        for step in _HALF:
            there = at + step
            ok = ((there >= 0) & (there < side + 2)).all(1)
            other = np.full(len(at), -1)
            other[ok] = grid[tuple(there[ok].T)]
            i = np.flatnonzero(other >= 0)
            pairs.append(np.stack([i, other[i]]))
        a, b = np.concatenate(pairs, 1)
        weight = np.minimum(w[a], w[b])
        inside, across = own[a] & own[b], own[a] != own[b]
        fixed = np.zeros(len(at), bool)
        fixed[a[across]] = fixed[b[across]] = True
        used, p, q, left = contract(len(at), a[inside], b[inside], weight[inside], fixed)
        mine = across & own[a]  # the box of the first end sends an edge on
        p, q, left = np.concatenate([p, a[mine]]), np.concatenate([q, b[mine]]), np.concatenate([left, weight[mine]])
        cells = pdf[list(_AXES)].to_numpy()
        return rows([pdf[c].iloc[0] for c in by], used, cells[p], cells[q], left)

    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / side), F.floor((F.col(c) + 1) / side)))
    boxed = v.withColumn("bz", near("z")).withColumn("by_", near("y")).withColumn("bx", near("x"))
    now = cut(boxed.groupBy(*by, "bz", "by_", "bx").applyInPandas(voxel_box, schema))
    settled, width = now.where("n > 0"), side
    while not (edges := now.where("n = 0")).isEmpty():
        width *= 2
        box = lambda e, width=width: F.struct(*[F.floor(F.col(f"{e}_{a}") / width).alias(a) for a in _AXES])
        dealt = edges.withColumns({"first": box("a"), "second": box("b")}).withColumn("box", F.explode(F.array_distinct(F.array("first", "second"))))

        def wider(pdf: pd.DataFrame) -> pd.DataFrame:
            both = pdf[places].to_numpy().reshape(-1, 3)
            nodes, which = np.unique(both, axis=0, return_inverse=True)
            a, b = which.reshape(-1, 2).T
            w, inside, mine = pdf["w"].to_numpy(), pdf["inside"].to_numpy(bool), pdf["mine"].to_numpy(bool)
            fixed = np.zeros(len(nodes), bool)
            fixed[a[~inside]] = fixed[b[~inside]] = True
            used, p, q, left = contract(len(nodes), a[inside], b[inside], w[inside], fixed)
            on = ~inside & mine
            return rows([pdf[c].iloc[0] for c in by], used, nodes[np.concatenate([p, a[on]])], nodes[np.concatenate([q, b[on]])], np.concatenate([left, w[on]]))

        flat = dealt.select(*by, *places, "w", (F.col("first") == F.col("second")).alias("inside"), (F.col("box") == F.col("first")).alias("mine"), *[F.col(f"box.{a}").alias(f"box_{a}") for a in _AXES])
        now = cut(flat.groupBy(*by, *[f"box_{a}" for a in _AXES]).applyInPandas(wider, schema))
        settled = settled.unionByName(now.where("n > 0"))
    tally = v.groupBy(*by, "w").agg(F.count("*").alias("voxels")).withColumn("edges", F.lit(0).cast("long")).unionByName(settled.groupBy(*by, "w").agg(F.sum("n").alias("edges")).withColumn("voxels", F.lit(0).cast("long")))
    tally = tally.groupBy(*by, "w").agg(F.sum("voxels").alias("voxels"), F.sum("edges").alias("edges"))
    every = voxels.select(*by).distinct() if by else voxels.sparkSession.range(1).select()
    grid = every.withColumn("step", F.explode(F.array(*[F.struct(F.lit(i + 1).cast("long").alias("w"), F.lit(t).alias("threshold")) for i, t in enumerate(steps)]))).select(*groups, "step.w", "step.threshold")
    up = W.partitionBy(*by).orderBy(F.desc("w")).rowsBetween(W.unboundedPreceding, 0)
    full = grid.join(tally.hint("merge"), [*by, "w"], "left").fillna(0, ["voxels", "edges"])
    return full.select(*by, "threshold", F.sum("voxels").over(up).alias("voxels"), (F.sum("voxels").over(up) - F.sum("edges").over(up)).alias("objects"))


def roc_of_counts(measured: DataFrame, metric: str, limit: float) -> DataFrame:
    """(threshold, fpr, retention, mean_metric, best) of images (threshold, control, metric): an image is positive where its metric is over 0.

    fpr and retention: the share of controls and of others that are positive; mean_metric: of the others.
    best: the threshold under the limit of false positives that retains most, then the smallest; if none
    is under it, the one of the fewest false positives, then of the highest retention, then the smallest.
    """
    positive = (F.col(metric) > 0).cast("double")
    out = measured.groupBy("threshold").agg(F.avg(F.when(F.col("control"), positive)).alias("fpr"), F.avg(F.when(~F.col("control"), positive)).alias("retention"), F.avg(F.when(~F.col("control"), F.col(metric))).alias("mean_metric"))
    meets = F.col("fpr") <= limit
    order = F.struct(meets, F.when(meets, F.lit(0.0)).otherwise(-F.col("fpr")), F.col("retention"), -F.col("threshold"))
    best = out.agg(F.max_by("threshold", order)).first()[0]  # one number
    return out.withColumn("best", F.coalesce(F.col("threshold") == F.lit(best), F.lit(False)))
