"""Neighbours in tiles: points are dealt to square tiles of about as many rows each, with a border, and numpy works within one.

A tile's side comes from the group's rows and extent, so that dense tables get small tiles. Rows at one place are worked on once.
No list of pairs leaves a task.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvox.functions.lineage import cut, few

#: Rows of a tile, if they lie evenly.
ROWS = 30_000
#: Candidates that numpy holds at once.
CHUNK = 1_000_000


def present(df: DataFrame, columns: list[str], axes: list[str]):
    """Whether the columns have values and the axes numbers."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    for x in axes:
        ok = ok & F.coalesce(F.abs(F.col(x).cast("double")) < float("inf"), F.lit(False))
    return ok


def extents(df: DataFrame, by: list[str], axes: list[str], step: float, rows: int = ROWS) -> DataFrame:
    """(by, __lo, __hi, __gap, __side): bounds of each group by axis, the mean distance of rows, and the side of a tile of about `rows`."""
    g = df.groupBy(*by).agg(F.count("*").cast("double").alias("__n"), *[f(x).cast("double").alias(f"__{n}{x}") for x in axes for n, f in (("lo", F.min), ("hi", F.max))])
    spans = [F.col(f"__hi{x}") - F.col(f"__lo{x}") for x in axes]
    wide = sum((F.when(s > 0, 1.0).otherwise(0.0) for s in spans), F.lit(0.0))
    volume = F.lit(1.0)
    for s in spans:
        volume = volume * F.when(s > 0, s).otherwise(1.0)
    gap = F.when(wide > 0, F.pow(volume / F.col("__n"), 1 / wide)).otherwise(F.lit(float(step)))
    side = F.when(wide > 0, F.pow(volume * rows / F.col("__n"), 1 / wide)).otherwise(F.lit(float(step)))
    least = F.greatest(*spans, F.lit(0.0)) * 1e-9
    return g.select(*by, *[f"__{n}{x}" for x in axes for n in ("lo", "hi")], F.greatest(gap, least).alias("__gap"), F.greatest(side, least).alias("__side"))


def tile(x: str, side, halo=0.0):
    return F.floor((F.col(x) + halo - F.col(f"__lo{x}")) / side).cast("long")


def into_tiles(df: DataFrame, axes: list[str], side, halo) -> DataFrame:
    """df with each row in the tiles (__t by axis) that it is within halo of."""
    for x in axes:
        df = df.withColumn(f"__t{x}", F.explode(F.sequence(tile(x, side, -halo), tile(x, side, halo))))
    return df


def ranges(start: np.ndarray, end: np.ndarray):
    """(row, index) of all indices from start to end of each row, in pieces of about CHUNK."""
    count = np.maximum(end - start, 0)
    total = np.cumsum(count)
    first = 0
    while first < len(count):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + CHUNK, "right")))
        n = count[first:last]
        row = np.repeat(np.arange(first, last), n)
        yield row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[row]
        first = last


def codes(*ids: pd.Series) -> tuple[np.ndarray, ...]:
    """Ids as integers in the order of the ids."""
    _, code = np.unique(np.concatenate([i.to_numpy() for i in ids]), return_inverse=True)
    return tuple(np.split(code, np.cumsum([len(i) for i in ids])[:-1]))


def places(p: np.ndarray, pid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct places with their rows of smallest and second smallest id (-1 if there is no other id)."""
    order = np.lexsort((pid, *p.T))
    s, i = p[order], pid[order]
    new = np.r_[True, (s[1:] != s[:-1]).any(axis=1)]
    start = np.flatnonzero(new)
    # the first row of a place with another id than its smallest
    other = i != i[start][np.cumsum(new) - 1]
    at = np.where(other, np.arange(len(s)), len(s))
    second = np.minimum.reduceat(at, start)
    return s[start], order[start], np.where(second < len(s), order[np.minimum(second, len(s) - 1)], -1)


def nearest_place(q: np.ndarray, qid: np.ndarray, p: np.ndarray, pid: np.ndarray, exclude_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row of p, distance) nearest to each q, ties to the smaller id; -1 and inf without one. Cells of p double until each q has its own."""
    where, first, second = places(p, pid)
    best, found = np.full(len(q), np.inf), np.full(len(q), -1)
    lo, span = where.min(axis=0), np.ptp(where, axis=0)
    wide = span > 0
    size = (np.prod(span[wide]) * 2 / len(where)) ** (1 / wide.sum()) if wide.any() else 1.0
    size = max(size, span.max() * 1e-9)
    while np.prod(np.floor(span / size) + 1) > 4 * len(where) + 16:
        size *= 2
    todo = np.arange(len(q))
    while len(todo):
        shape = (np.floor(span / size) + 1).astype(np.int64)
        cell = np.ravel_multi_index(tuple(np.minimum(np.floor((where - lo) / size).astype(np.int64), shape - 1).T), shape)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        x = q[todo]
        at = np.clip(np.floor((x - lo) / size), -2, shape + 1).astype(np.int64)
        d_best, i_best = np.full(len(todo), np.inf), np.full(len(todo), -1)
        for step in itertools.product((-1, 0, 1), repeat=q.shape[1] - 1):
            head = at[:, :-1] + np.array(step, dtype=np.int64)
            ok = ((head >= 0) & (head < shape[:-1])).all(axis=1) & (at[:, -1] + 1 >= 0) & (at[:, -1] - 1 < shape[-1])
            rows = np.flatnonzero(ok)
            base = np.zeros(len(rows), dtype=np.int64)
            for k in range(q.shape[1] - 1):
                base = (base + head[rows, k]) * shape[k + 1]
            start = np.searchsorted(cell, base + np.maximum(at[rows, -1] - 1, 0), "left")
            end = np.searchsorted(cell, base + np.minimum(at[rows, -1] + 1, shape[-1] - 1), "right")
            for r, j in ranges(start, end):
                if not len(r):
                    continue
                r, j = rows[r], order[j]
                d = np.zeros(len(r))
                for k in range(q.shape[1]):
                    d += (x[r, k] - where[j, k]) ** 2
                d, i = np.sqrt(d), first[j]
                if exclude_self:
                    own = pid[i] == qid[todo[r]]
                    i = np.where(own, second[j], i)
                    d = np.where(i < 0, np.inf, d)
                begin = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                low = np.minimum.reduceat(d, begin)
                here = r[begin]
                tie = np.where(d == np.repeat(low, np.diff(np.r_[begin, len(r)])), pid[i], np.iinfo(np.int64).max)
                least = np.minimum.reduceat(tie, begin)
                hit = np.flatnonzero((tie == np.repeat(least, np.diff(np.r_[begin, len(r)]))) & np.isfinite(d))
                pick = np.full(len(here), -1)
                pick[np.searchsorted(begin, hit, "right") - 1] = i[hit]
                better = (pick >= 0) & ((low < d_best[here]) | ((low == d_best[here]) & (least < pid[i_best[here]])))
                d_best[here[better]], i_best[here[better]] = low[better], pick[better]
        limit = np.full(len(todo), np.inf)
        for k in range(q.shape[1]):
            below, above = lo[k] + (at[:, k] - 1) * size, lo[k] + (at[:, k] + 2) * size
            limit = np.minimum(limit, np.where(at[:, k] - 1 <= 0, np.inf, x[:, k] - below))
            limit = np.minimum(limit, np.where(at[:, k] + 2 >= shape[k], np.inf, above - x[:, k]))
        # what lies outside of the cells searched is farther than limit
        done = (d_best < limit - 1e-6 * size) | np.isinf(limit)
        best[todo[done]], found[todo[done]] = d_best[done], i_best[done]
        todo = todo[~done]
        size *= 2
    return found, best


def nullable(s: pd.Series, keep: np.ndarray) -> pd.Series:
    s = s.reset_index(drop=True)
    return (s.astype("Int64") if s.dtype.kind in "iu" else s.astype(object)).where(pd.Series(keep), None if s.dtype.kind not in "iu" else pd.NA)


def nearest(a: DataFrame, b: DataFrame, by: list[str], axes: list[str], id: str = "id", step: float = 1.0, exclude_self: bool = False, most_rounds: int = 40) -> DataFrame:
    """(by, id, nearest, distance) of every row of a: its nearest row of b in the group, ties to the smaller id; null if there is none.

    Each row of a goes to one tile, those of b to all that they are near to. A row is done if nothing outside the tile's border can be
    as near; the others go on with a border four times as wide, until it covers the extent. step is the border of groups at one place.
    """
    good = lambda df: df.where(present(df, [*by, id], axes)).select(*by, id, *[F.col(x).cast("double").alias(x) for x in axes])
    targets = good(b)
    box = few(extents(targets, by, axes, step))
    kind, target = dict(a.dtypes), dict(b.dtypes)[id]
    names = [f"__t{x}" for x in axes]
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in by), f"`{id}` {kind[id]}", *(f"`{x}` double" for x in axes), f"nearest {target}, distance double, __done boolean"])
    bounds = [f"__{n}{x}" for x in axes for n in ("lo", "hi")]

    def within(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[[*by, id, *axes]]
        if not len(left) or not len(right):
            return out.assign(nearest=nullable(pd.Series([None] * len(left), dtype=object), np.zeros(len(left), bool)), distance=np.nan, __done=False)
        q, p = left[axes].to_numpy(float), right[axes].to_numpy(float)
        qid, pid = codes(left[id], right[id])
        i, d = nearest_place(q, qid, p, pid, exclude_self)
        halo, side = left["__halo"].to_numpy(), left["__wide"].to_numpy()
        limit = np.full(len(q), np.inf)
        for k, x in enumerate(axes):
            lo, hi = left[f"__lo{x}"].to_numpy(), left[f"__hi{x}"].to_numpy()
            below = lo + side * left[f"__t{x}"].to_numpy() - halo
            above = lo + side * (left[f"__t{x}"].to_numpy() + 1) + halo
            limit = np.minimum(limit, np.where(below < lo, np.inf, q[:, k] - below))
            limit = np.minimum(limit, np.where(above > hi, np.inf, above - q[:, k]))
        done = (d < limit - 1e-6 * side) | np.isinf(limit)
        held = (i >= 0) & done
        return out.assign(nearest=nullable(right[id].iloc[i], held), distance=np.where(held, d, np.nan), __done=done)

    todo, found, wide = good(a).join(box, by, "left_semi"), None, 3.0
    for _ in range(most_rounds):
        halo = F.col("__gap") * wide
        border = lambda df: df.join(box, by).withColumns({"__halo": halo, "__wide": F.greatest("__side", halo)})  # noqa: E731, B023
        left = into_tiles(border(todo), axes, F.col("__wide"), F.lit(0.0))
        right = into_tiles(border(targets), axes, F.col("__wide"), F.col("__halo"))
        if found is not None:  # only the tiles that have rows left
            right = right.join(few(left.select(*by, *names).distinct()), [*by, *names], "left_semi")
        keys = [*by, *names]
        pair = left.select(*by, id, *axes, *names, *bounds, "__halo", "__wide").groupBy(*keys).cogroup(right.select(*[F.col(c).alias(c) for c in (*by, id, *axes, *names)]).groupBy(*keys))
        got = cut(pair.applyInPandas(within, schema))
        done = got.where("__done").select(*by, id, "nearest", F.nanvl("distance", F.lit(None).cast("double")).alias("distance"))
        found = done if found is None else found.union(done)
        todo = got.where("NOT __done").select(*by, id, *axes)
        if todo.isEmpty():
            break
        wide *= 4
    none = [F.lit(None).cast(target).alias("nearest"), F.lit(None).cast("double").alias("distance")]
    rest = a.where(~present(a, [*by, id], axes)).select(*by, id, *none)
    alone = a.where(present(a, [*by, id], axes)).join(box, by, "left_anti").select(*by, id, *none)
    return found.union(rest).union(alone)


def count_within(q: np.ndarray, m: np.ndarray, p: np.ndarray, n: np.ndarray, radius: float) -> int:
    """The sum of m * n over all q and p within radius, for places on a plane with numbers of rows.

    p is sorted by x within strips of y. In a strip what is surely within is counted from a running sum, and only what
    lies near the circle is tested.
    """
    if not len(q) or not len(p):
        return 0
    lo, span = p.min(axis=0), np.ptp(p, axis=0)
    density = len(p) / max(span.prod(), radius * radius * 1e-6)
    height = min(max((8 / density) ** 0.5, radius / 64), radius)
    strip = np.floor((p[:, 1] - lo[1]) / height).astype(np.int64)
    order = np.lexsort((p[:, 0], strip))
    x, y, strip = p[order, 0], p[order, 1], strip[order]
    w = n[order]
    run = np.r_[0, np.cumsum(w)]
    # the strips' x side by side, so that one search finds a place in any strip
    gap = span[0] + 4 * radius + 1
    line = (x - lo[0]) + strip * gap
    slack = 1e-7 * gap * (strip[-1] + 2) * 1e-6 + 1e-9 * radius
    total, top, reach = 0, strip[-1], int(np.ceil(radius / height)) + 1
    at = np.floor((q[:, 1] - lo[1]) / height).astype(np.int64)
    for k in range(-reach, reach + 1):
        rows = np.flatnonzero((at + k >= 0) & (at + k <= top) & (q[:, 0] >= lo[0] - radius) & (q[:, 0] <= lo[0] + span[0] + radius))
        if not len(rows):
            continue
        s = at[rows] + k
        below = lo[1] + s * height - q[rows, 1]
        above = below + height
        close = np.maximum(np.maximum(below, -above), 0) - slack
        far = np.maximum(np.abs(below), np.abs(above)) + slack
        rows, s, close, far = (v[close <= radius] for v in (rows, s, close, far))
        outer = np.sqrt(radius * radius - np.maximum(close, 0) ** 2) + slack
        inner = np.sqrt(np.maximum(radius * radius - far * far, 0)) - slack
        c = (q[rows, 0] - lo[0])
        a, e = np.searchsorted(line, s * gap + np.maximum(c - outer, -radius), "left"), np.searchsorted(line, s * gap + np.minimum(c + outer, span[0] + radius), "right")
        some = inner > 0
        b = np.where(some, np.searchsorted(line, s * gap + c - inner, "left"), e)
        d = np.where(some, np.searchsorted(line, s * gap + c + inner, "right"), e)
        b, d = np.clip(b, a, e), np.clip(d, a, e)
        d = np.maximum(b, d)
        total += int((m[rows] * (run[d] - run[b])).sum())
        for start, end in ((a, b), (d, e)):
            for r, j in ranges(start, end):
                hit = np.sqrt((q[rows[r], 0] - x[j]) ** 2 + (q[rows[r], 1] - y[j]) ** 2) <= radius
                total += int((m[rows[r[hit]]] * w[j[hit]]).sum())
    return total


def pair_counts(points: DataFrame, by: list[str], radii: list[float], edge: str | None = None, id: str = "id", unique: bool = False) -> DataFrame:
    """(by, r, pairs): ordered pairs of different ids within r (x, y), of which the first has an edge of r or more where edge is given.

    unique: ids are known not to repeat. No pair is listed; only rows that share an id are met with each other, to be taken off.
    """
    from tabvox.operators.spatial import radius_join

    radii = sorted(float(r) for r in radii)
    top = radii[-1]
    p = points.where(present(points, [*by, id], ["x", "y"])).select(*by, id, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col(edge) if edge else F.lit(float("inf"))).cast("double").alias("e"))
    wide = F.greatest("__side", F.lit(8 * top))
    box = few(extents(p, by, ["x", "y"], top))
    tiles = into_tiles(p.drop(id).join(box, by).withColumns({"__ox": tile("x", wide), "__oy": tile("y", wide)}), ["x", "y"], wide, F.lit(top * 1.000001))
    tiles = tiles.select(*by, "x", "y", "e", ((F.col("__ox") == F.col("__tx")) & (F.col("__oy") == F.col("__ty"))).alias("own"), "__tx", "__ty")
    kind = dict(points.dtypes)

    def count(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        xy, own, e = df[["x", "y"]].to_numpy(), df["own"].to_numpy(bool), df["e"].to_numpy(float)
        order = np.lexsort((xy[:, 0], xy[:, 1]))
        xy, own, e = xy[order], own[order], e[order]
        start = np.flatnonzero(np.r_[True, (xy[1:] != xy[:-1]).any(axis=1)])
        place, n = xy[start], np.diff(np.r_[start, len(xy)])
        got = []
        for r in radii:
            live = np.add.reduceat((own & (e >= r)).astype(np.int64), start)
            some = live > 0
            # less one for each row itself
            got.append((*key[: len(by)], r, count_within(place[some], live[some], place, n, r) - int(live.sum())))
        return pd.DataFrame(got, columns=[*by, "r", "pairs"])

    out = tiles.groupBy(*by, "__tx", "__ty").applyInPandas(count, ", ".join([*(f"`{c}` {kind[c]}" for c in by), "r double, pairs long"]))
    if not unique:
        rs = F.explode(F.array(*[F.lit(r) for r in radii])).alias("r")
        again = p.groupBy(*by, id).agg(F.count("*").alias("n")).where("n > 1").select(*by, id)
        same = p.join(again.hint("merge"), [*by, id], "left_semi").groupBy(*by, id, "x", "y", "e").agg(F.count("*").alias("n"))
        met = radius_join(same, same, [*by, id], top, ["x", "y"]).select(*by, F.col("a_e").alias("e"), "distance", rs, (F.col("a_n") * F.col("b_n") - F.when((F.col("distance") == 0), F.col("a_n")).otherwise(F.lit(0))).alias("n"))
        out = out.union(met.where("distance <= r AND e >= r").select(*by, "r", -F.col("n")))
    return out.groupBy(*by, "r").agg(F.sum("pairs").alias("pairs"))


def farthest_square(radius: float) -> float:
    """The largest number whose square root is at most radius."""
    t = radius * radius
    while np.sqrt(t) > radius:
        t = np.nextafter(t, 0.0)
    while np.sqrt(np.nextafter(t, np.inf)) <= radius:
        t = np.nextafter(t, np.inf)
    return float(t)


def even_pairs(q: np.ndarray, qe: np.ndarray, p: np.ndarray, pe: np.ndarray, radii: list[float], density: float, chunk: int = 4096) -> list[int]:
    """For each radius the ordered pairs of a point of q and one of p, in either order, within it whose first has an edge (qe, pe) of the radius
    or more. Where q is p, of different points.

    For points of about the given density everywhere. They lie in strips of y and there in narrow columns, so that running counts of the columns give
    what is surely within and where what must be tested lies; a pair is met once for both orders.
    """
    if not len(q) or not len(p):
        return [0] * len(radii)
    same, slack, top = q is p, 1e-6, max(0.0, *radii)
    height = max((2 / density) ** 0.5, top / 64)
    width = height / 8
    lo, hi = np.minimum(q.min(axis=0), p.min(axis=0)), np.maximum(q.max(axis=0), p.max(axis=0))
    # room around, so that no strip or column asked for lies outside
    above, beside = int(np.ceil(top / height)) + 1, int(np.ceil(top / width)) + 2
    columns, strips = int((hi[0] - lo[0]) / width) + 2 * beside + 2, int((hi[1] - lo[1]) / height) + 2 * above + 2

    def placed(v: np.ndarray, e: np.ndarray):
        """x, y, edge, column (strips side by side) and share of the strip below, by column."""
        row = (v[:, 1] - lo[1]) / height + above
        strip = np.floor(row)
        line = strip * columns + (v[:, 0] - lo[0]) / width + beside
        order = np.argsort(line)
        return v[order, 0], v[order, 1], e[order], line[order], (row - strip)[order]

    x, y, e, line, _ = there = placed(p, pe)
    start = np.r_[0, np.cumsum(np.bincount(line.astype(np.int64), minlength=columns * strips))]
    qx, qy, qe, ql, share = there if same else placed(q, qe)
    got = []
    for r in radii:
        if r < 0:
            got.append(0)
            continue
        most, steps = farthest_square(r), int(np.ceil(r / height))
        first, second = qe >= r, e >= r
        plain, run, total = first.all() and second.all(), np.r_[0, np.cumsum(second)], 0
        for at in range(0, len(qx), chunk):
            part = slice(at, at + chunk)
            for k in range(0 if same else -steps, steps + 1):
                xs, ys, ls, f, w = qx[part], qy[part], ql[part], share[part], first[part]
                # the least and largest difference in y of what lies k strips on, and half the chords at these
                close = np.maximum((k - slack - f if k > 0 else f - slack - k - 1) * height, 0.0) if k else np.zeros(len(f))
                far = ((k + 1 - f if k > 0 else f - k if k else np.maximum(f, 1 - f)) + slack) * height
                if abs(k) >= steps - 1 and (close > r).any():
                    some = close <= r
                    xs, ys, ls, w, close, far = (v[some] for v in (xs, ys, ls, w, close, far))
                outer = np.sqrt(r * r - close * close) / width + slack
                inner = np.maximum(np.sqrt(np.maximum(r * r - far * far, 0.0)) / width - slack, 0.0)
                ls = ls + k * columns
                a, b = start[(ls - outer).astype(np.int64)], start[(ls - inner).astype(np.int64) + 1]
                c, d = start[(ls + inner).astype(np.int64)], start[(ls + outer).astype(np.int64) + 1]
                if same and not k:
                    own = np.arange(at + 1, at + 1 + len(ls))
                    a, b, c, d = (np.maximum(v, own) for v in (a, b, c, d))
                c = np.maximum(b, c)
                total += 2 * int((c - b).sum()) if plain else int(((c - b) * w).sum() + (run[c] - run[b]).sum())
                n = np.r_[b - a, d - c]
                j = np.repeat(np.r_[a, c] + n - np.cumsum(n), n)
                j += np.arange(len(j))
                dx, dy = x[j] - np.repeat(np.r_[xs, xs], n), y[j] - np.repeat(np.r_[ys, ys], n)
                hit = dx * dx + dy * dy <= most
                total += 2 * np.count_nonzero(hit) if plain else np.count_nonzero(hit & second[j]) + np.count_nonzero(hit & np.repeat(np.r_[w, w], n))
        got.append(int(total))
    return got


def random_tile(seed: list[int], n: int, low: np.ndarray, high: np.ndarray, shape: tuple[int, int], at: tuple[int, int]) -> np.ndarray:
    """The points in a tile (row, column) of an even random pattern of n points in a window. Any tile can be made by itself; numbers add up to n."""
    (rows, cols), (row, col) = shape, at
    if not (0 <= row < rows and 0 <= col < cols):
        return np.zeros((0, 2))
    dealt = lambda m, parts, *key: np.random.default_rng([*seed, *key]).multinomial(m, np.full(parts, 1 / parts))
    held = dealt(dealt(n, rows, 0, 0)[row], cols, row + 1, 0)[col]
    u = np.random.default_rng([*seed, row + 1, col + 1]).random((held, 2))
    return low + (u + (col, row)) / (cols, rows) * (high - low)


def random_pairs(seed: list[int], n: int, low: np.ndarray, high: np.ndarray, shape: tuple[int, int], at: tuple[int, int], radii: list[float]) -> tuple[list[int], list[int]]:
    """(anchors, pairs) of a tile of a random pattern for each radius: points as far from the window's border, and ordered pairs within it of which the
    first is an anchor. Pairs across a side belong to the tile on the left or below; a tile is at least as wide as the largest radius, or alone.
    """
    row, col = at
    edge = lambda v: np.minimum(v - low, high - v).min(axis=1)
    own = random_tile(seed, n, low, high, shape, at)
    e, top = edge(own), max(radii)
    density = n / np.prod(high - low)
    size = (high - low) / shape[::-1]
    corner = low + size * (col, row)
    near = np.concatenate([random_tile(seed, n, low, high, shape, (row + i, col + j)) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))])
    near = near[((near >= corner - top * 1.000001) & (near <= corner + size + top * 1.000001)).all(axis=1)]
    # of the own points those near a side with such neighbours
    side = (own > corner + size - top * 1.000001).any(axis=1)
    within, across = even_pairs(own, e, own, e, radii, density), even_pairs(own[side], e[side], near, edge(near), radii, density)
    return [int((e >= r).sum()) for r in radii], [a + b for a, b in zip(within, across, strict=True)]


def distinct_rows(m: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of smallest code of each distinct row of m, and which of these each row equals."""
    order = np.lexsort((code, *m.T))
    new = np.r_[True, (m[order][1:] != m[order][:-1]).any(axis=1)]
    which = np.empty(len(m), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def best_box(q: np.ndarray, p: np.ndarray, pid: np.ndarray, by_share: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row of p, share of q in %) of the box of p that covers most of each q, ties to the smaller id; -1 and 0 without one.

    Boxes are rows lo, hi, lo, hi ... with inclusive ends. Without by_share any box that meets q is as good as another. p is sorted along the
    first axis within strips of the second, apart by size, so that only boxes about q are tested; equal boxes are tested once.
    """
    row, which = distinct_rows(q, np.arange(len(q)))
    all_q, q = q, q[row]
    keep, _ = distinct_rows(p, pid)
    p, pid = p[keep], pid[keep]
    lo, hi, plo, phi = q[:, ::2], q[:, 1::2], p[:, ::2], p[:, 1::2]
    own = np.prod(hi - lo + 1, axis=1)
    best, least, found = np.full(len(q), -1.0), np.full(len(q), np.iinfo(np.int64).max), np.full(len(q), -1)
    strip_axis = min(1, lo.shape[1] - 1)
    width, height = phi[:, 0] - plo[:, 0], phi[:, strip_axis] - plo[:, strip_axis]
    kind = np.floor(np.log2(width + 1) / 2) * 1000 + np.floor(np.log2(height + 1) / 2)
    base, span = plo[:, strip_axis].min(), np.ptp(plo[:, strip_axis])
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        wide, tall = width[rows].max(), height[rows].max()
        step = max(tall / 2, span / 64, 1e-300)
        strip = np.floor((plo[rows, strip_axis] - base) / step).astype(np.int64)
        order = np.lexsort((plo[rows, 0], strip))
        rows, strip = rows[order], strip[order]
        at = np.r_[np.flatnonzero(np.r_[True, strip[1:] != strip[:-1]]), len(rows)]
        first = np.floor((lo[:, strip_axis] - tall - base) / step) - 1
        last = np.floor((hi[:, strip_axis] - base) / step) + 1
        for a, e in zip(at, at[1:], strict=False):
            near = np.flatnonzero((first <= strip[a]) & (last >= strip[a]))
            line = plo[rows[a:e], 0]
            start, end = np.searchsorted(line, lo[near, 0] - wide, "left"), np.searchsorted(line, hi[near, 0], "right")
            for r, j in ranges(start, end):
                if not len(r):
                    continue
                r, j = near[r], rows[a + j]
                meet = np.ones(len(r), bool)
                for x in range(lo.shape[1]):
                    meet &= (plo[j, x] <= hi[r, x]) & (phi[j, x] >= lo[r, x])
                r, j = r[meet], j[meet]
                if not len(r):
                    continue
                share = np.zeros(len(r))
                if by_share:
                    volume = np.ones(len(r))
                    for x in range(lo.shape[1]):
                        volume *= np.minimum(hi[r, x], phi[j, x]) - np.maximum(lo[r, x], plo[j, x]) + 1
                    share = 100 * volume / own[r]
                begin = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                size = np.diff(np.r_[begin, len(r)])
                top, here = np.maximum.reduceat(share, begin), r[begin]
                tie = np.where(share == np.repeat(top, size), pid[j], np.iinfo(np.int64).max)
                low = np.minimum.reduceat(tie, begin)
                pick = np.empty(len(here), np.int64)
                hit = np.flatnonzero(tie == np.repeat(low, size))[::-1]
                pick[np.searchsorted(begin, hit, "right") - 1] = j[hit]
                better = (top > best[here]) | ((top == best[here]) & (low < least[here]))
                best[here[better]], least[here[better]], found[here[better]] = top[better], low[better], pick[better]
    found = np.where(found >= 0, keep[found], -1)
    return found[which], np.maximum(best, 0.0)[which] if len(all_q) else np.zeros(0)


def best_boxes(a: DataFrame, b: DataFrame, by: list[str], size: dict[str, float], id: str, by_share: bool = True) -> DataFrame:
    """(by, id, partner, pct) of the ids of a (x0, x1, ... of the axes in size) that meet a box of b in the group: the one that covers most
    of the own box, ties to the smaller id; without by_share the smallest id.

    Boxes go to the tiles that they cover, of twice the given size at least, and each tile gives one row a box of a.
    """
    ends = [f"{x}{i}" for x in size for i in (0, 1)]
    ordered = F.lit(True)
    for x in size:
        ordered = ordered & (F.col(f"{x}0") <= F.col(f"{x}1"))
    good = lambda df: df.where(present(df, [*by, id], ends) & ordered).select(*by, id, *[F.col(c).cast("double").alias(c) for c in ends])
    a, b = good(a), good(b)
    corners = b.select(*by, *[F.col(f"{x}0").alias(x) for x in size])
    box = few(extents(corners, by, list(size), 1.0).select(*by, *[f"__lo{x}" for x in size], "__side"))
    names = [f"__t{x}" for x in size]

    def tiled(df):
        df = df.join(box, by)
        for x, s in size.items():
            at = lambda c, x=x, s=s: F.floor((F.col(c) - F.col(f"__lo{x}")) / F.greatest("__side", F.lit(2.0 * s))).cast("long")
            df = df.withColumn(f"__t{x}", F.explode(F.sequence(at(f"{x}0"), at(f"{x}1"))))
        return df.select(*[F.col(c).alias(c) for c in (*by, id, *ends, *names)])

    kind, target = dict(a.dtypes), dict(b.dtypes)[id]

    def within(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[[*by, id]]
        if not len(left) or not len(right):
            return out[:0].assign(partner=right[id][:0], pct=pd.Series(dtype=float))
        (code,) = codes(right[id])
        i, pct = best_box(left[ends].to_numpy(float), right[ends].to_numpy(float), code, by_share)
        return out[i >= 0].assign(partner=right[id].to_numpy()[i[i >= 0]], pct=pct[i >= 0])

    keys = [*by, *names]
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in (*by, id)), f"partner {target}, pct double"])
    got = tiled(a).groupBy(*keys).cogroup(tiled(b).groupBy(*keys)).applyInPandas(within, schema)
    top = got.groupBy(*by, id).agg(F.min(F.struct((-F.col("pct")).alias("less"), "partner")).alias("m"))
    return top.select(*by, id, "m.partner", (-F.col("m.less")).alias("pct"))
