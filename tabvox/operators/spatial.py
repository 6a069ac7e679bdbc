"""Joins in space by grid cells: an equi join on cells, then the exact test. No pair of all rows is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvox.operators.near import best_boxes, nearest  # noqa: F401


def cell(c: str | Column, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size)


def around(c: Column, reach: int = 1) -> Column:
    return F.explode(F.sequence(c - reach, c + reach))


def radius_join(a: DataFrame, b: DataFrame, by: list[str], radius: float, axes: list[str]) -> DataFrame:
    """All pairs within radius in the same group, with distance; columns of a and b by a_ and b_.

    b goes to the cells around its own, so each pair meets once.
    """
    left = a.select(*by, *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in by], *[cell(x, radius).alias(f"c_{x}") for x in axes])
    right = b.select(*by, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in by])
    for x in axes:
        right = right.select("*", around(cell(f"b_{x}", radius)).alias(f"c_{x}"))
    squares = sum(((F.col(f"a_{x}") - F.col(f"b_{x}")) ** 2 for x in axes), F.lit(0.0))
    return left.join(right.hint("merge"), [*by, *(f"c_{x}" for x in axes)]).drop(*[f"c_{x}" for x in axes]).withColumn("distance", F.sqrt(squares)).where(F.col("distance") <= radius)


def closest_counts(found: DataFrame, targets: DataFrame, by: list[str], id: str = "id") -> DataFrame:
    """For each target how many rows have it as their nearest; 0 is kept."""
    n = found.groupBy(*by, F.col("nearest").alias(id)).agg(F.count("*").alias("n"))
    return targets.select(*by, id).join(n, [*by, id], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def box_join(a: DataFrame, b: DataFrame, by: list[str], size: dict[str, float]) -> DataFrame:
    """Pairs of inclusive boxes (x0, x1, ... of the axes in size) that overlap, as a_ and b_ columns with intersection volume.

    Both sides go to the cells that they cover; a pair counts in the cell of its overlap's corner.
    """
    def cells(df, p):
        out = df.select(*by, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in by])
        for x, s in size.items():
            out = out.select("*", F.explode(F.sequence(cell(f"{p}_{x}0", s), cell(f"{p}_{x}1", s))).alias(f"c_{x}"))
        return out

    out = cells(a, "a").join(cells(b, "b").hint("merge"), [*by, *(f"c_{x}" for x in size)])
    volume = F.lit(1.0)
    for x, s in size.items():
        low, high = F.greatest(f"a_{x}0", f"b_{x}0"), F.least(f"a_{x}1", f"b_{x}1")
        out = out.where((low <= high) & (cell(low, s) == F.col(f"c_{x}")))
        volume = volume * (high - low + 1)
    return out.withColumn("intersection", volume).drop(*[f"c_{x}" for x in size])


def box_overlap(a: DataFrame, b: DataFrame, by: list[str], size: dict[str, float], id: str = "label") -> DataFrame:
    """(by, id, partner, pct): the largest share of the own box that one partner covers, ties to the smaller id; 0 without one."""
    best = best_boxes(a, b, by, size, id)
    return a.select(*by, id).join(best.hint("merge"), [*by, id], "left").select(*by, id, "partner", F.coalesce("pct", F.lit(0.0)).alias("pct"))


def point_in_box(points: DataFrame, boxes: DataFrame, by: list[str], size: dict[str, float], id: str = "label") -> DataFrame:
    """(by, id, box): the first box that holds each point's rounded place; null if none does."""
    p = points.select(*by, id, *[F.round(x).alias(f"{x}0") for x in size], *[F.round(x).alias(f"{x}1") for x in size])
    hit = best_boxes(p, boxes, by, size, id, by_share=False).select(*by, id, F.col("partner").alias("box"))
    return points.select(*by, id).join(hit.hint("merge"), [*by, id], "left")


def centroid_hits(points: DataFrame, labels: DataFrame, by: list[str], axes: list[str], id: str = "label") -> DataFrame:
    """(by, id, partner): the label at each point's rounded place; null on background."""
    at = points.select(*by, id, *[F.round(x).cast("int").alias(x) for x in axes])
    return at.join(labels.select(*by, *axes, F.col("label").alias("partner")), [*by, *axes], "left").select(*by, id, "partner")


def marker_flags(hits: DataFrame, objects: DataFrame, by: list[str], id: str = "label") -> DataFrame:
    """How many points lie in each object, and whether it has one, or several."""
    n = hits.where(F.col("partner").isNotNull()).groupBy(*by, F.col("partner").alias(id)).agg(F.count("*").alias("overlap_count"))
    out = objects.select(*by, id).join(n, [*by, id], "left").withColumn("overlap_count", F.coalesce("overlap_count", F.lit(0)))
    return out.withColumns({"has_marker": (F.col("overlap_count") >= 1).cast("int"), "is_cluster": (F.col("overlap_count") >= 2).cast("int")})


def voxel_overlap(a: DataFrame, b: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """(by, label, pct): the largest share of each object of a that one object of b covers, by voxels."""
    size = a.groupBy(*by, "label").agg(F.count("*").alias("size"))
    both = a.join(b.withColumnRenamed("label", "partner"), [*by, *axes]).groupBy(*by, "label", "partner").agg(F.count("*").alias("n"))
    best = both.groupBy(*by, "label").agg(F.max("n").alias("n"))
    return size.join(best, [*by, "label"], "left").select(*by, "label", (100.0 * F.coalesce("n", F.lit(0)) / F.col("size")).alias("pct"))


def box_fill(voxels: DataFrame, boxes: DataFrame, by: list[str], size: dict[str, float]) -> DataFrame:
    """(by, label, best, total): share of each box's volume that one partner's, or all partners', voxels fill."""
    v = voxels.select(*by, F.col("label"), *[F.col(x).alias(f"{x}0") for x in size], *[F.col(x).alias(f"{x}1") for x in size])
    hit = box_join(boxes, v, by, size).groupBy(*by, F.col("a_label").alias("label"), "b_label").agg(F.count("*").alias("n")).groupBy(*by, "label").agg(F.max("n").alias("best"), F.sum("n").alias("total"))
    volume = F.lit(1.0)
    for x in size:
        volume = volume * (F.col(f"{x}1") - F.col(f"{x}0") + 1)
    out = boxes.select(*by, "label", volume.alias("volume")).join(hit, [*by, "label"], "left")
    return out.select(*by, "label", *[(100.0 * F.coalesce(c, F.lit(0)) / F.col("volume")).alias(c) for c in ("best", "total")])


def line_distance(points: DataFrame, lines: DataFrame, by: list[str], id: str = "id") -> DataFrame:
    """(by, id, distance) to the nearest segment of lines (by, line, seq, x, y) in the group; null without a line.

    lines are a small dimension: the vertices of a group are gathered once, as an array.
    """
    from pyspark.sql.window import Window as W

    w = W.partitionBy(*by, "line").orderBy("seq")
    seg = lines.select(*by, "line", F.struct("x", "y").alias("p"), F.lead(F.struct("x", "y")).over(w).alias("q"), F.count("*").over(W.partitionBy(*by, "line")).alias("n"))
    seg = seg.where("q IS NOT NULL OR n = 1").select(*by, "p", F.coalesce("q", "p").alias("q"))
    arrays = seg.groupBy(*by).agg(F.collect_list(F.struct("p", "q")).alias("segments"))

    def to(s):
        dx, dy = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]
        length = dx * dx + dy * dy
        t = F.when(length > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("x") - s["p"]["x"]) * dx + (F.col("y") - s["p"]["y"]) * dy) / length))).otherwise(0.0)
        return F.sqrt(F.pow(F.col("x") - s["p"]["x"] - t * dx, 2) + F.pow(F.col("y") - s["p"]["y"] - t * dy, 2))

    return points.join(arrays, by, "left").select(*by, id, F.array_min(F.transform("segments", to)).alias("distance"))


def shifted(df: DataFrame, offsets: list[tuple[int, ...]], axes: list[str], value: str) -> DataFrame:
    """df with each row repeated for each offset: (offset, place minus offset, value as `other`)."""
    named = F.array(*[F.struct(F.lit(i).alias("offset"), *[F.lit(o).alias(f"d{x}") for x, o in zip(axes, off, strict=True)]) for i, off in enumerate(offsets)])
    out = df.select("*", F.explode(named).alias("o"))
    return out.select(*[c for c in df.columns if c not in axes and c != value], F.col("o.offset").alias("offset"), *[(F.col(x) - F.col(f"o.d{x}")).alias(x) for x in axes], F.col(value).alias("other"))


def neighbours(df: DataFrame, by: list[str], offsets: list[tuple[int, ...]], axes: list[str], value: str = "value") -> DataFrame:
    """(by, axes, value, offset, other): each pixel with its neighbours at the offsets."""
    return df.select(*by, *axes, value).join(shifted(df.select(*by, *axes, value), offsets, axes, value).hint("merge"), [*by, *axes])


def in_polygon(points: DataFrame, polygons: DataFrame, id: str = "id", size: float = 64.0) -> DataFrame:
    """(id, roi) of points whose rounded place lies in a polygon (roi, seq, x, y), by the even-odd rule.

    The edges of one polygon are one array; polygons and points meet in grid cells of the given size.
    """
    from pyspark.sql.window import Window as W

    w = W.partitionBy("roi").orderBy("seq")
    start = F.first(F.struct("x", "y")).over(w)
    edges = polygons.select("roi", F.struct("x", "y").alias("p"), F.coalesce(F.lead(F.struct("x", "y")).over(w), start).alias("q"))
    rois = edges.groupBy("roi").agg(F.collect_list(F.struct("p", "q")).alias("edges"), *[f(f"p.{c}").alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))])
    for c in "xy":
        rois = rois.select("*", F.explode(F.sequence(cell(f"{c}0", size), cell(f"{c}1", size))).alias(f"c_{c}"))
    px, py = F.round(F.col("x")), F.round(F.col("y"))
    crosses = F.size(F.filter("edges", lambda e: ((e["p"]["y"] > py) != (e["q"]["y"] > py)) & (px < (e["q"]["x"] - e["p"]["x"]) * (py - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"])))
    return points.withColumns({"c_x": cell(px, size), "c_y": cell(py, size)}).join(rois.hint("merge"), ["c_x", "c_y"]).where(crosses % 2 == 1).select(id, "roi")
