"""Preparation of measurement tables, masks of images, and corrections in a chosen order."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvox.operators import corrections as C

#: Names that older tables give to columns.
LEGACY_NAMES = {"RawIntDen": "IntDen_Unfiltered", "Area_um2": "Morph_Area_um2"}


def rename_legacy(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Old column names made new; where the new column exists too, the old one only fills its nulls."""
    for old, new in (LEGACY_NAMES if names is None else names).items():
        if old in df.columns and new in df.columns:
            df = df.withColumn(new, F.coalesce(F.col(f"`{new}`"), F.col(f"`{old}`"))).drop(old)
        elif old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def calibrate_centroids(df: DataFrame, axes: dict[str, str], scale: dict[str, float]) -> DataFrame:
    """Fill calibrated places (axes: calibrated -> raw column) from raw ones by scale where they are missing; present ones stay."""
    return df.withColumns({um: (F.coalesce(F.col(um), F.col(raw) * scale[um]) if um in df.columns else F.col(raw) * scale[um]) for um, raw in axes.items()})


def threshold_flags(df: DataFrame, volumetric: list[str], boxes: list[str], threshold: float = 30.0) -> DataFrame:
    """Add <column>_flag: 1 where a volumetric overlap exceeds the threshold, or a box overlap reaches it; null counts as 0."""
    flags = {f"{c}_flag": F.coalesce((F.col(c) > threshold).cast("int"), F.lit(0)) for c in volumetric}
    return df.withColumns(flags | {f"{c}_flag": F.coalesce((F.col(c) >= threshold).cast("int"), F.lit(0)) for c in boxes})


def prefixed(channel: Column, metric: Column) -> Column:
    """channel_metric, or metric where it has that prefix already or there is no channel."""
    prefix = F.concat(channel, F.lit("_"))
    return F.when(channel.isNull() | (channel == "") | metric.startswith(prefix), metric).otherwise(F.concat(prefix, metric))


def z_subset(voxels: DataFrame, first: int, last: int, z: str = "z") -> DataFrame:
    """Slices first to last, both included, counted from 1; last before first, or first below 1, is an error."""
    if not 1 <= first <= last:
        raise ValueError(f"no such slices: {first}-{last}")
    return voxels.where(F.col(z).between(first, last))


def restrict_metrics(df: DataFrame, metrics: list[str], column: str = "metric") -> DataFrame:
    """Rows of the metrics named; where no row has one (or none is named), all rows, with a warning."""
    chosen = df.where(F.col(column).isin(metrics)) if metrics else df.where(F.lit(False))
    if metrics and not chosen.isEmpty():
        return chosen
    if metrics:
        warnings.warn(f"none of {metrics} occurs: all metrics are kept", stacklevel=2)
    return df


def threshold_mask(voxels: DataFrame, threshold: float) -> DataFrame:
    """Places whose value reaches the threshold."""
    return voxels.where(F.col("value") >= threshold).drop("value")


def within_mask(voxels: DataFrame, mask: DataFrame, on: list[str]) -> DataFrame:
    """Voxels whose place is in the mask, such as another channel's; a place that the mask repeats counts once."""
    return voxels.join(mask.select(*on), on, "left_semi")


def subtract_images(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """(on, value): a less b at the places that both have, at least 0."""
    return a.select(*on, F.col("value").alias("__a")).join(b.select(*on, F.col("value").alias("__b")), on).select(*on, F.greatest(F.col("__a") - F.col("__b"), F.lit(0.0)).alias("value"))


def and_images(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Places that two masks share, each once."""
    return a.select(*on).join(b.select(*on), on, "left_semi").distinct()


#: Corrections by name: (voxels, by, settings) -> voxels with the target replaced.
FEATURES: dict[str, Callable[..., DataFrame]] = {}


def feature(name: str):
    """Register a correction: a function (voxels, by, **settings) that returns voxels with a new target."""

    def add(f):
        FEATURES[name] = f
        return f

    return add


@feature("global_ratio")
def _global(voxels: DataFrame, by: list[str], **settings) -> DataFrame:
    return C.global_ratio(voxels, by, **settings).drop("target").withColumnRenamed("corrected", "target")


@feature("local_ratio")
def _local(voxels: DataFrame, by: list[str], **settings) -> DataFrame:
    return C.local_ratio(voxels, by, **settings).drop("target").withColumnRenamed("corrected", "target")


@feature("envelope")
def _envelope(voxels: DataFrame, by: list[str], **settings) -> DataFrame:
    return C.envelope(voxels, by, **settings).drop("target").withColumnRenamed("adjusted", "target")


@feature("threshold")
def _threshold(voxels: DataFrame, by: list[str], least: float) -> DataFrame:
    return voxels.withColumn("target", F.when(F.col("target") >= least, F.col("target")).otherwise(0.0))


def correct(voxels: DataFrame, by: list[str], steps: list[tuple[str, dict]]) -> DataFrame:
    """Registered corrections with their settings, in the order given; each takes what the one before it left."""
    unknown = [name for name, _ in steps if name not in FEATURES]
    if unknown:
        raise KeyError(f"no such correction: {unknown}")
    for name, settings in steps:
        voxels = voxels.transform(FEATURES[name], by, **settings)
    return voxels


def process_length(skeleton: DataFrame, by: list[str], voxel_volume: float = 1.0) -> DataFrame:
    """(by, length): skeleton voxels times the edge of a cube of a voxel's volume."""
    return skeleton.groupBy(*by).agg((F.count("*") * float(voxel_volume) ** (1 / 3)).alias("length"))
