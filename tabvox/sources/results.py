"""Saved result tables: read them again, refresh their conditions, summarise corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: beginnings and names of files that systems leave beside data
JUNK_PREFIXES = (".", "~$", "_")
JUNK_NAMES = ("thumbs.db", "desktop.ini", "icon\r")


def junk_file(name: Column) -> Column:
    """True for hidden files and those that operating systems or editors leave; for a null name too."""
    low = F.lower(name)
    hit = low.isin(*JUNK_NAMES) | low.endswith(".tmp") | low.endswith("~")
    for p in JUNK_PREFIXES:
        hit = hit | low.startswith(p)
    return F.coalesce(hit, F.lit(True))


def ordered(df: DataFrame, first: list[str]) -> DataFrame:
    """Columns in the order given, as far as they are there; then all others in their own order."""
    known = [c for c in first if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in known + [c for c in df.columns if c not in known]])


def refresh_conditions(master: DataFrame, conditions: DataFrame, animal: str = "animal") -> DataFrame:
    """A saved master table with its condition columns made anew from (animal, axis, value); nothing else changes."""
    from tabvox.operators.joins import condition_join

    stale = [c for c in master.columns if c.lower() == "condition" or c.lower().startswith("condition_")]
    return condition_join(master.drop(*stale), conditions, animal)


def load_statistic(results: DataFrame, keys: list[str], metric: str, series: DataFrame) -> DataFrame:
    """series with value: the mean of a numeric column of a result table over the rows of the same keys; null without one."""
    from tabvox.functions.scalar import finite

    means = results.groupBy(*keys).agg(F.avg(finite(F.col(f"`{metric}`"))).alias("value"))
    return series.join(means, keys, "left")


def json_fields(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Add the fields of a JSON column, as settings of channels are kept; null where the text isn't such JSON."""
    return df.withColumn("__j", F.from_json(column, schema)).select("*", "__j.*").drop("__j")


def correction_summary(corrected: DataFrame, by: list[str], before: str, after: str) -> DataFrame:
    """(by, pixels, before, after, removed_pct, zeroed): what a correction took off each section."""
    a, b = F.sum(after), F.sum(before)
    return corrected.groupBy(*by).agg(
        F.count("*").alias("pixels"),
        F.avg(before).alias("before"),
        F.avg(after).alias("after"),
        F.when(b != 0, 100 * (b - a) / b).alias("removed_pct"),
        F.sum(((F.col(before) > 0) & (F.col(after) <= 0)).cast("long")).alias("zeroed"),
    )
