"""Checks of a study's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def homogeneity(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value, usual): rows whose value of a field isn't the most frequent one (ties: the smallest)."""
    long = df.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([key], fields, "field", "value").where("value IS NOT NULL")
    usual = long.groupBy("field", "value").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "value"))).where("r = 1").select("field", F.col("value").alias("usual"))
    return long.join(usual.hint("shuffle_hash"), "field").where("value <> usual")


def condition_health(df: DataFrame, animal: str, condition: str, least: int = 3) -> DataFrame:
    """(condition, animals, problem): groups with few animals, and how many animals have none."""
    g = df.groupBy(F.coalesce(F.nullif(F.trim(condition), F.lit("")), F.lit("(none)")).alias("condition")).agg(F.countDistinct(animal).alias("animals"))
    return g.withColumn("problem", F.when(F.col("condition") == "(none)", "no condition").when(F.col("animals") < least, "few animals"))


def completeness(expected: DataFrame, present: DataFrame, keys: list[str], step: str) -> DataFrame:
    """(step, expected, missing) counts."""
    e = expected.groupBy(step).agg(F.count("*").alias("expected"))
    m = expected.join(present.select(*keys).distinct(), keys, "left_anti").groupBy(step).agg(F.count("*").alias("missing"))
    return e.join(m, step, "left").withColumn("missing", F.coalesce("missing", F.lit(0)))


def run_summary(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(table, rows, keys, blank): counts of each table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.count(F.when(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == ""), 1)).alias("blank")).select(F.lit(name).alias("table"), "rows", "keys", "blank")
        out = one if out is None else out.union(one)
    return out


def parameter_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, before, after) of flattened (path, value) records that differ; numbers are compared as numbers."""
    j = old.withColumnRenamed("value", "before").join(new.withColumnRenamed("value", "after"), "path", "full")
    a, b = F.col("before").try_cast("double"), F.col("after").try_cast("double")
    return j.where(~F.coalesce(a == b, F.col("before").eqNullSafe(F.col("after"))))


def file_fingerprints(spark, path: str) -> DataFrame:
    """(path, length, hash) of the files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("hash"))


def duplicate_files(files: DataFrame) -> DataFrame:
    """(hash, n, first) of contents that several files have; the length is compared first."""
    return files.groupBy("length", "hash").agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 1").drop("length")
