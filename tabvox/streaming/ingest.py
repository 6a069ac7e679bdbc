"""Incremental ingest: measurement files that arrive over time update stored partial aggregates.

The state holds mergeable sums of each run, file and section: a batch of files writes a folder of its own,
and readers merge. So a run may come in any number of files, batches and orders, a batch that is run again
leaves the same state, and a file that is sent again under its name replaces what it gave before. Grouping
is by animal, not by time, so late files need no watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabvox.functions.lineage import few


def partials(df: DataFrame, by: list[str], values: dict[str, Column], run: str = "run_id", file: str = "file", section: str = "section") -> DataFrame:
    """Sums of each run, file, section and group: rows, and of each named value its count, sum, least and greatest; nulls don't count."""
    sums = [f(v).alias(f"{name}_{kind}") for name, v in values.items() for kind, f in (("n", F.count), ("sum", F.sum), ("min", F.min), ("max", F.max))]
    return df.groupBy(F.col(run).alias("run_id"), F.col(file).alias("file"), F.col(section).alias("section"), *by).agg(F.count("*").alias("rows"), *sums)


def newest(state: DataFrame) -> DataFrame:
    """Of each run and file the rows of the last batch that brought it."""
    last = state.groupBy("run_id", "file").agg(F.max("batch").alias("batch"))
    # a join by sort would bring all rows of a file into one task
    return state.join(few(last), ["run_id", "file", "batch"])


def merged(state: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by, runs, sections, count, <value>_total, _mean, _min, _max) over all runs; a section that several runs or files hold counts once."""
    out = [F.countDistinct("run_id").alias("runs"), F.countDistinct("section").alias("sections"), F.sum("rows").alias("count")]
    for v in values:
        total, n = F.sum(f"{v}_sum"), F.sum(f"{v}_n")
        out += [total.alias(f"{v}_total"), F.when(n > 0, total / n).alias(f"{v}_mean"), F.min(f"{v}_min").alias(f"{v}_min"), F.max(f"{v}_max").alias(f"{v}_max")]
    return state.groupBy(*by).agg(*out)


def start(spark: SparkSession, source: str, schema: StructType, state: str, checkpoint: str, by: list[str], values: dict[str, Column], trigger: dict | None = None, where: str | None = None, **options: str):
    """A streaming query from Parquet files in source to the state.

    where: rows to keep, such as those of found objects. options go to the file source, as
    maxFilesPerTrigger does. A file's name tells it from others, wherever it lies.
    """

    def batch(df: DataFrame, number: int) -> None:
        partials(df, by, values).write.mode("overwrite").parquet(f"{state.rstrip('/')}/batch={number}")

    stream = spark.readStream.schema(schema).options(**options).option("recursiveFileLookup", "true").parquet(source)
    stream = stream.select("*", F.col("_metadata.file_name").alias("file"))
    stream = stream.where(where) if where else stream
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """The state's rows that count; one state path belongs to one checkpoint."""
    return newest(spark.read.parquet(state))

