"""Cut the lineage of loops, and join with small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast.
FEW = 100_000


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir; where that is unset a local session gets one of its own, and a cluster an error."""
    context = df.sparkSession.sparkContext
    if not (context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="tabvox-"))
    return df.checkpoint()


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, computed once, with a broadcast hint if it has at most so many rows; else it is joined by sort and merge."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df.hint("merge")
