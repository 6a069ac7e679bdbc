"""Places of rows in the order of their group, counted over ranges of the order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabvox.llm.textbytes import table

#: Up to so many ranges and groups their counts are broadcast; more are joined by shuffle.
FEW = 200_000


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df, written out, with pos (from 0, in order within its group) and total (rows of the group).

    Rows are dealt by ranges of (group, order), so a group of any size lies in many ranges; each range
    numbers its own rows, and sums of the ranges before give the rest. Nulls come first. Rows that are
    equal in group and order are dealt and numbered by where they were read, each once. df must not
    have columns named pos, total, range_ or at_.
    """
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("at_").asc()]
    dealt = df.withColumn("at_", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at_", F.monotonically_increasing_id())
    dealt = table(dealt.withColumns({"range_": F.shiftright("at_", 33), "at_": F.col("at_").bitwiseAND((1 << 33) - 1)}), name)
    counts = dealt.groupBy(group, "range_").agg(F.count("*").alias("n_"), F.min("at_").alias("least_"))
    before = W.partitionBy(group).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("group_"), F.col("range_").alias("part_"), (F.coalesce(F.sum("n_").over(before), F.lit(0)) - F.col("least_")).alias("shift_"), F.sum("n_").over(W.partitionBy(group)).alias("total"))
    starts = table(starts, f"{name}-ranges")
    starts = F.broadcast(starts) if starts.count() <= FEW else starts.hint("shuffle_hash")
    out = dealt.join(starts, F.col(group).eqNullSafe(F.col("group_")) & (F.col("range_") == F.col("part_")))
    return out.withColumn("pos", F.col("at_") + F.col("shift_")).drop("group_", "part_", "range_", "at_", "shift_")
