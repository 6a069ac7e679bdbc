"""Bounds of index blocks: no closer than their entries allow, and closer than sizes and overlaps taken apart."""

from pyspark.sql import functions as F

from tabvox.llm import jaccard_join as J


def test_a_block_is_skipped_if_no_entry_reaches(spark):
    rows = [("a", 100, 50, 0, 7), ("b", 108, 54, 0, 7), ("c", 100, 50, 0, 15), ("d", 108, 54, 0, 15)]
    index = spark.createDataFrame(rows, "key string, n long, have long, pos long, rest long").select(F.struct(F.lit(1).alias("token"), F.lit("p").alias("of"), F.lit(20).cast("long").alias("np")).alias("list"), "*", F.lit(4).cast("long").alias("df"), F.lit(None).cast("string").alias("pivot"), F.col("key").alias("root"))
    blocks = J.in_blocks(index, 85)
    a, b = (blocks.select("list", F.col("b").alias(f"b{x}"), F.col("entries").alias(f"e{x}")) for x in "xy")
    pairs = a.join(b.hint("merge"), "list").withColumn("kept", J._reach("bx", "by", 85, (J._BLOCK, J._BLOCK)))
    pairs = pairs.select("list", "kept", F.explode("ex").alias("x"), "ey").select("list", "kept", "x", F.explode("ey").alias("y"))
    got = {(r["x"]["key"], r["y"]["key"]): (r["kept"], r["reach"]) for r in pairs.withColumn("reach", J._reach("x", "y", 85)).collect()}
    assert len(got) == 16 and all(kept or not reach for kept, reach in got.values())
    assert got["a", "b"] == got["a", "a"] == (False, False)
    # 1 + 15 + 54 + 54 - 20 = 104 >= ceil(85 * 216 / 185) = 100; 1 + 7 + 50 + 54 - 20 = 92 < 96
    assert got["d", "d"] == (True, True)
