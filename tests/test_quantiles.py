"""Percentiles from ranks in ranges, and joins that don't gather a file's rows."""

import pytest
from pyspark.sql import functions as F

from tabvox.operators import rank as R
from tabvox.streaming import ingest


def test_quantiles_as_percentile(spark):
    df = spark.createDataFrame([(g, float(v) if v % 7 else None) for g, n in (("a", 101), ("b", 2), ("c", 40)) for v in range(1, n)], "g string, v double")
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.02), F.lit(0.5), F.lit(0.98))).alias("q")).collect()}
    assert {r["g"]: r["q"] for r in R.quantiles(df, ["g"], "v", [0.02, 0.5, 0.98]).collect()} == {g: pytest.approx(q) for g, q in want.items()}


def test_newest_does_not_shuffle_by_file(spark):
    state = spark.createDataFrame([("r", "f", n, v) for n in (0, 1) for v in range(5)], "run_id string, file string, batch int, v int")
    got = ingest.newest(state)
    assert {r["batch"] for r in got.collect()} == {1} and got.count() == 5
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
