"""Where SQL left rows or ties to chance."""

from compare import connect, rows
from pyspark.sql import functions as F

from tabvox import registry
from tabvox.sources.driver import role

SF = "/root/testdata/sf0.001"


def _tables(spark, path, **changed):
    import os

    for t in os.listdir(SF):
        name = t.removesuffix(".parquet")
        if name in changed:
            changed[name].coalesce(1).write.parquet(f"{path}/{name}.tmp")
            part = next(f for f in os.listdir(f"{path}/{name}.tmp") if f.endswith(".parquet"))
            os.rename(f"{path}/{name}.tmp/{part}", f"{path}/{t}")
        else:
            os.symlink(f"{SF}/{t}", f"{path}/{t}")
    return str(path)


def test_equal_means_are_equal_numbers(spark, tmp_path):
    prices = [(1, 0.1), (1, 0.2), (1, 0.3), (2, 0.3), (2, 0.2), (2, 0.1)]
    orders = spark.createDataFrame([(s, "F", "1-URGENT", p) for s, p in prices], "o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double")
    sf = _tables(spark, tmp_path, orders=orders)
    assert [r["value"] for r in role(spark, sf, "samples").collect()] == [0.6 / 3] * 2


def test_no_shells_no_row(spark, tmp_path):
    low = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_quantity", F.lit(1.0))
    sf = _tables(spark, tmp_path, lineitem=low)
    duck = connect(sf)
    for name in ("k12_shell_summary", "k39_threshold_sweep"):
        df, want = registry.queries()[name](spark, sf), duck.sql(registry.oracle_sql()[name])
        assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
