"""Ingest of runs in any number of files, and published tables that survive a failed write."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from tabvox.operators.aggregate import master_objects
from tabvox.sources import tables as T
from tabvox.streaming import ingest

SCHEMA = "run_id string, section string, animal string, channel string, volume double, intden double"
ROWS = [(f"r{i % 2}", f"s{i % 3}", "ab"[i % 2], "cd"[i % 5 == 0], None if i == 7 else float(i), 10.0 * i) for i in range(20)]
BY = ["animal", "channel"]


def values():
    return {"volume": F.col("volume"), "intden": F.col("intden")}


def write(spark, rows, folder, name):
    """One Parquet file under the given name."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}-draft-{name}")
    part = next(f for f in os.listdir(f"{folder}-draft-{name}") if f.startswith("part-"))
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{folder}-draft-{name}/{part}", f"{folder}/{name}.parquet")


def run(spark, src, state, ck, **options):
    schema = spark.createDataFrame([], SCHEMA).schema
    ingest.start(spark, src, schema, state, ck, BY, values(), **options).awaitTermination()
    return ingest.merged(ingest.read_state(spark, state), BY, ["volume", "intden"])


def plain(df):
    return sorted(tuple(r) for r in df.collect())


def test_any_split_and_order_gives_the_sums_of_one_batch(spark, tmp_path):
    whole = spark.createDataFrame(ROWS, SCHEMA).withColumn("file", F.lit("all"))
    want = plain(ingest.merged(ingest.partials(whole, BY, values()), BY, ["volume", "intden"]))
    for k, (cuts, order) in enumerate(itertools.product([(5, 12), (1, 19)], [(0, 1, 2), (2, 0, 1)])):
        src, state, ck = (str(tmp_path / f"{d}{k}") for d in ("src", "state", "ck"))
        parts = [ROWS[: cuts[0]], ROWS[cuts[0] : cuts[1]], ROWS[cuts[1] :]]
        for i in order:  # a batch after each file
            write(spark, parts[i], src, f"f{i}")
            got = run(spark, src, state, ck)
        assert plain(got) == want
        assert plain(run(spark, src, state, ck)) == want  # nothing new: nothing changes


def test_files_of_one_batch_each_and_a_file_sent_again(spark, tmp_path):
    src, state, ck = (str(tmp_path / d) for d in ("src", "state", "ck"))
    write(spark, ROWS[:10], src, "one")
    write(spark, ROWS[10:], src, "two")
    run(spark, src, state, ck, maxFilesPerTrigger="1")
    assert spark.read.parquet(state).select("batch").distinct().count() == 2
    write(spark, ROWS[:4], f"{src}/again", "one")  # the corrected file has fewer rows
    got = run(spark, src, state, ck)
    kept = spark.createDataFrame(ROWS[:4] + ROWS[10:], SCHEMA).withColumn("file", F.lit("x"))
    assert plain(got) == plain(ingest.merged(ingest.partials(kept, BY, values()), BY, ["volume", "intden"]))


def test_merged_state_equals_the_master_table(spark):
    df = spark.createDataFrame([r for r in ROWS if r[4]], SCHEMA).withColumn("file", F.col("section"))
    got = {(r["animal"], r["channel"]): r for r in ingest.merged(ingest.partials(df, BY, values()), BY, ["volume", "intden"]).collect()}
    own = df.withColumns({c: F.lit(1.0) for c in ("surface", "mean", "x", "y", "z")})
    for r in master_objects(own, BY).collect():
        m = got[r["animal"], r["channel"]]
        assert (m["count"], m["volume_total"], m["intden_total"], m["volume_mean"]) == (r["count"], r["volume_total"], r["intden_total"], r["volume_mean"])


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_publish_replaces_in_one_step(spark, tmp_path, fmt):
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        T.read_published(spark, path)
    first = spark.createDataFrame([("=1+1", 1), ("a\nb", 2)], "c string, n int")
    T.publish(first, path, fmt)
    assert {str(r[0]) for r in T.read_published(spark, path).collect()} == {"'=1+1", "a\nb"}
    old = T.read_published(spark, path)
    T.publish(first.where("n = 2"), path, fmt)
    assert T.read_published(spark, path).count() == 1 and old.count() == 2  # who reads the old version goes on
    for n in range(3):
        T.publish(first, path, fmt)
    assert len([f for f in os.listdir(path) if not f.startswith((".", "_"))]) == 2


def test_a_failed_publish_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "out")
    good = spark.createDataFrame([(1,), (2,)], "n int")
    T.publish(good, path, "parquet")
    with pytest.raises(ValueError):
        T.publish(good.where("false"), path, "parquet", least=1)
    with pytest.raises(Exception):
        T.publish(good.select(F.assert_true(F.col("n") < 2).alias("n")), path, "parquet")
    assert {r[0] for r in T.read_published(spark, path).collect()} == {1, 2}
    T.publish(good.where("false"), path, "parquet")
    assert T.read_published(spark, path).count() == 0
