"""Checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvox.operators import quality as Q
from tabvox.plans.base import query, rounded
from tabvox.sources import tables as T
from tabvox.sources.driver import role, role_sql
from tabvox.streaming import ingest

OBJ = role_sql("objects")


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("WITH l AS (SELECT p_partkey, 'p_brand' AS field, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part), u AS (SELECT field, value AS usual FROM (SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) r FROM l GROUP BY 1,2) WHERE r=1) SELECT p_partkey, field, value, usual FROM l JOIN u USING (field) WHERE value<>usual")
def l04_homogeneity(spark, sf):
    return Q.homogeneity(_read(spark, sf, "part"), "p_partkey", ["p_brand", "p_size"])


@query("SELECT c_mktsegment AS condition, count(DISTINCT c_custkey) AS animals, CASE WHEN count(DISTINCT c_custkey)<3 THEN 'few animals' END AS problem FROM customer GROUP BY 1")
def l05_condition_health(spark, sf):
    return Q.condition_health(_read(spark, sf, "customer"), "c_custkey", "c_mktsegment")


@query("SELECT o_orderpriority AS step, count(*) AS expected, count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='R')) AS missing FROM orders GROUP BY 1")
def l10_completeness(spark, sf):
    o = _read(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("step"))
    done = _read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return Q.completeness(o, done, ["o_orderkey"], "step")


@query("SELECT 'customer' AS \"table\", count(*) AS rows, count(DISTINCT c_name) AS keys, 0::BIGINT AS blank FROM customer UNION ALL SELECT 'part', count(*), count(DISTINCT p_name), 0 FROM part".replace("AS rows", 'AS "rows"').replace("AS keys", 'AS "keys"'))
def l09_run_summary(spark, sf):
    return Q.run_summary({"customer": _read(spark, sf, "customer").withColumnRenamed("c_name", "k"), "part": _read(spark, sf, "part").withColumnRenamed("p_name", "k")}, "k")


@query("SELECT coalesce(CAST(a.o_custkey AS VARCHAR), CAST(b.o_custkey AS VARCHAR)) AS path, CAST(a.n AS VARCHAR) AS before, CAST(b.n AS VARCHAR) AS after FROM (SELECT o_custkey, count(*) n FROM orders WHERE o_orderkey%2=0 GROUP BY 1) a FULL JOIN (SELECT o_custkey, count(*) n FROM orders WHERE o_orderkey%3=0 GROUP BY 1) b ON a.o_custkey=b.o_custkey WHERE a.n IS DISTINCT FROM b.n")
def l07_parameter_diff(spark, sf):
    one = lambda k: _read(spark, sf, "orders").where(f"o_orderkey % {k} = 0").groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.count("*").cast("string").alias("value"))
    return Q.parameter_diff(one(2), one(3))


@query(f"{OBJ} SELECT animal, channel, count(DISTINCT run_id) AS runs, count(DISTINCT section) AS sections, count(*) AS count, round(sum(volume),3) AS volume_total, round(avg(volume),4) AS volume_mean, min(volume) AS volume_min, max(volume) AS volume_max, round(sum(intden),2) AS intden_total, round(avg(intden),4) AS intden_mean, min(intden) AS intden_min, max(intden) AS intden_max FROM objects WHERE volume > 0 GROUP BY 1,2".replace("AS count", 'AS "count"'))
def m01_incremental_merge(spark, sf):
    """The objects of each run come as two files in two batches; the first file comes again later."""
    o = role(spark, sf, "objects").where("volume > 0")
    by, values = ["animal", "channel"], {"volume": F.col("volume"), "intden": F.col("intden")}
    batch = lambda n, half: ingest.partials(o.where(F.pmod(F.xxhash64("label"), F.lit(2)) == half).withColumn("file", F.lit(f"objects-{half}")), by, values).withColumn("batch", F.lit(n))
    state = batch(0, 0).unionByName(batch(1, 1)).unionByName(batch(2, 0))
    out = ingest.merged(ingest.newest(state), by, ["volume", "intden"])
    return rounded(out).withColumns({"volume_total": F.round("volume_total", 3), "intden_total": F.round("intden_total", 2)})


@query("SELECT DISTINCT c_name AS animal FROM customer UNION SELECT DISTINCT p_name FROM part")
def a12_collect_animals(spark, sf):
    return T.collect_animals([_read(spark, sf, "customer").withColumnRenamed("c_name", "Animal Name"), _read(spark, sf, "part").withColumnRenamed("p_name", "AnimalName")])


@query("SELECT vec_id, len(embedding) AS n, round(embedding[1]::DOUBLE,5) AS first FROM embeddings".replace("AS first", 'AS "first"'))
def a15_curves(spark, sf):
    rows = T.curves_to_rows(_read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("c")), ["vec_id"], "c")
    return rounded(T.rows_to_curves(rows, ["vec_id"]).select("vec_id", F.size("curve").cast("long").alias("n"), F.col("curve")[0].alias("first")), 5)
