"""Smaller operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvox.functions import names as N
from tabvox.functions.scalar import morph_predicate
from tabvox.operators import pixels as K
from tabvox.operators.rank import morphology_score
from tabvox.plans.base import query, rounded
from tabvox.plans.joins import GRID, labels
from tabvox.sources.driver import role, role_sql

OBJ = role_sql("objects")


@query(f"{OBJ} SELECT label FROM objects WHERE volume >= 20 AND mean < 0.05")
def b03_morph_predicate(spark, sf):
    return role(spark, sf, "objects").where(morph_predicate("volume>=20, mean<0.05, feret>3", {"volume": "volume", "mean": "mean"})).select("label")


@query(f"WITH {GRID}, n AS (SELECT channel, label FROM labels GROUP BY 1,2 HAVING count(*) BETWEEN 120 AND 200) SELECT channel, z, y, x, label FROM labels WHERE (channel, label) IN (SELECT channel, label FROM n)")
def b11_size_filter(spark, sf):
    return K.size_filter(labels(spark, sf), ["channel"], 120, 200).select("channel", "z", "y", "x", "label")


@query(f"WITH {GRID} SELECT channel, z, y, x, label FROM labels WHERE (channel, label) NOT IN (SELECT channel, label FROM labels GROUP BY 1,2 HAVING count(*) < 135)")
def c22_reject_labels(spark, sf):
    l = labels(spark, sf)
    rejected = l.groupBy("channel", "label").agg(F.count("*").alias("n")).where("n < 135").select("channel", "label")
    return l.join(rejected, ["channel", "label"], "left_anti").select("channel", "z", "y", "x", "label")


@query(f"{OBJ} SELECT label, round(0.35*(1-mean)+0.30*(x/64)+0.20*(y/64)+0.15*(volume/50),9) AS score FROM objects")
def e04_morphology_score(spark, sf):
    return rounded(role(spark, sf, "objects").select("label", morphology_score(F.col("mean"), F.col("x") / 64, F.col("y") / 64, F.col("volume") / 50).alias("score")), 9)


@query("SELECT count(*) AS shared FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag='R')")
def g04_shared_keys(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    l = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    return o.intersect(l).agg(F.count("*").alias("shared"))


@query("SELECT p_partkey, CASE p_partkey%3 WHEN 0 THEN 'LH' WHEN 1 THEN 'RH' END AS hemisphere FROM part")
def h03_hemisphere(spark, sf):
    k = F.col("p_partkey")
    roi = F.when(k % 3 == 0, F.concat(F.lit("roi_lh_"), k)).when(k % 3 == 1, F.concat(F.lit("RHcortex"), k)).otherwise(F.concat(F.lit("mid"), k))
    return spark.read.parquet(f"{sf}/part.parquet").select(k, N.hemisphere_from_roi(roi).alias("hemisphere"))


@query("SELECT c_custkey, CASE c_custkey%3 WHEN 0 THEN 's'||c_custkey WHEN 1 THEN 'roi' ELSE 'region' END AS section FROM customer")
def h05_section_key(spark, sf):
    k = F.col("c_custkey")
    scn = F.when(k % 3 == 0, F.concat(F.lit(" s"), k)).otherwise(F.lit("  "))
    return spark.read.parquet(f"{sf}/customer.parquet").select(k, N.section_key(scn, F.when(k % 3 == 1, "roi"), F.lit("region")).alias("section"))


@query("SELECT p_partkey, CASE WHEN p_partkey%2=0 THEN 'Ch'||p_partkey END AS partner FROM part")
def h08_partner(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("A_VolOverlap30_Ch"), k)).otherwise(F.lit("Volume"))
    return spark.read.parquet(f"{sf}/part.parquet").select(k, N.partner_from_column(name).alias("partner"))


@query("SELECT s_suppkey, n_name||'_'||CAST(s_nationkey AS VARCHAR) AS label FROM supplier JOIN nation ON s_nationkey=n_nationkey")
def h23_group_label(spark, sf):
    s, n = spark.read.parquet(f"{sf}/supplier.parquet"), spark.read.parquet(f"{sf}/nation.parquet")
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.select("s_suppkey", N.group_label([F.col("n_name"), F.lit("  "), F.col("s_nationkey").cast("string")]).alias("label"))
