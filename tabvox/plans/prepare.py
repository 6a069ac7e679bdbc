"""Preparation, masks and corrections in order over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvox.operators import prepare as Q
from tabvox.plans.base import query, rounded
from tabvox.plans.corrections import CORR, _target
from tabvox.plans.joins import GRID
from tabvox.plans.pixels import SKEL, G, _flat, _skeleton
from tabvox.sources.driver import role, role_sql

OBJ = role_sql("objects")


@query(f"{OBJ} SELECT label, CASE WHEN marker=1 THEN x*3 ELSE round(x*0.5,4) END AS xm_um, round(y*0.25,4) AS ym_um FROM objects")
def b05_calibrate(spark, sf):
    o = role(spark, sf, "objects").select("label", "x", "y", F.when(F.col("marker") == 1, F.col("x") * 3).alias("xm_um"))
    return rounded(Q.calibrate_centroids(o, {"xm_um": "x", "ym_um": "y"}, {"xm_um": 0.5, "ym_um": 0.25}).select("label", "xm_um", "ym_um"))


@query(f"{OBJ} SELECT label, CASE WHEN overlap>40 THEN 1 ELSE 0 END AS overlap_flag, CASE WHEN x>=40 THEN 1 ELSE 0 END AS x_flag FROM objects")
def b06_threshold_flags(spark, sf):
    return Q.threshold_flags(role(spark, sf, "objects").select("label", "overlap", "x"), ["overlap"], ["x"], 40.0).select("label", "overlap_flag", "x_flag")


@query(f'{OBJ} SELECT label, coalesce(CASE WHEN marker=1 THEN surface END, mean) AS "Morph_Area_um2", intden AS "IntDen_Unfiltered" FROM objects')
def b07_rename_legacy(spark, sf):
    o = role(spark, sf, "objects").select("label", F.when(F.col("marker") == 1, F.col("surface")).alias("Morph_Area_um2"), F.col("mean").alias("Area_um2"), F.col("intden").alias("RawIntDen"))
    return Q.rename_legacy(o)


@query(f"{OBJ} SELECT label, channel||'_'||animal AS metric FROM objects")
def b08_prefix(spark, sf):
    metric = F.when(F.col("marker") == 1, F.concat("channel", F.lit("_"), "animal")).otherwise(F.col("animal"))
    return role(spark, sf, "objects").select("label", Q.prefixed(F.col("channel"), metric).alias("metric"))


@query(f"WITH {GRID} SELECT channel, z, y, x, round(value,4) AS value FROM voxels WHERE z BETWEEN 2 AND 4")
def b09_z_subset(spark, sf):
    return rounded(Q.z_subset(role(spark, sf, "voxels"), 2, 4))


@query("SELECT o_orderstatus AS metric, count(*) AS n FROM orders WHERE o_orderstatus IN ('F','P') GROUP BY 1")
def b12_metric_filter(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumnRenamed("o_orderstatus", "metric")
    return Q.restrict_metrics(o, ["F", "P"]).groupBy("metric").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS metric, count(*) AS n FROM orders GROUP BY 1")
def b12_metric_filter_none(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumnRenamed("o_orderstatus", "metric")
    return Q.restrict_metrics(o, ["no such metric"]).groupBy("metric").agg(F.count("*").alias("n"))


@query(f"{G} SELECT channel, y, x FROM flat WHERE value >= 25")
def k02_threshold_mask(spark, sf):
    return Q.threshold_mask(_flat(spark, sf), 25).select("channel", "y", "x")


@query(f"{G} SELECT a.y, a.x, round(greatest(a.value-b.value,0),4) AS value FROM flat a JOIN flat b ON a.channel='A' AND b.channel='R' AND a.y=b.y AND a.x=b.x")
def k04_subtract(spark, sf):
    v = _flat(spark, sf)
    return rounded(Q.subtract_images(v.where("channel = 'A'"), v.where("channel = 'R'"), ["y", "x"]))


@query(f"{G} SELECT y, x FROM flat WHERE channel='A' AND value>=25 INTERSECT SELECT y, x FROM flat WHERE channel='R' AND value>=25")
def k04_and(spark, sf):
    m = Q.threshold_mask(_flat(spark, sf), 25)
    return Q.and_images(m.where("channel = 'A'"), m.where("channel = 'R'"), ["y", "x"])


@query(f"{G} SELECT channel, count(*) AS n, round(sum(value),3) AS total FROM flat WHERE channel<>'N' AND (y, x) IN (SELECT (y, x) FROM flat WHERE channel='N' AND value>=25) GROUP BY 1")
def k05_channel_mask(spark, sf):
    v = _flat(spark, sf)
    inside = Q.within_mask(v.where("channel <> 'N'"), Q.threshold_mask(v.where("channel = 'N'"), 25), ["y", "x"])
    return rounded(inside.groupBy("channel").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 3)


@query(
    f"{CORR}, f AS (SELECT sum(target*c1)/sum(c1*c1) k FROM v WHERE target<=300 AND greatest(target,c1)<480), one AS (SELECT y, x, c1, round(least(65535,greatest(0,target-greatest(0,coalesce(k,0))*c1))) AS target FROM v, f), "
    "two AS (SELECT y, x, c1, CASE WHEN target>=20 THEN target ELSE 0 END AS target FROM one), g AS (SELECT sum(target*c1)/sum(c1*c1) k FROM two WHERE target<=150 AND greatest(target,c1)<480) SELECT y, x, round(least(65535,greatest(0,target-greatest(0,coalesce(k,0))*c1))) AS target FROM two, g"
)
def k38_correction_pipeline(spark, sf):
    steps = [("global_ratio", {"quiet": 300.0, "saturated": 480.0}), ("threshold", {"least": 20.0}), ("global_ratio", {"quiet": 150.0, "saturated": 480.0})]
    return Q.correct(_target(spark, sf), ["g"], steps).select("y", "x", "target")


@query(f"{SKEL} SELECT channel, round(count(*)*cbrt(2.0),4) AS length FROM s GROUP BY 1")
def k44_process_length(spark, sf):
    return rounded(Q.process_length(_skeleton(spark, sf), ["channel"], 2.0))
