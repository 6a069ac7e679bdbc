"""Master tables and summaries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvox.operators import aggregate as A
from tabvox.plans.base import query, rounded
from tabvox.sources.driver import role, role_sql

OBJ = role_sql("objects")
GOOD = f"{OBJ}, good AS (SELECT * FROM objects WHERE volume > 0 AND trim(animal) <> '')"
MASTER = "count(*) AS count, round(sum(volume),4) AS volume_total, round(sum(surface),4) AS surface_total, round(sum(intden),4) AS intden_total, round(avg(volume),4) AS volume_mean, round(avg(mean),4) AS mean_mean, round(avg(surface/volume),4) AS sa_v_mean, round(avg(x),4) AS x_mean, round(avg(y),4) AS y_mean, round(avg(z),4) AS z_mean"


@query(f"{GOOD} SELECT animal, channel, {MASTER} FROM good GROUP BY animal, channel")
def d04_master_objects(spark, sf):
    return rounded(A.master_objects(role(spark, sf, "objects"), ["animal", "channel"]))


@query(f"{GOOD} SELECT animal, channel, round(avg(overlap),4) AS overlap_mean, count(*) FILTER (overlap > 30) AS coloc_n, round(100.0*count(*) FILTER (overlap > 30)/count(*),4) AS coloc_pct, count(*) FILTER (NOT overlap > 30) AS non_coloc_n FROM good GROUP BY animal, channel")
def d05_coloc_summary(spark, sf):
    return rounded(A.coloc_summary(role(spark, sf, "objects"), ["animal", "channel"]))


@query(
    f"""{OBJ}, long AS (SELECT animal, 'volume' AS metric, volume AS value FROM objects UNION ALL SELECT animal, 'mean', mean FROM objects UNION ALL SELECT animal, 'marker', marker FROM objects),
 s AS (SELECT animal, metric, sum(value) t, avg(value) m FROM long GROUP BY 1, 2),
 c AS (SELECT animal, cluster v, count(*) n, row_number() OVER (PARTITION BY animal ORDER BY count(*) DESC, cluster) r FROM objects GROUP BY 1, 2)
 SELECT animal, metric, 'mean' AS stat, round(m,4) AS value FROM s WHERE metric <> 'marker' UNION ALL SELECT animal, metric, 'count', round(t,4) FROM s WHERE metric = 'marker'
 UNION ALL SELECT animal, metric, 'pct', round(100*m,4) FROM s WHERE metric = 'marker' UNION ALL SELECT animal, 'cluster', 'mode', v FROM c WHERE r = 1"""
)
def d06_metric_rollup(spark, sf):
    return rounded(A.metric_rollup(role(spark, sf, "objects"), ["animal"], ["volume", "mean", "marker", "cluster"]))


@query(f"{OBJ} SELECT animal, mode FROM (SELECT animal, CAST(cluster AS BIGINT) AS mode, row_number() OVER (PARTITION BY animal ORDER BY count(*) DESC, cluster) r FROM objects GROUP BY animal, cluster) WHERE r = 1")
def d07_modal(spark, sf):
    return A.modal(role(spark, sf, "objects"), ["animal"], "cluster")


@query(f"{OBJ} SELECT animal, cluster AS class, round(count(*)/sum(count(*)) OVER (PARTITION BY animal),4) AS fraction FROM objects WHERE cluster >= 0 GROUP BY animal, cluster")
def d08_class_fraction(spark, sf):
    return rounded(A.class_fractions(role(spark, sf, "objects"), ["animal"], "cluster"))


@query(f"{OBJ} SELECT animal, round(avg(m),4) AS value FROM (SELECT animal, section, avg(volume) m FROM objects GROUP BY 1, 2) GROUP BY animal")
def d11_mean_of_section_means(spark, sf):
    return rounded(A.mean_of_means(role(spark, sf, "objects"), ["animal"], "section", "volume"))


@query(f"{GOOD} SELECT animal, channel, section, count(*) AS n, round(sum(volume),4) AS volume_total, CAST(grouping(animal)*4+grouping(channel)*2+grouping(section) AS BIGINT) AS level FROM good GROUP BY GROUPING SETS ((animal), (animal, channel), (animal, channel, section))")
def d12_granularity_sets(spark, sf):
    return rounded(A.granularity_sets(A.drop_placeholders(role(spark, sf, "objects")), [["animal"], ["animal", "channel"], ["animal", "channel", "section"]], [F.count("*").alias("n"), F.sum("volume").alias("volume_total")]).withColumn("level", F.col("level").cast("long")))


@query(f"{OBJ} SELECT animal, count(DISTINCT section) AS num_sections FROM objects GROUP BY animal")
def d13_sections(spark, sf):
    return A.distinct_sections(role(spark, sf, "objects"), "animal", ["section", "channel"])


VOLUMES = "volumes AS (SELECT 'A'||s_suppkey AS animal, avg(CASE WHEN s_acctbal > 0 THEN s_acctbal/1000 END) AS volume_mm3 FROM supplier GROUP BY 1)"


def _volumes(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    rois = s.select(F.concat(F.lit("A"), F.col("s_suppkey")).alias("animal"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 1000).alias("volume_mm3"), *[F.lit(None).cast("double").alias(c) for c in ("area_um2", "depth_um", "area_px", "pixel_um")])
    return A.roi_volumes(rois, "animal")


@query(
    f"""{GOOD}, {VOLUMES}, n AS (SELECT animal, count(DISTINCT section) AS num_sections FROM objects GROUP BY 1),
 m AS (SELECT animal, channel, count(*) AS count, sum(volume) AS volume_total FROM good GROUP BY 1, 2)
 SELECT m.animal, channel, count, round(volume_total,4) AS volume_total, round(count/num_sections/volume_mm3,4) AS count_permm3, round(volume_total/num_sections/volume_mm3,4) AS volume_total_permm3 FROM m LEFT JOIN volumes USING (animal) LEFT JOIN n USING (animal)"""
)
def d14_per_mm3(spark, sf):
    objects = role(spark, sf, "objects")
    master = A.master_objects(objects, ["animal", "channel"]).select("animal", "channel", "count", "volume_total")
    return rounded(A.per_mm3(master, _volumes(spark, sf), A.distinct_sections(objects, "animal", ["section"]), "animal", ["count", "volume_total"]))


@query(VOLUMES.join(["WITH ", " SELECT animal, round(volume_mm3,6) AS volume_mm3 FROM volumes"]))
def d15_roi_volume(spark, sf):
    return rounded(_volumes(spark, sf), 6)


@query(f"{OBJ} SELECT run_id AS mode, animal, channel, round(avg(intden),3) AS intden_mean, round(avg(overlap),9) AS overlap_mean, round(avg(mean),9) AS mean_mean, count(DISTINCT z) AS num_z FROM objects GROUP BY 1, 2, 3")
def d16_master_intensity(spark, sf):
    o = role(spark, sf, "objects").withColumnRenamed("run_id", "mode")
    out = o.groupBy("mode", "animal", "channel").agg(F.avg("intden").alias("intden_mean"), F.avg("overlap").alias("overlap_mean"), F.avg("mean").alias("mean_mean"), F.countDistinct("z").alias("num_z"))
    return rounded(out, 9).withColumn("intden_mean", F.round("intden_mean", 3))


@query(f"{OBJ} SELECT animal, max(n) AS num_z FROM (SELECT animal, channel, count(z) n FROM objects GROUP BY 1, 2) GROUP BY animal")
def d17_z_slices(spark, sf):
    return role(spark, sf, "objects").groupBy("animal", "channel").agg(F.count("z").alias("n")).groupBy("animal").agg(F.max("n").alias("num_z"))


@query(f"{OBJ} SELECT animal, string_agg(DISTINCT run_id, ';' ORDER BY run_id) AS runs FROM objects GROUP BY animal")
def d18_lineage(spark, sf):
    return A.lineage(role(spark, sf, "objects"), ["animal"])


@query(f"{GOOD}, m AS (SELECT animal, channel, count(*)::DOUBLE AS count, avg(volume) AS volume_mean FROM good GROUP BY 1, 2) SELECT animal, 'Object_Count' AS metric, round(sum(count),4) AS value FROM m GROUP BY 1 UNION ALL SELECT animal, 'VolumeMean', round(avg(volume_mean),4) FROM m GROUP BY 1")
def d19_animal_collapse(spark, sf):
    m = A.master_objects(role(spark, sf, "objects"), ["animal", "channel"]).select("animal", "channel", F.col("count").cast("double").alias("Object_Count"), F.col("volume_mean").alias("VolumeMean"))
    return rounded(A.animal_collapse(m.unpivot(["animal", "channel"], ["Object_Count", "VolumeMean"], "metric", "value"), ["animal"]))


SAMPLES = role_sql("samples")


@query(f"{SAMPLES} SELECT metric, condition, count(value) AS n, round(avg(value),3) AS mean, round(stddev_samp(value),3) AS sd, round(stddev_samp(value)/sqrt(count(value)),3) AS sem FROM samples GROUP BY 1, 2")
def d20_superplot(spark, sf):
    return rounded(A.superplot(role(spark, sf, "samples"), ["metric", "condition"]), 3)


@query(f"{SAMPLES} SELECT metric, condition, count(value) AS n, round(avg(value),3) AS mean, round(stddev_samp(value)/sqrt(count(value)),3) AS sem, round(quantile_cont(value,0.5),3) AS median, round(quantile_cont(value,0.25),3) AS q1, round(quantile_cont(value,0.75),3) AS q3, round(quantile_cont(value,0.75)-quantile_cont(value,0.25),3) AS iqr FROM samples GROUP BY 1, 2")
def d21_five_figure(spark, sf):
    return rounded(A.five_figure(role(spark, sf, "samples"), ["metric", "condition"]), 3)


@query(OBJ + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}),3) AS mean, round(stddev_samp({c}),3) AS sd, round(min({c}),3) AS min, round(max({c}),3) AS max FROM objects" for c in ("volume", "surface", "mean")))
def d22_population_summary(spark, sf):
    return rounded(A.population_summary(role(spark, sf, "objects"), ["volume", "surface", "mean"]), 3)


@query(f"{OBJ} SELECT animal, round(abs(sum(-p*log2(p))),4) AS entropy FROM (SELECT animal, count(*)/sum(count(*)) OVER (PARTITION BY animal) AS p FROM objects GROUP BY animal, cluster) GROUP BY animal")
def d23_entropy(spark, sf):
    return rounded(A.entropy(role(spark, sf, "objects"), ["animal"], "cluster"))


@query(f"{OBJ} SELECT section, pattern, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (PARTITION BY section),4) AS pct FROM (SELECT section, CASE WHEN cluster > 0 AND marker > 0 THEN 'cluster + marker' WHEN cluster > 0 THEN 'cluster' WHEN marker > 0 THEN 'marker' ELSE 'None' END AS pattern FROM objects) GROUP BY section, pattern")
def d25_patterns(spark, sf):
    return rounded(A.patterns(role(spark, sf, "objects"), "section", ["marker", "cluster"]))


@query(f"{OBJ} SELECT cluster, count(*) AS n, round(avg(volume),4) AS volume_mean, round(avg(mean),4) AS mean_mean FROM objects GROUP BY cluster")
def d26_cluster_profile(spark, sf):
    return rounded(A.cluster_profile(role(spark, sf, "objects"), "cluster", ["volume", "mean"]))


@query("SELECT label, CAST(bin AS INT) AS bin, count(*) AS n, round(avg(value),4) AS mean, round(stddev_pop(value)/sqrt(count(*)),4) AS sem FROM (SELECT label, unnest(range(len(embedding))) AS bin, unnest(embedding)::DOUBLE AS value FROM embeddings) GROUP BY label, bin")
def d27_curve_summary(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return rounded(A.curve_summary(e.select("label", F.col("embedding").cast("array<double>").alias("curve")), ["label"], "curve"))


@query(f"{OBJ} SELECT channel, section, regr_count(intden, volume) AS n, round(regr_slope(intden, volume),3) AS slope, round(regr_r2(intden, volume),4) AS r2 FROM objects GROUP BY channel, section")
def d28_regression(spark, sf):
    out = A.regression(role(spark, sf, "objects"), ["channel", "section"], "intden", "volume")
    return out.select("channel", "section", "n", F.round("slope", 3).alias("slope"), F.round("r2", 4).alias("r2"))


@query(f"{OBJ} SELECT channel, quantile_disc(volume, 0.95) AS value FROM objects GROUP BY channel")
def d29_nearest_rank(spark, sf):
    return A.nearest_rank(role(spark, sf, "objects"), ["channel"], "volume", 0.95)


@query(f"{OBJ} SELECT animal, round(2*sum(r*volume)/(count(*)*sum(volume)) - (count(*)+1)/count(*),4) AS gini FROM (SELECT animal, volume, row_number() OVER (PARTITION BY animal ORDER BY volume) r FROM objects) GROUP BY animal")
def d30_gini(spark, sf):
    return rounded(A.gini(role(spark, sf, "objects"), ["animal"], "volume"))


@query(f"{OBJ} SELECT channel, round((t1*s22-t2*s12)/(s11*s22-s12*s12),4) AS a, round((t2*s11-t1*s12)/(s11*s22-s12*s12),4) AS b FROM (SELECT channel, sum(volume*volume) s11, sum(volume*z) s12, sum(z*z) s22, sum(volume*surface) t1, sum(z*surface) t2 FROM objects GROUP BY channel)")
def d31_least_squares(spark, sf):
    return rounded(A.least_squares(role(spark, sf, "objects"), ["channel"], "surface", "volume", "z"))


@query(f"{OBJ} SELECT channel, round(avg(intden),2) AS top_mean FROM (SELECT channel, intden, rank() OVER (PARTITION BY channel ORDER BY intden DESC) r, count(*) OVER (PARTITION BY channel) n FROM objects) WHERE r <= greatest(1, floor(0.01*n)) GROUP BY channel")
def d32_top_brightness(spark, sf):
    return rounded(A.top_share_mean(role(spark, sf, "objects"), ["channel"], "intden"), 2)


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def d33_duplicate_groups(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.groupBy(F.octet_length("text").alias("size"), F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1").drop("size")
