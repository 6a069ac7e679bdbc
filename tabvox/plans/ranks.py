"""Ranks, picks and names over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvox.functions import names as N
from tabvox.functions.scalar import NORM_CDF_SQL, norm_cdf, stars
from tabvox.operators import rank as R
from tabvox.plans.base import query, rounded
from tabvox.plans.joins import GRID
from tabvox.sources.driver import role, role_sql

OBJ, SAMPLES = role_sql("objects"), role_sql("samples")


@query(f"{OBJ} SELECT label, count(*) OVER (PARTITION BY channel, intden) AS ties, rank() OVER (PARTITION BY channel ORDER BY intden) + (count(*) OVER (PARTITION BY channel, intden)-1)/2.0 AS rank FROM objects")
def e01_midrank(spark, sf):
    return R.midrank(role(spark, sf, "objects"), ["channel"], "intden").select("label", "ties", "rank")


@query(f"{OBJ}, v AS (SELECT run_id AS c, animal, channel, avg(intden) AS v FROM objects GROUP BY 1,2,3), r AS (SELECT *, row_number() OVER (PARTITION BY c, channel ORDER BY v, animal) r FROM v), s AS (SELECT c, animal, avg(r) AS score FROM r GROUP BY 1,2), p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score, animal) a, row_number() OVER (PARTITION BY c ORDER BY score DESC, animal DESC) z FROM s) SELECT c AS run_id, animal, round(score,4) AS score, CASE WHEN a=1 AND z=1 THEN 'MIN_MAX' WHEN a=1 THEN 'MIN' ELSE 'MAX' END AS pick FROM p WHERE a=1 OR z=1")
def e02_composite_pick(spark, sf):
    return rounded(R.composite_pick(role(spark, sf, "objects").groupBy("run_id", "animal", "channel").agg(F.avg("intden").alias("v")), "run_id", "animal", "channel", "v"))


@query(f"{OBJ}, q AS (SELECT channel, quantile_cont(surface,0.02) a, quantile_cont(surface,0.98) b FROM objects GROUP BY 1) SELECT label, round(least(1,greatest(0,(surface-a)/(CASE WHEN b<=a THEN 1 ELSE b-a END))),6) AS scaled FROM objects JOIN q USING (channel)")
def e03_population_scale(spark, sf):
    return rounded(R.population_scale(role(spark, sf, "objects").select("label", "channel", "surface"), ["channel"], "surface").select("label", "scaled"), 6)


@query(f"{OBJ}, z AS (SELECT label, (x-avg(x) OVER w)/stddev_samp(x) OVER w zx, (y-avg(y) OVER w)/stddev_samp(y) OVER w zy, (intden-avg(intden) OVER w)/stddev_samp(intden) OVER w zi, (volume-avg(volume) OVER w)/stddev_samp(volume) OVER w zv FROM objects WINDOW w AS (PARTITION BY channel, section)) SELECT label, round(sqrt(zx*zx+zy*zy),4) AS smsd, round(abs(zi-zv),4) AS imdi FROM z")
def e05_smsd_imdi(spark, sf):
    return rounded(R.shape_distance(role(spark, sf, "objects"), ["channel", "section"], ["x", "y"], "intden", "volume").select("label", "smsd", "imdi"))


@query(f"{OBJ} SELECT label, round(CASE WHEN volume>0 THEN volume*count(CASE WHEN volume>0 THEN 1 END) OVER w/sum(CASE WHEN volume>0 THEN volume END) OVER w END,6) AS tdr FROM objects WINDOW w AS (PARTITION BY section)")
def e06_territory_share(spark, sf):
    return rounded(R.territory_share(role(spark, sf, "objects"), ["section"], "volume").select("label", "tdr"), 6)


ROBUST = f"{SAMPLES}, q AS (SELECT metric, condition, count(value) n, quantile_cont(value,0.25) a, quantile_cont(value,0.5) m, quantile_cont(value,0.75) b FROM samples GROUP BY 1,2 HAVING count(value)>=3), d AS (SELECT s.*, a, m, b FROM samples s JOIN q USING (metric, condition)), k AS (SELECT metric, condition, quantile_cont(abs(value-m),0.5) mad FROM d GROUP BY 1,2), r AS (SELECT metric, condition, subject, value, abs(value-m)/(CASE WHEN mad>0 THEN 1.4826*mad WHEN b>a THEN (b-a)/1.349 END) score FROM d JOIN k USING (metric, condition))"


@query(f"{ROBUST} SELECT metric, condition, subject, round(score,4) AS score, score>3 AS outlier FROM r WHERE score IS NOT NULL")
def e07_robust_outlier(spark, sf):
    return rounded(R.robust_outliers(role(spark, sf, "samples"), ["metric", "condition"], "value").select("metric", "condition", "subject", "score", "outlier"))


@query(f"{ROBUST} SELECT metric, condition, subject, round(score,4) AS score, row_number() OVER (PARTITION BY metric ORDER BY score DESC, condition, subject) AS place FROM r WHERE score > 1.5 QUALIFY place <= 20")
def l01_odd_image(spark, sf):
    found = R.robust_outliers(role(spark, sf, "samples"), ["metric", "condition"], "value", cut=1.5).where("outlier")
    return rounded(R.top_shifts(found, ["metric"], [F.desc("score"), "condition", "subject"], 20).select("metric", "condition", "subject", "score", "place"))


@query(f"WITH {GRID}, h AS (SELECT channel, CAST(floor(value) AS INT) bin, count(*) c FROM voxels GROUP BY 1,2), w AS (SELECT *, sum(c) OVER o w0, sum(c*bin) OVER o s0, sum(c) OVER (PARTITION BY channel) n, sum(c*bin) OVER (PARTITION BY channel) s FROM h WINDOW o AS (PARTITION BY channel ORDER BY bin)), b AS (SELECT channel, bin, w0*(n-w0)*pow(s0/w0-(s-s0)/(n-w0),2)/pow(n,2) v FROM w WHERE w0<n) SELECT channel, bin AS threshold, round(v,4) AS between FROM b QUALIFY row_number() OVER (PARTITION BY channel ORDER BY round(v,9) DESC, bin)=1".replace("AS between", 'AS "between"'))
def e08_otsu(spark, sf):
    h = role(spark, sf, "voxels").groupBy("channel", F.floor("value").cast("int").alias("bin")).agg(F.count("*").alias("c"))
    return rounded(R.otsu(h, ["channel"], "bin", "c"))


@query(f"{OBJ}, c AS (SELECT channel, CAST(floor(volume) AS INT) x, count(*)::DOUBLE y FROM objects GROUP BY 1,2), s AS (SELECT channel, x, sum(y) OVER (PARTITION BY channel ORDER BY x) y FROM c), d AS (SELECT channel, x, round((y-min(y) OVER w)/(max(y) OVER w-min(y) OVER w)-(x-min(x) OVER w)/(max(x) OVER w-min(x) OVER w)::DOUBLE,9) d, round(abs(y-lag(y) OVER (PARTITION BY channel ORDER BY x)),9) st FROM s WINDOW w AS (PARTITION BY channel)) SELECT channel, (SELECT x FROM d e WHERE e.channel=d.channel ORDER BY d DESC, x LIMIT 1) AS knee, (SELECT x FROM d e WHERE e.channel=d.channel ORDER BY st DESC NULLS LAST, x LIMIT 1) AS steepest FROM d GROUP BY channel")
def e09_knee(spark, sf):
    from pyspark.sql.window import Window as W

    c = role(spark, sf, "objects").groupBy("channel", F.floor("volume").cast("int").alias("x")).agg(F.count("*").cast("double").alias("c"))
    return R.knee(c.withColumn("y", F.sum("c").over(W.partitionBy("channel").orderBy("x"))), ["channel"], "x", "y")


@query(f"{SAMPLES}, d AS (SELECT subject, metric, max(value)-min(value) AS shift FROM samples GROUP BY 1,2) SELECT metric, subject, round(shift,2) AS shift, row_number() OVER (PARTITION BY metric ORDER BY shift DESC, subject) AS place, greatest(0, count(*) OVER (PARTITION BY metric)-6) AS more FROM d QUALIFY place<=6")
def f02_top_shifts(spark, sf):
    d = role(spark, sf, "samples").groupBy("subject", "metric").agg((F.max("value") - F.min("value")).alias("shift"))
    return rounded(R.top_shifts(d, ["metric"], [F.desc("shift"), "subject"]), 2)


@query(f"{SAMPLES}, a AS (SELECT metric, condition, count(*) n, avg(value) m FROM samples GROUP BY 1,2) SELECT metric, condition, n, round(m,3) AS m FROM a QUALIFY row_number() OVER (PARTITION BY metric ORDER BY n DESC, m, condition)=1")
def f03_best_point(spark, sf):
    a = role(spark, sf, "samples").groupBy("metric", "condition").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    return rounded(R.best_point(a, ["metric"], [F.col("n"), -F.col("m")]), 3)


@query(f"WITH {GRID} SELECT channel, x, y, z, round(value,4) AS value FROM voxels WHERE x % 8 = 4")
def f06_systematic(spark, sf):
    return rounded(R.systematic(role(spark, sf, "voxels"), "x", 8))


@query(f"WITH {GRID} SELECT x, y, z, bool_or(channel='A') AND bool_or(channel='R') AS both, bool_or(channel='A') AND NOT bool_or(channel='R') AS only_a FROM voxels WHERE channel IN ('A','R') AND value>=25 GROUP BY x,y,z")
def g03_mask_algebra(spark, sf):
    v = role(spark, sf, "voxels").where("value >= 25")
    a, r = (v.where(f"channel = '{c}'").select("x", "y", "z") for c in "AR")
    both, only = a.intersect(r), a.subtract(r)
    return a.union(r).distinct().join(both.withColumn("both", F.lit(True)), ["x", "y", "z"], "left").join(only.withColumn("only_a", F.lit(True)), ["x", "y", "z"], "left").select("x", "y", "z", F.coalesce("both", F.lit(False)).alias("both"), F.coalesce("only_a", F.lit(False)).alias("only_a"))


@query(f"{SAMPLES}, r AS (SELECT metric, condition, value, row_number() OVER (PARTITION BY metric, condition ORDER BY subject) AS row FROM samples) SELECT metric, row, " + ", ".join(f"round(max(value) FILTER (condition='{c}'),6) AS \"{c}\"" for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM r GROUP BY 1,2")
def a13_export(spark, sf):
    return rounded(R.ragged_export(role(spark, sf, "samples"), "metric", "condition", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "value", ["subject"]), 6)


NAMES = "n AS (SELECT p_partkey, CASE p_partkey%4 WHEN 0 THEN 'Exp1-M'||p_partkey||'_LH_SCN' WHEN 1 THEN 'file.lif - Exp2-F'||p_partkey||'_RH_CTX_treated' WHEN 2 THEN 'M'||p_partkey||'_LH' ELSE 'plain'||p_partkey END AS name FROM part)"


def _names(spark, sf):
    k = F.col("p_partkey")
    return spark.read.parquet(f"{sf}/part.parquet").select(k, F.when(k % 4 == 0, F.concat(F.lit("Exp1-M"), k, F.lit("_LH_SCN"))).when(k % 4 == 1, F.concat(F.lit("file.lif - Exp2-F"), k, F.lit("_RH_CTX_treated"))).when(k % 4 == 2, F.concat(F.lit("M"), k, F.lit("_LH"))).otherwise(F.concat(F.lit("plain"), k)).alias("name"))


@query(f"WITH {NAMES} SELECT p_partkey, CASE p_partkey%4 WHEN 0 THEN 'Exp1' WHEN 1 THEN 'Exp2' END AS experiment, CASE p_partkey%4 WHEN 1 THEN 'F'||p_partkey WHEN 3 THEN 'plain'||p_partkey ELSE 'M'||p_partkey END AS animal, CASE p_partkey%4 WHEN 1 THEN 'RH' WHEN 3 THEN NULL ELSE 'LH' END AS hemisphere, CASE p_partkey%4 WHEN 0 THEN 'SCN' WHEN 1 THEN 'CTX' END AS region, CASE p_partkey%4 WHEN 1 THEN 'treated' END AS condition FROM n")
def h01_parse_name(spark, sf):
    return _names(spark, sf).select("p_partkey", N.parse_image_name(F.col("name")).alias("s")).select("p_partkey", "s.*")


@query("SELECT c_custkey, CASE WHEN c_custkey%2=0 THEN 'WTko' ELSE 'Mouse' END AS condition FROM customer")
def h02_detect_condition(spark, sf):
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf}/customer.parquet").select(k, N.detect_condition(F.when(k % 2 == 0, F.concat(F.lit("WT"), k, F.lit("ko"))).otherwise(F.concat(F.lit("Mouse_"), k))).alias("condition"))


@query("SELECT c_custkey, 'A'||c_custkey AS unit FROM customer")
def h06_animal_unit(spark, sf):
    k = F.col("c_custkey")
    df = spark.read.parquet(f"{sf}/customer.parquet").select(k, F.concat(F.lit("A"), k, F.when(k % 3 == 0, "-LH").when(k % 3 == 1, "-SCN2").otherwise("-left")).alias("name"))
    return N.animal_unit(df, "name").select("c_custkey", "unit")


@query(f"{SAMPLES}, z AS (SELECT metric, subject, condition, (value-avg(value) OVER (PARTITION BY metric, condition))/stddev_samp(value) OVER (PARTITION BY metric, condition) z FROM samples), p AS (SELECT *, 2*(1-{NORM_CDF_SQL.format(z='abs(z)')}) p FROM z WHERE z IS NOT NULL) SELECT metric, subject, condition, CASE WHEN p<0.0001 THEN '****' WHEN p<0.001 THEN '***' WHEN p<0.01 THEN '**' WHEN p<0.05 THEN '*' ELSE 'ns' END AS stars FROM p")
def h11_stars(spark, sf):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("metric", "condition")
    z = role(spark, sf, "samples").withColumn("z", (F.col("value") - F.avg("value").over(w)) / F.stddev_samp("value").over(w)).where("z IS NOT NULL")
    return z.select("metric", "subject", "condition", stars(2 * (1 - norm_cdf(F.abs("z")))).alias("stars"))


@query("SELECT event_id, k AS path, CAST(json_extract_string(props, '$.'||k) AS VARCHAR) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) WHERE json_type(props, '$.'||k) NOT IN ('OBJECT','ARRAY')")
def h15_flatten_json(spark, sf):
    return N.flatten_json(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "props"), "event_id", "props").where(~F.col("path").contains(".") & ~F.col("path").contains("["))


@query("SELECT 'S'||s_suppkey||'_'||(CASE WHEN s_suppkey%2=0 THEN 'ctrl' ELSE 'drug' END)||'_x' AS name, 'S'||s_suppkey AS animal, CASE WHEN s_suppkey%2=0 THEN 'ctrl' ELSE 'drug' END AS condition FROM supplier")
def h20_infer_identity(spark, sf):
    k = F.col("s_suppkey")
    return N.infer_identity(spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("S"), k, F.lit("_"), F.when(k % 2 == 0, "ctrl").otherwise("drug"), F.lit("_x")).alias("name")), "name")


@query("SELECT vec_id, CAST(i AS INT) AS bin, round((v-mn)/(mx-mn),5) AS value FROM (SELECT vec_id, unnest(range(len(embedding))) i, unnest(embedding)::DOUBLE v, list_min(embedding)::DOUBLE mn, list_max(embedding)::DOUBLE mx FROM embeddings)")
def h17_curve_normalise(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return rounded(e.select("vec_id", F.posexplode(N.curve_normalise(F.col("embedding").cast("array<double>"), "minmax")).alias("bin", "value")), 5)


@query("SELECT o_custkey, o_orderkey, date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) AS days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def h18_date_gaps(spark, sf):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("days"))


@query("SELECT event_id, CASE WHEN event_type LIKE 'c%' THEN '''='||event_type ELSE event_type END AS cell FROM events")
def a08_safe_cell(spark, sf):
    c = F.when(F.col("event_type").startswith("c"), F.concat(F.lit("="), "event_type")).otherwise(F.col("event_type"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", N.safe_cell(c).alias("cell"))
