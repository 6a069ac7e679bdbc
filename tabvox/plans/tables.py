"""Result tables, names, orders and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabvox.functions import names as N
from tabvox.functions.scalar import NORM_CDF_SQL, chi2_sf, norm_cdf, shape_composites
from tabvox.operators import aggregate as A
from tabvox.operators import joins as J
from tabvox.operators import rank as R
from tabvox.operators import spatial as S
from tabvox.plans.base import query, rounded
from tabvox.plans.joins import COND, NEAR, SIDES, _near, conditions
from tabvox.sources import results as T
from tabvox.sources.driver import role, role_sql

OBJ, SAMPLES = role_sql("objects"), role_sql("samples")


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(f"{OBJ}, {COND} SELECT o.animal, n, nation AS condition_nation, region AS condition_region, nation||'_'||region AS condition FROM (SELECT animal, count(*) n FROM objects GROUP BY 1) o LEFT JOIN cond c ON o.animal=c.animal")
def a14_refresh_conditions(spark, sf):
    saved = role(spark, sf, "objects").groupBy("animal").agg(F.count("*").alias("n"), F.lit("old").alias("condition"), F.lit("old").alias("condition_age"))
    return T.refresh_conditions(saved, conditions(spark, sf))


@query(f"{OBJ} SELECT s.animal, s.channel, round(avg(volume),4) AS value FROM (SELECT DISTINCT 'A'||s_suppkey AS animal, c AS channel FROM supplier JOIN (VALUES ('A'),('R'),('X')) q(c) ON true) s LEFT JOIN objects o ON o.animal=s.animal AND o.channel=s.channel GROUP BY 1,2")
def a16_load_statistic(spark, sf):
    series = _read(spark, sf, "supplier").select(F.concat(F.lit("A"), "s_suppkey").alias("animal"), F.explode(F.array(*map(F.lit, "ARX"))).alias("channel")).distinct()
    return rounded(T.load_statistic(role(spark, sf, "objects"), ["animal", "channel"], "volume", series))


@query("SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events")
def a17_channel_settings(spark, sf):
    return T.json_fields(_read(spark, sf, "events").select("event_id", "props"), "props", "k long").drop("props")


@query("SELECT l_returnflag, count(*) AS pixels, round(avg(l_quantity),4) AS before, round(avg(greatest(0,l_quantity-10)),4) AS after, round(100*(sum(l_quantity)-sum(greatest(0,l_quantity-10)))/sum(l_quantity),4) AS removed_pct, CAST(count(*) FILTER (l_quantity>0 AND l_quantity<=10) AS BIGINT) AS zeroed FROM lineitem GROUP BY 1")
def a18_correction_summary(spark, sf):
    l = _read(spark, sf, "lineitem").select("l_returnflag", "l_quantity", F.greatest(F.lit(0.0), F.col("l_quantity") - 10).alias("left"))
    return rounded(T.correction_summary(l, ["l_returnflag"], "l_quantity", "left"))


@query("SELECT n_name, n_regionkey, n_nationkey FROM nation")
def b13_column_order(spark, sf):
    return T.ordered(_read(spark, sf, "nation"), ["n_name", "n_missing", "n_regionkey"])


@query("SELECT p_partkey FROM part WHERE p_partkey%4 IN (0,3)")
def b14_junk_files(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 1, F.concat(F.lit("._part"), k)).when(k % 4 == 2, F.lit("Thumbs.db")).otherwise(F.concat(F.lit("part"), k, F.lit(".csv")))
    return _read(spark, sf, "part").select(k, name.alias("name")).where(~T.junk_file(F.col("name"))).select("p_partkey")


@query(f"{OBJ} SELECT label FROM objects WHERE volume BETWEEN 5 AND 40 AND mean >= 0.02 AND intden >= 1000")
def b15_detections(spark, sf):
    return A.detections(role(spark, sf, "objects"), "volume", 5, 40, {"mean": 0.02, "intden": 1000}).select("label")


@query(f"{OBJ}, {COND} SELECT animal, nation AS condition_nation, region AS condition_region FROM (SELECT DISTINCT animal FROM objects) o LEFT JOIN cond c USING (animal)")
def c02_axes_join(spark, sf):
    return J.condition_join(role(spark, sf, "objects").select("animal").distinct(), conditions(spark, sf)).drop("condition")


@query(f"{NEAR} SELECT b.section, b.id, count(m.id) AS n FROM b LEFT JOIN m ON m.section=b.section AND m.nearest=b.id AND r = 1 AND distance < 2 GROUP BY 1, 2")
def c10_contains_counts(spark, sf):
    return S.closest_counts(_near(spark, sf).where("distance < 2"), role(spark, sf, "points").where(SIDES["b"]), ["section"])


@query(f"{OBJ} SELECT section, CAST(sum(marker) AS DOUBLE) AS count, round(100*avg(marker),4) AS pct FROM objects GROUP BY 1 HAVING bool_and(marker IN (0,1))")
def d09_binary_flags(spark, sf):
    long = A.metric_rollup(role(spark, sf, "objects"), ["section"], ["marker"])
    return rounded(long.groupBy("section").pivot("stat", ["count", "pct"]).agg(F.min("value")))


@query(f"{OBJ} SELECT section, round(sum(overlap),3) AS total, round(avg(overlap),4) AS mean FROM objects GROUP BY 1")
def d10_count_like(spark, sf):
    long = A.metric_rollup(role(spark, sf, "objects").withColumnRenamed("overlap", "overlap_count"), ["section"], ["overlap_count"])
    wide = long.groupBy("section").pivot("stat", ["total", "mean"]).agg(F.min("value"))
    return wide.select("section", F.round("total", 3).alias("total"), F.round("mean", 4).alias("mean"))


@query(f"{OBJ} SELECT section, 'A' AS source, 'B' AS target, count(*) AS objects, count(*) FILTER (marker=1) AS coloc, round(100.0*count(*) FILTER (marker=1)/count(*),4) AS coloc_pct, count(*) FILTER (cluster>0) AS contains, round(100.0*count(*) FILTER (cluster>0)/count(*),4) AS contains_pct FROM objects GROUP BY 1".replace("AS contains,", 'AS "contains",'))
def d24_pair_summary(spark, sf):
    return rounded(A.pair_summary(role(spark, sf, "objects"), ["section"], {("A", "B"): ("marker", "cluster")}))


@query(f"{SAMPLES} SELECT metric, condition, subject, CAST(row_number() OVER (PARTITION BY metric, condition ORDER BY subject) AS INT) AS place FROM samples")
def e10_row_index(spark, sf):
    return role(spark, sf, "samples").select("metric", "condition", "subject", F.row_number().over(W.partitionBy("metric", "condition").orderBy("subject")).alias("place"))


@query(f"{OBJ} SELECT section, channel, cluster, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (PARTITION BY section, channel),4) AS pct FROM objects GROUP BY 1,2,3")
def e11_percent_within(spark, sf):
    return rounded(A.percent_within(role(spark, sf, "objects"), ["section", "channel"], ["cluster"]))


@query("SELECT c_mktsegment AS condition, CAST(row_number() OVER (ORDER BY min(c_custkey)) AS INT) AS ord FROM customer GROUP BY 1")
def f04_condition_order(spark, sf):
    return R.condition_order(_read(spark, sf, "customer"), "c_custkey", "c_mktsegment").withColumnRenamed("c_mktsegment", "condition")


@query("SELECT p_partkey, p_name, rank FROM (SELECT p_partkey, p_name, CASE WHEN lower(p_name)='bolt' THEN 1 WHEN lower(p_name) LIKE 'bolt%' THEN 2 WHEN lower(p_name) LIKE '% bolt%' THEN 3 WHEN lower(p_name) LIKE '%bolt%' THEN 4 END AS rank FROM part) WHERE rank IS NOT NULL ORDER BY rank, p_partkey LIMIT 10".replace("AS rank", 'AS "rank"'))
def f05_marker_search(spark, sf):
    p = _read(spark, sf, "part").select("p_partkey", "p_name", N.search_rank("Bolt ", F.col("p_partkey").cast("string"), F.col("p_name")).alias("rank"))
    return p.where("rank IS NOT NULL").orderBy("rank", "p_partkey").limit(10)


@query(f"{OBJ} SELECT metric, list_sort(list(DISTINCT channel))::VARCHAR AS channels FROM (SELECT channel, 'volume' AS metric FROM objects WHERE channel<>'N' UNION ALL SELECT channel, 'intden' FROM objects WHERE channel<>'A') GROUP BY 1")
def g01_metric_union(spark, sf):
    o = role(spark, sf, "objects")
    long = o.where("channel <> 'N'").select("channel", F.lit("volume").alias("metric")).unionByName(o.where("channel <> 'A'").select("channel", F.lit("intden").alias("metric")))
    return long.groupBy("metric").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set("channel")), ", "), F.lit("]")).alias("channels"))


@query("WITH a AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey%4<>0), b AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey%5<>0) SELECT 'removed' AS status, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'added', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def g02_rows_changed(spark, sf):
    o = _read(spark, sf, "orders")
    a, b = (o.where(f"o_orderkey % {k} <> 0").select("o_custkey", "o_orderpriority") for k in (4, 5))
    return a.exceptAll(b).select(F.lit("removed").alias("status"), "*").union(b.exceptAll(a).select(F.lit("added").alias("status"), "*"))


@query("SELECT p_partkey, CASE p_partkey%3 WHEN 0 THEN 'LH' WHEN 1 THEN 'RH' END AS hemisphere FROM part")
def h04_hemisphere_alias(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("M"), k, F.lit("_Left"))).when(k % 3 == 1, F.concat(F.lit("contra-"), k)).otherwise(F.concat(F.lit("lefty"), k))
    return _read(spark, sf, "part").select(k, N.hemisphere_alias(name, {"left": "LH", "ipsi": "LH", "right": "RH", "contra": "RH"}).alias("hemisphere"))


@query("SELECT p_partkey, CASE p_partkey%3 WHEN 0 THEN 'Overlap with B'||p_partkey WHEN 1 THEN 'Mean volume' ELSE 'other' END AS label FROM part")
def h07_metric_label(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("A_VolOverlap30_B"), k)).when(k % 3 == 1, F.lit("VolumeMean")).otherwise(F.lit("other"))
    return _read(spark, sf, "part").select(k, N.metric_label(name, [(r"^\w+_VolOverlap\d*_(.+)$", "Overlap with $1"), ("^VolumeMean$", "Mean volume")]).alias("label"))


@query("SELECT l_orderkey, l_linenumber, round(1/l_quantity,6) AS ri, round(l_discount/l_quantity,8) AS sri, round(1-l_tax,6) AS pb, CASE WHEN abs(l_linenumber+l_quantity-2+0.001)>=1e-10 THEN round((l_linenumber-1)/(l_linenumber+l_quantity-2+0.001),6) END AS mp, round(log10(pow(l_quantity,3)/l_extendedprice),6) AS vsd, round(l_quantity/(2*pow(3*l_extendedprice/(4*pi()),1/3.0::DOUBLE)),6) AS fev FROM lineitem")
def h09_shape_composites(spark, sf):
    l, q = _read(spark, sf, "lineitem"), F.col("l_quantity")
    made = shape_composites(q, q, F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber"), q, q, F.col("l_extendedprice"))
    return l.select("l_orderkey", "l_linenumber", *[(F.round(c, 8 if n == "sri" else 6) + F.lit(0.0)).alias(n) for n, c in made.items()])


@query(f"SELECT c_custkey, round({NORM_CDF_SQL.format(z='c_acctbal/3000')},7) AS p FROM customer")
def h12_norm_cdf(spark, sf):
    return _read(spark, sf, "customer").select("c_custkey", F.round(norm_cdf(F.col("c_acctbal") / 3000), 7).alias("p"))


@query("SELECT c_custkey, round(exp(-x/2),6) AS p2, round(exp(-x/2)*(1+x/2),6) AS p4, round(exp(-x/2)*(1+x/2+x*x/8),6) AS p6 FROM (SELECT c_custkey, abs(c_acctbal)/500 AS x FROM customer)")
def h13_chi2(spark, sf):
    x = F.abs("c_acctbal") / 500
    return _read(spark, sf, "customer").select("c_custkey", *[F.round(chi2_sf(x, k), 6).alias(f"p{k}") for k in (2, 4, 6)])


@query("WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS c FROM embeddings), m AS (SELECT vec_id, c, len(c) AS n, list_avg(c) AS m, list_max(c) AS top, list_avg(c[:len(c)//3]) AS a, list_avg(c[2*len(c)//3+1:]) AS b FROM c) SELECT vec_id, CASE WHEN b>0 THEN round(a/b,3) END AS core_edge, round((list_position(c,top)-0.5)/n,6) AS peak, CASE WHEN top>0 THEN round(len(list_filter(c, lambda x: x>=0.5*top))/n,6) END AS ring, CASE WHEN m>0 THEN round(greatest(0,1-sqrt(list_sum(list_transform(c, lambda x: (x-m)*(x-m)))/n)/m),3) END AS uniformity FROM m")
def h16_curve_measures(spark, sf):
    e = _read(spark, sf, "embeddings").select("vec_id", N.curve_measures(F.col("embedding").cast("array<double>")).alias("m")).select("vec_id", "m.*")
    return e.select("vec_id", F.round("core_edge", 3).alias("core_edge"), F.round("peak", 6).alias("peak"), F.round("ring", 6).alias("ring"), F.round("uniformity", 3).alias("uniformity"))


@query("SELECT p_partkey, CASE WHEN p_partkey%3<>2 THEN 'M'||p_partkey END AS animal, CASE p_partkey%3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 END AS sure, CASE p_partkey%2 WHEN 0 THEN 'Control' END AS \"group\" FROM part")
def h21_grammar(spark, sf):
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, F.concat(F.lit("mouse-M"), k)).when(k % 3 == 1, F.concat(F.lit("M"), k)).otherwise(F.lit("none")), F.when(k % 2 == 0, F.lit("_CONTROL")).otherwise(F.lit("_contrast")))
    g = N.grammar(name, {"animal": [(r"^(M\d+)_", 0.5), (r"mouse-(M\d+)", 0.9)], "group": [(r"_([A-Za-z]+)$", 0.7)]}, {"group": ["Control", "Treated"]})
    return _read(spark, sf, "part").select(k, g.alias("g")).select("p_partkey", F.col("g.animal.value").alias("animal"), F.col("g.animal.confidence").alias("sure"), F.col("g.group.value").alias("group"))


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE r_name IN ('ASIA','EUROPE') AND n_name<>'NATION_2'")
def h22_regions(spark, sf):
    n, r = _read(spark, sf, "nation"), _read(spark, sf, "region")
    j = _read(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.where(N.region_selected(F.col("r_name"), [" asia", "Europe"], []) & N.region_selected(F.col("n_name"), [], ["nation_2 "])).select("c_custkey")


@query("WITH n AS (SELECT p_name AS name, count(*) AS n, regexp_replace(lower(p_name),'[^a-z0-9]','','g') AS t FROM part GROUP BY 1) SELECT a.name AS name, min_by(b.name, (-b.n, b.name)) AS usual FROM n a JOIN n b ON a.name<>b.name AND length(a.t)>2 AND length(b.t)>2 AND levenshtein(a.t,b.t)<=2 AND (b.n>a.n OR (b.n=a.n AND b.name<a.name)) GROUP BY 1")
def l03_naming_drift(spark, sf):
    return J.naming_drift(_read(spark, sf, "part"), "p_name")


@query("WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1), b AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1), j AS (SELECT a.k, a.total ta, b.total tb FROM a JOIN b ON a.k=b.k WHERE abs(a.total-b.total)>1e-6), r AS (SELECT *, row_number() OVER (ORDER BY abs(ta-tb) DESC, k) AS place, count(*) OVER () AS c FROM j) SELECT k, 'total' AS metric, round(ta,2) AS before, round(tb,2) AS after, CAST(place AS INT) AS place, greatest(0,c-6) AS more FROM r WHERE place<=6")
def l06_run_diff(spark, sf):
    o = _read(spark, sf, "orders")
    one = lambda k: o.where(f"o_orderkey % {k} <> 0").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("total"))
    shifts = J.snapshot_diff(one(4), one(5), ["k"], ["total"], 1e-6).where("status = 'shift'").drop("status")
    return rounded(R.top_shifts(shifts, ["metric"], [F.desc(F.abs(F.col("before") - F.col("after"))), "k"]), 2)
