"""Pixel measures over the driver's tables: the grid of lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvox.functions.scalar import NORM_CDF_SQL
from tabvox.operators import pixels as K
from tabvox.operators.aggregate import nearest_rank
from tabvox.operators.forward import forward_model
from tabvox.operators.fractal import fractal
from tabvox.operators.levels import object_counts, roc_of_counts
from tabvox.operators.outline import outlines
from tabvox.plans.base import query, rounded
from tabvox.plans.joins import GRID, labels
from tabvox.sources.driver import role

G = f"WITH {GRID}, flat AS (SELECT channel, y, x, max(value) AS value FROM voxels GROUP BY 1,2,3)"


def _v(spark, sf):
    return role(spark, sf, "voxels")


def _flat(spark, sf):
    return K.max_projection(_v(spark, sf), ["channel"])


def _pair(spark, sf):
    f = _flat(spark, sf)
    one = lambda c, n: f.where(f"channel = '{c}'").select("y", "x", F.col("value").alias(n))
    return one("A", "a").join(one("R", "b"), ["y", "x"]).withColumn("g", F.lit(1))


PAIR = f"{G}, ab AS (SELECT p.y, p.x, p.value AS a, q.value AS b FROM flat p JOIN flat q ON p.channel='A' AND q.channel='R' AND p.y=q.y AND p.x=q.x)"


@query(f"{G} SELECT channel, y, x, round(value,4) AS value FROM flat")
def k01_mip(spark, sf):
    return rounded(_flat(spark, sf))


@query(f"WITH {GRID} SELECT channel, quantile_disc(value,0.9) AS value FROM voxels GROUP BY 1")
def k03_threshold(spark, sf):
    return nearest_rank(_v(spark, sf), ["channel"], "value", 0.9)


@query(f"WITH {GRID} SELECT channel, z, round(sum(CASE WHEN value>=25 THEN value ELSE 0 END),3) AS intden, round(100.0*count(*) FILTER (value>=25)/count(*),4) AS pct_area, round(sum(value),3) AS intden_unfiltered, round(100.0*count(*) FILTER (value>0)/count(*),4) AS pct_positive, round(255.0*count(*) FILTER (value>=25),3) AS intden_binarized FROM voxels GROUP BY 1,2")
def k06_intensity(spark, sf):
    return rounded(K.intensity(_v(spark, sf), ["channel", "z"], 25.0))


@query(f"{G}, t AS (SELECT channel, s AS size, avg(value) m FROM flat JOIN (VALUES (4),(8),(16)) q(s) ON true GROUP BY channel, s, y//s, x//s) SELECT channel, size, round(stddev_pop(m)/avg(m),5) AS cv, round(avg(m*m)/(avg(m)*avg(m))-1,6) AS lacunarity FROM t GROUP BY 1,2")
def k07_patchiness(spark, sf):
    out = K.patchiness(_flat(spark, sf), ["channel"], [4, 8, 16])
    return out.select("channel", "size", F.round("cv", 5).alias("cv"), F.round("lacunarity", 6).alias("lacunarity"))


TILES = f"{G}, t AS (SELECT channel, y//8 AS y, x//8 AS x, avg(value) AS value FROM flat GROUP BY 1,2,3)"


def _tiles(spark, sf):
    return _flat(spark, sf).groupBy("channel", F.floor(F.col("y") / 8).alias("y"), F.floor(F.col("x") / 8).alias("x")).agg(F.avg("value").alias("value"))


@query(f"{TILES}, z AS (SELECT channel, y, x, (value-avg(value) OVER (PARTITION BY channel))/stddev_pop(value) OVER (PARTITION BY channel) z FROM t), l AS (SELECT a.channel, a.y, a.x, a.z, avg(b.z) lag FROM z a JOIN z b ON a.channel=b.channel AND abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1 AND NOT (a.y=b.y AND a.x=b.x) GROUP BY 1,2,3,4) SELECT channel, y, x, round(z,4) AS z, round(lag,4)+0.0 AS lag, round(z*lag,4)+0.0 AS local FROM l".replace("AS lag,", 'AS "lag",').replace("AS local", 'AS "local"'))
def k08_moran(spark, sf):
    return rounded(K.moran(_tiles(spark, sf), ["channel"]))


@query()
def k08_hotspots(spark, sf):
    return K.hotspots(_tiles(spark, sf), ["channel"])


NULL_MODEL = f"{TILES}, z AS (SELECT channel, count(*) AS n, (var_samp(value)/avg(value)*(count(*)-1)-(count(*)-1))/sqrt(2.0*(count(*)-1)) AS z FROM t GROUP BY 1), p AS (SELECT channel, n, z, greatest(0,least(1,2*(1-{NORM_CDF_SQL.format(z='abs(z)')}))) AS p FROM z)"


@query(f"{NULL_MODEL} SELECT channel, n, round(z,4) AS z, round(p,4) AS p, p>=0.05 AS passed FROM p")
def k09_null_model(spark, sf):
    return rounded(K.null_model(_tiles(spark, sf), ["channel"]))


@query(f"{G} SELECT a.channel, k AS lag, round(corr(a.value,b.value),5) AS r FROM flat a JOIN (VALUES (1),(2),(4)) q(k) ON true JOIN flat b ON a.channel=b.channel AND a.y=b.y AND b.x=a.x+k GROUP BY 1,2".replace("AS lag", 'AS "lag"'))
def k10_granularity(spark, sf):
    return rounded(K.granularity(_flat(spark, sf), ["channel"], [1, 2, 4]), 5)


@query(f"{PAIR}, m AS (SELECT y, x FROM ab WHERE b>=50), d AS (SELECT p.y, p.x, p.a, min(sqrt((p.y-m.y)*(p.y-m.y)+(p.x-m.x)*(p.x-m.x))) d FROM ab p JOIN m ON true GROUP BY 1,2,3) SELECT CAST(floor(d/2) AS INT) AS shell, count(*) AS n, round(avg(a),4) AS mean FROM d GROUP BY 1")
def k12_shells(spark, sf):
    ab = _pair(spark, sf)
    return rounded(K.shells(ab.select("g", "y", "x", F.col("a").alias("value")), ab.where("b >= 50"), ["g"], 2.0)["shells"].drop("g"))


SHELLS = f"{PAIR}, m AS (SELECT y, x FROM ab WHERE b>=50), d AS (SELECT p.y, p.x, p.a, min(sqrt((p.y-m.y)*(p.y-m.y)+(p.x-m.x)*(p.x-m.x))) d FROM ab p JOIN m ON true GROUP BY 1,2,3), s AS (SELECT floor(round(d/2,9)) k, avg(a) v FROM d GROUP BY 1)"


@query(f"{SHELLS} SELECT round(regr_slope(v,(k+0.5)*2),5) AS slope, round(sum(v)*2,4) AS auc FROM s WHERE k<8 HAVING count(*)>0")
def k12_shell_summary(spark, sf):
    ab = _pair(spark, sf)
    out = K.shells(ab.select("g", "y", "x", F.col("a").alias("value")), ab.where("b >= 50"), ["g"], 2.0, count=8)["summary"]
    return out.select(F.round("slope", 5).alias("slope"), F.round("auc", 4).alias("auc"))


#: Slices lie three pixels apart.
SHELLS3 = f"WITH {GRID}, m AS (SELECT * FROM voxels WHERE channel='R' AND value>=50), d AS (SELECT p.channel, p.z, p.y, p.x, p.value, min(sqrt(9*(p.z-m.z)*(p.z-m.z)+(p.y-m.y)*(p.y-m.y)+(p.x-m.x)*(p.x-m.x))) d FROM voxels p JOIN m ON true WHERE p.channel<>'R' GROUP BY 1,2,3,4,5)"


@query(f"{SHELLS3} SELECT channel, CAST(floor(round(d/2,9)) AS INT) AS shell, count(*) AS n, round(avg(value),4) AS mean FROM d GROUP BY 1,2")
def k12_shells_3d(spark, sf):
    """Both other channels by distance from the bright voxels of one, in three dimensions."""
    v = _v(spark, sf)
    one = v.where("channel = 'R' AND value >= 50").drop("channel", "value")
    others = [v.where(f"channel = '{c}'") for c in "AN"]
    mask = one.select(F.explode(F.array(*[F.lit(c) for c in "AN"])).alias("channel"), "z", "y", "x")
    return rounded(K.shells(others[0].unionByName(others[1]), mask, ["channel"], 2.0, axes=("z", "y", "x"), scale={"z": 3.0})["shells"])


GLCM = "c AS (SELECT {by} a.q i, b.q j FROM q a JOIN (VALUES (0,1),(1,0),(1,1),(1,-1)) o(dy,dx) ON true JOIN q b ON {on} AND b.y=a.y+o.dy AND b.x=a.x+o.dx), s AS (SELECT {k} i, j FROM c UNION ALL SELECT {k} j, i FROM c), p AS (SELECT {k} i, j, count(*)/sum(count(*)) OVER (PARTITION BY {kk}) p, sum(count(*)) OVER (PARTITION BY {kk})/2 pairs FROM s GROUP BY {k} i, j)"


@query(f"{G}, q AS (SELECT channel, y, x, CAST(least(7,greatest(0,floor((value-0)/50*8))) AS INT) q FROM flat), {GLCM.format(by='a.channel,', on='a.channel=b.channel', k='channel,', kk='channel')}, m AS (SELECT channel, sum(p*i) m, sum(p*i*i) s FROM p GROUP BY 1) SELECT channel, round(sum(p*(i-j)*(i-j)),4) AS contrast, round(-sum(p*ln(p))/ln(64.0),5) AS entropy, round(sum(p/(1+abs(i-j))),5) AS homogeneity, round(sum(p*p),5) AS asm, round((sum(p*i*j)-max(m)*max(m))/(max(s)-max(m)*max(m)),4) AS correlation FROM p JOIN m USING (channel) GROUP BY 1")
def k13_glcm(spark, sf):
    out = K.glcm(_flat(spark, sf), ["channel"], 8, 0.0, 50.0)
    return out.select("channel", F.round("contrast", 4).alias("contrast"), F.round("entropy", 5).alias("entropy"), F.round("homogeneity", 5).alias("homogeneity"), F.round("asm", 5).alias("asm"), F.round("correlation", 4).alias("correlation"))


@query(f"{G}, q AS (SELECT channel, y//8*8+x//8+1 AS label, y, x, CAST(least(7,greatest(0,floor((value-0)/50*8))) AS INT) q FROM flat), {GLCM.format(by='a.channel, a.label,', on='a.channel=b.channel AND a.label=b.label', k='channel, label,', kk='channel, label')} SELECT channel, label, round(sum(p*(i-j)*(i-j))+1e-9,4) AS contrast, round(abs(-sum(p*log2(p)))+1e-9,4) AS entropy, round(sum(p/(1+(i-j)*(i-j)))+1e-9,5) AS homogeneity, round(sum(p*p)+1e-9,5) AS asm FROM p WHERE pairs>=16 GROUP BY 1,2")
def k14_object_glcm(spark, sf):
    v = _flat(spark, sf).withColumn("label", (F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8) + 1).cast("long"))
    out = K.object_glcm(v, ["channel"], 8, 0.0, 50.0)
    # the small amount keeps values halfway between two results of rounding on one side in both engines
    digits = {"contrast": 4, "entropy": 4, "homogeneity": 5, "asm": 5}
    return out.select("channel", "label", *[F.round(F.col(c) + 1e-9, d).alias(c) for c, d in digits.items()])


@query(f"{G}, b AS (SELECT channel, s, sum(value) v FROM flat JOIN (VALUES (1),(2),(4),(8)) q(s) ON true GROUP BY channel, s, y//s, x//s), p AS (SELECT channel, s, v/sum(v) OVER (PARTITION BY channel, s) p FROM b), w AS (SELECT channel, q, s, sum(pow(p,q)*ln(p))/sum(pow(p,q)) y FROM p JOIN (VALUES (-2.0::DOUBLE),(0.0),(2.0)) t(q) ON true GROUP BY 1,2,3) SELECT channel, q, round(regr_slope(y,ln(s)),4) AS slope FROM w GROUP BY 1,2")
def k16_scale_divergence(spark, sf):
    return rounded(K.scale_divergence(_flat(spark, sf), ["channel"], [1, 2, 4, 8]))


@query(f"{PAIR}, r AS (SELECT dy, dx, corr(p.a, q.b) r FROM ab p JOIN range(-2,3) i(dy) ON true JOIN range(-2,3) j(dx) ON true JOIN ab q ON q.y=p.y+dy AND q.x=p.x+dx GROUP BY 1,2) SELECT CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, round(r,5) AS r FROM r ORDER BY round(r,9) DESC, abs(dy)+abs(dx), dy, dx LIMIT 1")
def k17_ccf(spark, sf):
    ab = _pair(spark, sf)
    out = K.cross_correlation(ab.select("g", "y", "x", F.col("a").alias("value")), ab.select("g", "y", "x", F.col("b").alias("value")), ["g"], 2)
    return rounded(out.drop("g"), 5)


@query(f"{PAIR} SELECT round(corr(a,b),5) AS pearson, round(sum(CASE WHEN b>30 THEN a ELSE 0 END)/sum(a),5) AS m1, round(sum(CASE WHEN a>30 THEN b ELSE 0 END)/sum(b),5) AS m2 FROM ab")
def k19_manders(spark, sf):
    return rounded(K.manders(_pair(spark, sf), ["g"], 30.0, 30.0).drop("g"), 5)


@query()
def k20_costes(spark, sf):
    return K.costes(_pair(spark, sf).withColumn("b", (F.col("a") + F.col("b")) / 2), ["g"])


@query(f"{PAIR}, n AS (SELECT p.y, p.x, corr(q.a,q.b) r, var_pop(q.a) va, var_pop(q.b) vb FROM ab p JOIN ab q ON abs(p.y-q.y)<=2 AND abs(p.x-q.x)<=2 GROUP BY 1,2) SELECT y, x, round(r,4)+0.0 AS r FROM n")
def k31_local_correlation(spark, sf):
    return rounded(K.local_correlation(_pair(spark, sf), ["g"], 2).select("y", "x", "r"))


@query(f"{PAIR}, h AS (SELECT least(15,greatest(0,floor((a-0)/51*16))) i, least(15,greatest(0,floor((b-0)/51*16))) j, count(*)/sum(count(*)) OVER () p FROM ab GROUP BY 1,2), e AS (SELECT -sum(p*ln(p)) h FROM h), ea AS (SELECT -sum(p*ln(p)) h FROM (SELECT sum(p) p FROM h GROUP BY i)), eb AS (SELECT -sum(p*ln(p)) h FROM (SELECT sum(p) p FROM h GROUP BY j)) SELECT round(2*(ea.h+eb.h-e.h)/(ea.h+eb.h),6) AS nmi FROM e, ea, eb")
def k23_nmi(spark, sf):
    return rounded(K.mutual_information(_pair(spark, sf), ["g"], 16, 0.0, 51.0).drop("g"), 6)


KERNEL = [(dy, dx, (2 - abs(dy)) * (2 - abs(dx)) / 16) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


@query(f"{G} SELECT a.channel, a.y, a.x, round(sum(b.value*(2-abs(a.y-b.y))*(2-abs(a.x-b.x))/16.0::DOUBLE),8) AS value FROM flat a JOIN flat b ON a.channel=b.channel AND abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1 GROUP BY 1,2,3")
def k24_convolve(spark, sf):
    return rounded(K.convolve(_flat(spark, sf), ["channel"], KERNEL), 8)


@query(f"{G}, d AS (SELECT c.channel, (e.value-w.value)/2 gx, (s.value-n.value)/2 gy FROM flat c JOIN flat e ON c.channel=e.channel AND c.y=e.y AND e.x=c.x+1 JOIN flat w ON c.channel=w.channel AND c.y=w.y AND w.x=c.x-1 JOIN flat s ON c.channel=s.channel AND c.x=s.x AND s.y=c.y+1 JOIN flat n ON c.channel=n.channel AND c.x=n.x AND n.y=c.y-1), t AS (SELECT channel, sum(gx*gx) xx, sum(gy*gy) yy, sum(gx*gy) xy FROM d GROUP BY 1) SELECT channel, round(sqrt(pow(xx-yy,2)+4*xy*xy)/(xx+yy),5) AS coherency, round(atan2(2*xy,xx-yy)/2,5) AS angle FROM t")
def k26_anisotropy(spark, sf):
    return rounded(K.anisotropy(_flat(spark, sf), ["channel"]), 5)


@query()
def k27_periodicity(spark, sf):
    return K.periodicity(_flat(spark, sf), ["channel"], 64, 8)


@query(f"{G}, u AS (SELECT p.y, p.x, p.value target, q.value c1, r.value c2 FROM flat p JOIN flat q ON p.channel='A' AND q.channel='N' AND p.y=q.y AND p.x=q.x JOIN flat r ON r.channel='R' AND p.y=r.y AND p.x=r.x), s AS (SELECT sum(c1*c1) s11, sum(c1*c2) s12, sum(c2*c2) s22, sum(c1*target) t1, sum(c2*target) t2 FROM u WHERE target<=30 AND greatest(target,c1,c2)<50), f AS (SELECT (t1*s22-t2*s12)/(s11*s22-s12*s12) a, (t2*s11-t1*s12)/(s11*s22-s12*s12) b FROM s) SELECT y, x, round(least(65535,greatest(0,target-greatest(0,a)*c1-greatest(0,b)*c2))) AS corrected FROM u, f")
def k28_unmix(spark, sf):
    f = _flat(spark, sf)
    one = lambda c, n: f.where(f"channel = '{c}'").select("y", "x", F.col("value").alias(n))
    u = one("A", "target").join(one("N", "c1"), ["y", "x"]).join(one("R", "c2"), ["y", "x"]).withColumn("g", F.lit(1))
    return K.unmix(u, ["g"], 30.0, 50.0).select("y", "x", "corrected")


@query(f"{G} SELECT a.channel, a.y, a.x, round(sum(b.value),3) AS total FROM flat a JOIN flat b ON a.channel=b.channel AND abs(a.y-b.y)<=2 AND abs(a.x-b.x)<=2 WHERE a.channel='N' GROUP BY 1,2,3")
def k30_local_sums(spark, sf):
    v = _flat(spark, sf).where("channel = 'N'")
    return rounded(K.local_sums(v, ["channel"], "value", 2).drop("value"), 3)


@query(f"{PAIR} SELECT y, x, a>=30 AND b<=40 AS keep FROM ab")
def k32_veto(spark, sf):
    return K.veto(_pair(spark, sf), ["g"], 30.0, 40.0).select("y", "x", "keep")


COMP = f"{G}, m AS (SELECT y, x, y::BIGINT*4294967296+x AS id FROM flat WHERE channel='A' AND value>=42)"


@query(f"WITH RECURSIVE {COMP[5:]}, e AS (SELECT a.id a, b.id b FROM m a JOIN m b ON abs(a.y-b.y)+abs(a.x-b.x)=1), w AS (SELECT id AS id, id AS root FROM m UNION SELECT e.b, w.root FROM w JOIN e ON e.a=w.id WHERE w.root < e.b) SELECT m.y, m.x, min(root) AS label FROM w JOIN m USING (id) GROUP BY 1,2")
def k35_components(spark, sf):
    return K.components(_flat(spark, sf).where("channel = 'A' AND value >= 42").withColumn("g", F.lit(1)), ["g"]).select("y", "x", F.col("label").cast("long").alias("label"))


LAB = "flatlab AS (SELECT DISTINCT channel, y, x, y//8*8+x//8+1 AS label FROM labels)"


def _lab(spark, sf):
    return labels(spark, sf).select("channel", "y", "x", "label").distinct()


@query(f"WITH {GRID}, o AS (SELECT label, avg(v.value) FILTER (v.channel='A') AS target, avg(v.value) FILTER (v.channel='N') AS contaminant, count(*) FILTER (v.channel='N' AND v.value>=40)/count(*)::DOUBLE AS overlap FROM (SELECT DISTINCT z,y,x,label FROM labels WHERE channel='A') l JOIN voxels v USING (z,y,x) GROUP BY 1) SELECT label, round(contaminant/target,5) AS ratio, round(greatest(0,1-0.5*least(1,coalesce(contaminant/target,1))-0.5*least(1,overlap)),5) AS score, CASE WHEN coalesce(contaminant/target,1)>0.8 AND overlap>0.06 THEN 'ratio;overlap' WHEN coalesce(contaminant/target,1)>0.8 THEN 'ratio' WHEN overlap>0.06 THEN 'overlap' ELSE '' END AS reasons FROM o")
def k36_contamination(spark, sf):
    l = labels(spark, sf).where("channel = 'A'").select("z", "y", "x", "label")
    v = l.join(_v(spark, sf), ["z", "y", "x"])
    o = v.groupBy("label").agg(F.avg(F.when(F.col("channel") == "A", F.col("value"))).alias("target"), F.avg(F.when(F.col("channel") == "N", F.col("value"))).alias("contaminant"), (F.sum(F.when((F.col("channel") == "N") & (F.col("value") >= 40), 1).otherwise(0)) / F.count("*")).alias("overlap"))
    return rounded(K.contamination(o, 0.8, 0.06).select("label", "ratio", "score", "reasons"), 5)


@query("WITH s AS (SELECT o_orderstatus='O' AS control, o_totalprice AS metric FROM orders), t AS (SELECT 100000.0::DOUBLE+i*50000.0::DOUBLE AS threshold FROM range(0,9) r(i)), o AS (SELECT threshold, avg(CASE WHEN control THEN (metric>=threshold)::INT END) fpr, avg(CASE WHEN NOT control THEN (metric>=threshold)::INT END) retention FROM s JOIN t ON true GROUP BY 1), b AS (SELECT threshold FROM o WHERE fpr<=0.5 ORDER BY retention DESC, threshold LIMIT 1) SELECT threshold, round(fpr,5) AS fpr, round(retention,5) AS retention, threshold=(SELECT threshold FROM b) AS best FROM o")
def k37_roc_search(spark, sf):
    s = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_orderstatus") == "O").alias("control"), F.col("o_totalprice").alias("metric"))
    return rounded(K.roc_search(s, 100000.0, 500000.0, 50000.0, 0.5), 5)


THRESHOLDS = [30.0, 40.0, 44.0, 46.0, 48.0, 49.0, 50.0]


@query()
def k37_object_counts(spark, sf):
    """Voxels and objects of each channel at every threshold, of one forest."""
    return object_counts(_v(spark, sf), ["channel"], THRESHOLDS)


@query()
def k37_roc_objects(spark, sf):
    """The threshold that leaves objects in few odd slices (the controls) and in most even ones."""
    counts = object_counts(_v(spark, sf).withColumn("image", F.col("z")), ["channel", "image"], THRESHOLDS)
    return roc_of_counts(counts.withColumn("control", F.col("image") % 2 == 1), "objects", 0.5)


@query(f"WITH {GRID}, {LAB}, k AS (SELECT a.channel, a.label, a.y, a.x, count(b.label) k FROM flatlab a LEFT JOIN flatlab b ON a.channel=b.channel AND a.label=b.label AND abs(a.y-b.y)+abs(a.x-b.x)=1 GROUP BY 1,2,3,4) SELECT channel, label, count(*) AS area, count(*) FILTER (k<4) AS perimeter, round(least(1.0,4*pi()*count(*)/pow(count(*) FILTER (k<4),2)),5) AS circularity, round(greatest(max(x)-min(x)+1,max(y)-min(y)+1)/least(max(x)-min(x)+1,max(y)-min(y)+1)::DOUBLE,5) AS aspect, round(count(*)/((max(x)-min(x)+1)*(max(y)-min(y)+1))::DOUBLE,5) AS extent FROM k GROUP BY 1,2")
def k40_shape2d(spark, sf):
    return rounded(K.shape2d(_lab(spark, sf), ["channel"]), 5)


# a side of the hull is a pair of row ends with no pixel on its right, and none on its line beyond it
HULL = f"WITH {GRID}, {LAB}, n AS (SELECT channel, label, count(*) n FROM flatlab GROUP BY 1,2 HAVING count(*)>=3), e AS (SELECT DISTINCT channel, label, y, unnest([x0, x1]) AS x FROM (SELECT channel, label, y, min(x) x0, max(x) x1 FROM flatlab GROUP BY 1,2,3)), p AS (SELECT a.channel, a.label, a.x ax, a.y ay, b.x bx, b.y AS by_ FROM e a JOIN e b ON a.channel=b.channel AND a.label=b.label AND (a.x<>b.x OR a.y<>b.y)), s AS (SELECT p.channel, p.label, ax, ay, bx, by_ FROM p JOIN e c ON p.channel=c.channel AND p.label=c.label GROUP BY ALL HAVING min((bx-ax)*(c.y-ay)-(by_-ay)*(c.x-ax))>=0 AND bool_and((bx-ax)*(c.y-ay)-(by_-ay)*(c.x-ax)<>0 OR ((c.x-ax)*(c.x-bx)+(c.y-ay)*(c.y-by_))<=0)), h AS (SELECT channel, label, sum(ax*by_-bx*ay)/2.0 a FROM s GROUP BY 1,2), f AS (SELECT channel, label, sqrt(max((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_))) f FROM p GROUP BY 1,2)"


@query(f"{HULL} SELECT channel, label, n::DOUBLE AS area, greatest(coalesce(a,0),n)::DOUBLE AS hull_area, round(n/greatest(coalesce(a,0),n),6) AS solidity, round(f,6) AS feret FROM n LEFT JOIN h USING (channel, label) LEFT JOIN f USING (channel, label)")
def k40_outlines(spark, sf):
    return rounded(outlines(_lab(spark, sf), ["channel"]).select("channel", "label", "area", "hull_area", "solidity", "feret"), 6)


@query()
def k40_calipers(spark, sf):
    """Corners, least widths and angles of the same outlines."""
    return outlines(_lab(spark, sf), ["channel"]).select("channel", "label", "hull", "least_feret", "feret_angle")


LACUNARITY = f"WITH {GRID}, {LAB}, b AS (SELECT channel, label, min(y) y0, max(y) y1, min(x) x0, max(x) x1, max(y)-min(y)+1 h, max(x)-min(x)+1 w, ceil(greatest(max(y)-min(y)+1,max(x)-min(x)+1)/4.0)::INT pad FROM flatlab GROUP BY 1,2 HAVING max(y)-min(y)+1>=8 AND max(x)-min(x)+1>=8), q AS (SELECT unnest([1,2,4,8,16,32,64]) r), c AS (SELECT channel, label, r, count(DISTINCT ((y-y0)//r)*1000+(x-x0)//r) n FROM flatlab JOIN b USING (channel, label) JOIN q ON r<=greatest(h,w) GROUP BY 1,2,3), d AS (SELECT channel, label, -regr_slope(ln(n),ln(r)) d, regr_r2(ln(n),ln(r)) r2 FROM c GROUP BY 1,2 HAVING count(*)>=3), o AS (SELECT channel, label, r, y0-pad+i AS cy, x0-pad+j AS cx FROM b JOIN q ON r<=least(h,w)+2*pad, unnest(range(h+2*pad-r+1)) AS u(i), unnest(range(w+2*pad-r+1)) AS t(j)), m AS (SELECT o.channel, o.label, r, cy, cx, count(f.y) m FROM o LEFT JOIN flatlab f ON f.channel=o.channel AND f.label=o.label AND f.y>=cy AND f.y<cy+r AND f.x>=cx AND f.x<cx+r GROUP BY 1,2,3,4,5), l AS (SELECT channel, label, r, avg(m*m)/(avg(m)*avg(m)) l FROM m GROUP BY 1,2,3)"


@query(f"{LACUNARITY} SELECT channel, label, round(any_value(d),4) AS dimension, round(any_value(r2),4) AS r2, any_value(r2>=0.9) AS reliable, round(avg(l),5) AS lacunarity, round(coalesce(stddev_samp(l),0),5) AS lacunarity_sd FROM l JOIN d USING (channel, label) GROUP BY 1,2")
def k42_fractal(spark, sf):
    out = fractal(_lab(spark, sf), ["channel"])
    return out.select("channel", "label", F.round("dimension", 4).alias("dimension"), F.round("r2", 4).alias("r2"), "reliable", F.round("lacunarity", 5).alias("lacunarity"), F.round("lacunarity_sd", 5).alias("lacunarity_sd"))


# channel A without what N adds everywhere and R where it is bright; values as whole numbers
MODEL = f"{G}, u AS (SELECT p.y, p.x, round(p.value*100) t, round(q.value*100) a, round(r.value*100) s FROM flat p JOIN flat q ON p.channel='A' AND q.channel='N' AND p.y=q.y AND p.x=q.x JOIN flat r ON r.channel='R' AND p.y=r.y AND p.x=r.x), l AS (SELECT quantile_disc(t,0.5) qt, quantile_disc(s,0.5) qs FROM u), ks AS (SELECT greatest(0,coalesce(sum(s*a)/nullif(sum(a*a),0),0)) k FROM u, l WHERE greatest(t,a,s)<5000 AND s<=qs AND a>0), kt AS (SELECT greatest(0,coalesce(sum(t*a)/nullif(sum(a*a),0),0)) k FROM u, l WHERE greatest(t,a,s)<5000 AND t<=qt AND a>0), w AS (SELECT p.y, p.x, count(*) n, sum(q.t*q.a) ta, sum(q.a*q.a) aa FROM u p JOIN u q ON abs(p.y-q.y)<=12 AND abs(p.x-q.x)<=12 JOIN l ON greatest(q.t,q.a,q.s)<5000 AND q.t<=qt GROUP BY 1,2), f AS (SELECT u.*, CASE WHEN n>=50 AND aa>1e-12 THEN greatest(0,ta/aa) ELSE kt.k END AS local_1, floor(least(65535,greatest(0,s-ks.k*a))+0.5) p FROM u LEFT JOIN w ON u.y=w.y AND u.x=w.x JOIN ks ON true JOIN kt ON true), g AS (SELECT *, floor(least(65535,greatest(0,t-local_1*a))+0.5) f1 FROM f), z AS (SELECT quantile_disc(p,0.9) bp, quantile_disc(f1,0.5) tf FROM g), b AS (SELECT CASE WHEN count(*)>=50 THEN greatest(0,coalesce(sum(f1*p)/nullif(sum(p*p),0),0)) ELSE 0 END AS k FROM g, z WHERE greatest(t,a,s)<5000 AND f1<=tf AND p>=bp AND p>0)"


@query(f"{MODEL} SELECT y, x, round(local_1,6) AS local_1, round(b.k,6) AS bleed_1, floor(least(65535,greatest(0,f1-b.k*p))+0.5)::DOUBLE AS corrected FROM g, b")
def k34_forward_model(spark, sf):
    f = _flat(spark, sf)
    one = lambda c, n: f.where(f"channel = '{c}'").select("y", "x", F.round(F.col("value") * 100).alias(n))
    u = one("A", "t").join(one("N", "a").hint("merge"), ["y", "x"]).join(one("R", "s").hint("merge"), ["y", "x"]).withColumn("g", F.lit(1))
    return rounded(forward_model(u, ["g"], "t", ["a"], ["s"], reach=12, saturated=5000.0).select("y", "x", "local_1", "bleed_1", "corrected"), 6)


@query()
def k34_forward_model_joint(spark, sf):
    """Both other channels as sources and autos in turn, alternating until the shares stand still."""
    f = _flat(spark, sf)
    one = lambda c, n: f.where(f"channel = '{c}'").select("y", "x", F.round(F.col("value") * 100).alias(n))
    u = one("A", "t").join(one("N", "a").hint("merge"), ["y", "x"]).join(one("R", "s").hint("merge"), ["y", "x"]).withColumn("g", F.lit(1))
    return forward_model(u, ["g"], "t", ["a"], ["s"], reach=12, saturated=5000.0, rounds=6).select("y", "x", "local_1", "bleed_1", "corrected")


@query()
def k41_shape3d(spark, sf):
    return K.shape3d(labels(spark, sf), ["channel"])


FORM = f"WITH {GRID}, i AS (SELECT a.channel, a.label, count(*) n FROM labels a JOIN labels b ON a.channel=b.channel AND a.label=b.label AND abs(a.x-b.x)+abs(a.y-b.y)+abs(a.z-b.z)=1 GROUP BY 1,2), t AS (SELECT channel, label, count(*) n, avg(z) cz, avg(y) cy, avg(x) cx FROM labels GROUP BY 1,2), d AS (SELECT channel, label, sqrt(4*(z-cz)*(z-cz)+(y-cy)*(y-cy)+(x-cx)*(x-cx)) d FROM labels JOIN t USING (channel, label)), m AS (SELECT channel, label, min(d) lo, max(d) hi, avg(d) m, stddev_pop(d) s FROM d GROUP BY 1,2), f AS (SELECT t.channel, t.label, t.n, 6*t.n-coalesce(i.n,0) s FROM t LEFT JOIN i USING (channel, label))"


@query(f"{FORM} SELECT channel, label, n, f.s AS faces, round(pow(pi(),1.0::DOUBLE/3)*pow(6*n,2.0::DOUBLE/3)/f.s,5) AS sphericity, round(36*pi()*n*n/(f.s::DOUBLE*f.s*f.s),5) AS compactness, round(lo,5) AS centre_least, round(hi,5) AS centre_most, round(m,5) AS centre_mean, round(m.s,5) AS centre_sd FROM f JOIN m USING (channel, label)")
def k41_form3d(spark, sf):
    return rounded(K.form3d(labels(spark, sf), ["channel"], (2.0, 1.0, 1.0)).drop("elongation", "flatness"), 5)


@query(f"WITH {GRID}, {LAB}, n AS (SELECT channel, label, r, count(DISTINCT (y//r)*1000+x//r) n FROM flatlab JOIN (VALUES (1),(2),(4)) q(r) ON true GROUP BY 1,2,3) SELECT channel, label, round(-regr_slope(ln(n),ln(r)),4) AS dimension FROM n GROUP BY 1,2")
def k42_box_count(spark, sf):
    return rounded(K.box_count(_lab(spark, sf), ["channel"], [1, 2, 4]).drop("r2"))


SKEL = f"{G}, s AS (SELECT channel, y, x, sqrt((y-32)*(y-32)+(x-32)*(x-32)) d FROM flat WHERE value>=44)"


def _skeleton(spark, sf):
    return _flat(spark, sf).where("value >= 44").select("channel", "y", "x")


@query(f"{SKEL} SELECT a.channel, r*4.0::DOUBLE AS r, count(*) AS crossings FROM s a JOIN (VALUES (0,1),(1,0),(1,1),(1,-1)) o(dy,dx) ON true JOIN s b ON a.channel=b.channel AND b.y=a.y+dy AND b.x=a.x+dx JOIN range(1,9) t(r) ON least(a.d,b.d)<r*4 AND greatest(a.d,b.d)>=r*4 GROUP BY 1,2")
def k43_sholl(spark, sf):
    return K.sholl(_skeleton(spark, sf), ["channel"], (32.0, 32.0), 4.0, 8)


RINGS = f"{SKEL}, c AS (SELECT a.channel, r*4.0::DOUBLE AS r, count(*) AS n FROM s a JOIN (VALUES (0,1),(1,0),(1,1),(1,-1)) o(dy,dx) ON true JOIN s b ON a.channel=b.channel AND b.y=a.y+dy AND b.x=a.x+dx JOIN range(1,9) t(r) ON least(a.d,b.d)<r*4 AND greatest(a.d,b.d)>=r*4 GROUP BY 1,2)"


@query(f"{RINGS} SELECT channel, max(n) AS critical, arg_max(r, n*1000-r) AS critical_radius, arg_min(n, r) AS \"primary\", round(max(n)/arg_min(n, r)::DOUBLE,6) AS schoenen FROM c GROUP BY 1")
def k43_sholl_summary(spark, sf):
    return rounded(K.sholl_summary(K.sholl(_skeleton(spark, sf), ["channel"], (32.0, 32.0), 4.0, 8), ["channel"]), 6)


@query(f"{SKEL}, k AS (SELECT a.channel, a.y, a.x, count(b.y) k FROM s a LEFT JOIN s b ON a.channel=b.channel AND abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1 AND NOT (a.y=b.y AND a.x=b.x) GROUP BY 1,2,3) SELECT channel, count(*) FILTER (k=1) AS endpoints, count(*) FILTER (k>=3) AS junctions, count(*) AS length FROM k GROUP BY 1")
def k43_skeleton(spark, sf):
    return K.skeleton_nodes(_skeleton(spark, sf), ["channel"])


@query(f"{G}, {LAB}, c AS (SELECT channel, label, avg(y) cy, avg(x) cx FROM flatlab GROUP BY 1,2), d AS (SELECT l.*, sqrt((y-cy)*(y-cy)+(x-cx)*(x-cx)) d FROM flatlab l JOIN c USING (channel, label)), t AS (SELECT *, max(d) OVER (PARTITION BY channel, label) top FROM d) SELECT channel, label, CAST(CASE WHEN top>0 THEN least(4,floor(round(d/top*5,9))) ELSE 0 END AS INT) AS bin, round(avg(value),4) AS mean FROM t JOIN flat USING (channel, y, x) GROUP BY 1,2,3")
def k45_radial_profile(spark, sf):
    return rounded(K.radial_profile(_lab(spark, sf), _flat(spark, sf), ["channel"], 5))


@query(f"WITH {GRID} SELECT channel, z, round(avg((value>=50)::INT),6) AS saturated, round((max(value)-min(value))/50,6) AS range_use, round(stddev_pop(value)/avg(value),6) AS cv FROM voxels GROUP BY 1,2")
def k46_image_quality(spark, sf):
    return rounded(K.image_quality(_v(spark, sf), ["channel", "z"], 50.0), 6)


@query(f"WITH {GRID}, m AS (SELECT z, max(m) m FROM (SELECT z, channel, avg(value) m FROM voxels GROUP BY 1,2) GROUP BY 1) SELECT min(z) AS first, max(z) AS last FROM m WHERE m > (SELECT min(m)+0.05*(max(m)-min(m)) FROM m)".replace("AS first", 'AS "first"').replace("AS last", 'AS "last"'))
def k47_signal_slices(spark, sf):
    return K.signal_slices(_v(spark, sf).withColumn("g", F.lit(1)), ["g"], "channel").drop("g")


@query(f"{G} SELECT channel, x AS y, y AS x, round(value,4) AS value FROM flat")
def k48_orient(spark, sf):
    return rounded(K.orient(_flat(spark, sf), 64, 64, turns=1, flip=True))


@query(f"WITH {GRID} SELECT channel, label, count(*) AS voxels, round(avg(x),4) AS x, round(avg(y),4) AS y, round(avg(z),4) AS z, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM labels GROUP BY 1,2")
def d01_objects_from_labels(spark, sf):
    return rounded(K.objects_from_labels(labels(spark, sf), ["channel"]))


@query(f"WITH {GRID} SELECT l.channel, l.label, round(count(*)*0.5,4) AS volume, round(sum(value),3) AS intden, round(avg(value),4) AS mean, round(sum(value*l.x)/sum(value),4) AS cx, round(sum(value*l.y)/sum(value),4) AS cy, round(sum(value*l.z)/sum(value),4) AS cz FROM labels l JOIN voxels v ON l.channel=v.channel AND l.z=v.z AND l.y=v.y AND l.x=v.x GROUP BY 1,2")
def d02_object_intensity(spark, sf):
    out = rounded(K.object_intensity(labels(spark, sf), _v(spark, sf), ["channel"], 0.5))
    return out.withColumn("intden", F.round("intden", 3))


@query(f"WITH {GRID}, i AS (SELECT a.channel, a.label, count(*) n FROM labels a JOIN labels b ON a.channel=b.channel AND a.label=b.label AND abs(a.x-b.x)+abs(a.y-b.y)+abs(a.z-b.z)=1 GROUP BY 1,2), t AS (SELECT channel, label, count(*) n FROM labels GROUP BY 1,2) SELECT t.channel, t.label, 6*t.n-coalesce(i.n,0) AS faces FROM t LEFT JOIN i USING (channel, label)")
def d03_surface(spark, sf):
    return K.surface(labels(spark, sf), ["channel"])
