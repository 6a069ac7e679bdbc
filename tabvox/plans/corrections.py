"""Corrections, colocalisation by chance, depth, sweeps and object features over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvox.operators import corrections as C
from tabvox.operators import pixels as K
from tabvox.operators import points as P
from tabvox.plans.base import query, rounded
from tabvox.plans.joins import GRID, labels
from tabvox.plans.pixels import PAIR, G, _flat, _pair
from tabvox.plans.points import FEATURES, WIN, _nn, _points, _vectors
from tabvox.sources.driver import role



@query(f"WITH {GRID}, i AS (SELECT a.channel, a.label, count(*) n FROM labels a JOIN labels b ON a.channel=b.channel AND a.label=b.label AND abs(a.x-b.x)+abs(a.y-b.y)+abs(a.z-b.z)=1 GROUP BY 1,2), t AS (SELECT l.channel, l.label, count(*) AS volume, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS least, max(value) AS most, avg(l.z) AS z FROM labels l JOIN voxels v ON l.channel=v.channel AND l.z=v.z AND l.y=v.y AND l.x=v.x GROUP BY 1,2), f AS (SELECT t.*, 6*volume-coalesce(n,0) AS faces FROM t LEFT JOIN i USING (channel, label)), w AS (SELECT a.channel, a.label, sqrt(max((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS feret FROM (SELECT DISTINCT channel, label, y, x FROM labels) a JOIN (SELECT DISTINCT channel, label, y, x FROM labels) b ON a.channel=b.channel AND a.label=b.label GROUP BY 1,2) SELECT channel, label, volume, faces, round(feret,5) AS feret, round(pow(pi(),1/3.0::DOUBLE)*pow(6.0::DOUBLE*volume,2/3.0::DOUBLE)/faces,5) AS sphericity, round(36*pi()*volume*volume/pow(faces::DOUBLE,3),5) AS compactness, round(mean,4) AS mean, round(sd,3) AS sd, round(least,4) AS least, round(most,4) AS most, round(z,4) AS z FROM f JOIN w USING (channel, label)")
def d34_object_features(spark, sf):
    out = K.object_features(labels(spark, sf), role(spark, sf, "voxels"), ["channel"])
    digits = {"feret": 5, "sphericity": 5, "compactness": 5, "mean": 4, "sd": 3, "least": 4, "most": 4, "z": 4}
    return out.select("channel", "label", "volume", "faces", *[(F.round(c, d) + F.lit(0.0)).alias(c) for c, d in digits.items()])


@query()
def i16_permutation_p(spark, sf):
    samples = role(spark, sf, "samples").withColumn("id", F.concat_ws("|", "subject", "condition"))
    return C.permutation_p(samples, ["metric"], "id", "condition", "value")


@query(f"{WIN} SELECT section, round(least(x1-x0,y1-y0)/4*i/10,5) AS radius FROM win JOIN range(1,11) q(i) ON true")
def j03_radii(spark, sf):
    return rounded(P.radii(P.window(_points(spark, sf), _nn(spark, sf), ["section"]), ["section"]), 5)


@query()
def j19_assign_centroids(spark, sf):
    z = P.zscore(_vectors(spark, sf), FEATURES)
    _, model = P.kmeans(z, FEATURES, 4)
    return P.assign(z, P.centroids(model, FEATURES, spark), FEATURES).select("id", "cluster", "distance")


@query(f"{G}, m AS (SELECT y, x, value FROM flat WHERE channel='A' AND value>=20), e AS (SELECT * FROM m WHERE (SELECT count(*) FROM m n WHERE abs(n.y-m.y)+abs(n.x-m.x)=1)<4), d AS (SELECT m.y, m.x, m.value, min(sqrt((m.y-e.y)*(m.y-e.y)+(m.x-e.x)*(m.x-e.x))) d FROM m JOIN e ON true GROUP BY 1,2,3), b AS (SELECT floor(round(d,9)) bin, avg(value) v FROM d GROUP BY 1) SELECT round(regr_slope(value,d),4) AS slope, (SELECT bin+0.5 FROM b ORDER BY round(v,9) DESC, bin LIMIT 1) AS peak, round(avg(value) FILTER (d<=1)/avg(value) FILTER (d>1),4) AS rim_core, round((avg(value) FILTER (d<=1)-avg(value) FILTER (d>1))/avg(value),4) AS edge FROM d")
def k11_depth_profile(spark, sf):
    v = _flat(spark, sf).where("channel = 'A' AND value >= 20")
    return rounded(C.depth_profile(v, v, ["channel"], 1.0, 1.0)["summary"].drop("channel"))


@query()
def k15_texture_classes(spark, sf):
    return C.texture_classes(_flat(spark, sf), ["channel"])


@query(f"{PAIR}, o AS (SELECT dy, dx, CAST(floor(sqrt(dy*dy+dx*dx)+0.5) AS INT) AS radius FROM range(-3,4) i(dy), range(-3,4) j(dx)), s AS (SELECT radius, avg(p.a*q.b) m FROM ab p JOIN o ON radius<=3 JOIN ab q ON q.y=p.y+dy AND q.x=p.x+dx GROUP BY 1) SELECT radius, round(m/(SELECT avg(a)*avg(b) FROM ab),5) AS strength FROM s ORDER BY round(m/(SELECT avg(a)*avg(b) FROM ab),9) DESC, radius LIMIT 1")
def k18_mark_correlation(spark, sf):
    return rounded(C.mark_correlation(_pair(spark, sf), ["g"], 3).drop("g"), 5)


@query()
def k21_costes_p(spark, sf):
    return C.chance_correlation(_pair(spark, sf), ["g"]).drop("g")


@query(f"{PAIR} SELECT CAST(y//8*8+x//8+1 AS BIGINT) AS label, count(*) AS n, round(sum(CASE WHEN b>30 THEN a ELSE 0 END)/sum(a),4) AS m1, round(sum(CASE WHEN a>30 THEN b ELSE 0 END)/sum(b),4) AS m2 FROM ab GROUP BY 1")
def k22_object_coloc(spark, sf):
    ab = _pair(spark, sf).withColumn("label", (F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8) + 1).cast("long"))
    return rounded(C.object_coloc(ab, ["g"], 30.0, 30.0).select("label", "n", "m1", "m2"))


@query()
def k25_texture_vector(spark, sf):
    l = labels(spark, sf).select("channel", "label", "y", "x").distinct()
    return C.texture_vector(_flat(spark, sf), l, ["channel"])


CORR = f"{PAIR}, v AS (SELECT y, x, a*10 AS target, b*4 AS c1 FROM ab)"


def _target(spark, sf):
    return _pair(spark, sf).select("g", "y", "x", (F.col("a") * 10).alias("target"), (F.col("b") * 4).alias("c1"))


@query(f"{CORR}, f AS (SELECT sum(target*c1)/sum(c1*c1) k FROM v WHERE target<=300 AND greatest(target,c1)<480) SELECT y, x, least(65535,greatest(0,target-greatest(0,coalesce(k,0))*c1)) AS corrected FROM v, f".replace("least(65535", "round(least(65535").replace("*c1)) AS", "*c1))) AS"))
def k29_global_ratio(spark, sf):
    return C.global_ratio(_target(spark, sf), ["g"], 300.0, 480.0).select("y", "x", "corrected")


@query(f"{CORR}, q AS (SELECT y, x, target*c1 tc, c1*c1 cc FROM v WHERE target<=300 AND greatest(target,c1)<480), l AS (SELECT v.y, v.x, count(*) n, sum(tc) tc, sum(cc) cc FROM v JOIN q ON abs(v.y-q.y)<=2 AND abs(v.x-q.x)<=2 GROUP BY 1,2) SELECT v.y, v.x, round(least(65535,greatest(0,target-greatest(0,coalesce(CASE WHEN n>=4 AND cc>0 THEN l.tc/l.cc END,(SELECT sum(tc)/sum(cc) FROM q),0))*c1))) AS corrected FROM v LEFT JOIN l ON v.y=l.y AND v.x=l.x")
def k30_local_ratio(spark, sf):
    return C.local_ratio(_target(spark, sf), ["g"], 300.0, 480.0, 2, 4).select("y", "x", "corrected")


@query(f"{CORR}, t AS (SELECT max(c1) top, quantile_disc(c1,0.5) cut FROM v), s AS (SELECT least(7,floor(c1/top*8)) bin, target FROM v, t WHERE c1>=cut AND c1>0), l AS (SELECT bin, quantile_disc(target,0.9) e FROM s GROUP BY 1 HAVING count(*)>=5), e AS (SELECT i, coalesce((SELECT max(e) FROM l WHERE bin<=i),0) e FROM range(8) q(i)), p AS (SELECT y, x, target, c1/top*7 AS pos FROM v, t) SELECT y, x, round(least(65535,greatest(0,target-(lo.e+(hi.e-lo.e)*(pos-floor(pos)))))) AS adjusted FROM p JOIN e lo ON lo.i=floor(pos) JOIN e hi ON hi.i=ceil(pos)")
def k33_envelope(spark, sf):
    return C.envelope(_target(spark, sf), ["g"], ["c1"], 0.5, 0.9, 8, 5).select("y", "x", "adjusted")


SWEEP = [5.0, 10.0, 20.0, 25.0, 30.0, 40.0]


@query(f"{G}, s AS (SELECT channel, t AS threshold, count(*) FILTER (value>=t) AS area, avg(value) FILTER (value>=t) AS mean FROM flat JOIN (VALUES {','.join(f'({t}::DOUBLE)' for t in SWEEP)}) q(t) ON true GROUP BY 1,2), n AS (SELECT *, area/nullif(lag(area) OVER w,0) AS a, lead(area) OVER w/nullif(area,0) AS b FROM s WINDOW w AS (PARTITION BY channel ORDER BY threshold)) SELECT channel, threshold, area, round(round(mean,9),4) AS mean, round(round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a+b)/2 END,9),5) AS iou FROM n")
def k39_threshold_sweep(spark, sf):
    out = C.threshold_sweep(_flat(spark, sf), ["channel"], SWEEP)
    # nine digits first, so that the order of summing doesn't decide a half
    return out.select("channel", "threshold", "area", F.round(F.round("mean", 9), 4).alias("mean"), F.round(F.round("iou", 9), 5).alias("iou"))


@query()
def k39_sweep_choice(spark, sf):
    return C.sweep_choice(C.threshold_sweep(_flat(spark, sf), ["channel"], SWEEP), ["channel"])


@query(f"WITH {GRID}, m AS (SELECT channel, min(value) lo, max(value) hi FROM voxels GROUP BY 1), v AS (SELECT channel, value, least(255,floor((value-lo)/(hi-lo)*256)) bin FROM voxels JOIN m USING (channel)), h AS (SELECT channel, bin, count(*) c FROM v GROUP BY 1,2), w AS (SELECT *, sum(c) OVER o w0, sum(c*bin) OVER o s0, sum(c) OVER (PARTITION BY channel) n, sum(c*bin) OVER (PARTITION BY channel) s FROM h WINDOW o AS (PARTITION BY channel ORDER BY bin)), b AS (SELECT channel, bin, w0*(n-w0)*pow(s0/w0-(s-s0)/(n-w0),2)/pow(n,2) q FROM w WHERE w0<n), t AS (SELECT channel, bin AS split FROM b QUALIFY row_number() OVER (PARTITION BY channel ORDER BY round(q,9) DESC, bin)=1) SELECT channel, round(avg(value) FILTER (bin>split),4) AS foreground, round(stddev_pop(value) FILTER (bin<=split),4) AS background_sd, round(avg(value) FILTER (bin>split)/stddev_pop(value) FILTER (bin<=split),4) AS snr FROM v JOIN t USING (channel) GROUP BY 1")
def k49_split_quality(spark, sf):
    return rounded(C.split_quality(role(spark, sf, "voxels"), ["channel"]))
