"""Families of measures, their presets, waves, directions and profiles of objects over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvox.operators.background import background_cv, signal_db
from tabvox.operators.families import Preset, measure
from tabvox.operators.profiles import Profile, profiles
from tabvox.operators.spectrum import spectrum
from tabvox.operators.tensors import anisotropy3d
from tabvox.plans.base import query, rounded
from tabvox.plans.joins import GRID, labels
from tabvox.plans.pixels import G, _flat, _v

_LEVEL = "CAST(least(7,greatest(0,floor(value/50*8))) AS INT)"
_GLCM = f"q AS (SELECT channel, y, x, {_LEVEL} AS l FROM flat), o AS (SELECT a.channel, a.l AS i, b.l AS j FROM q a JOIN q b ON a.channel=b.channel AND ((b.y=a.y AND b.x=a.x+1) OR (b.y=a.y+1 AND b.x=a.x) OR (b.y=a.y+1 AND b.x=a.x+1) OR (b.y=a.y+1 AND b.x=a.x-1))), t AS (SELECT channel, avg((i-j)*(i-j)) AS contrast, avg(1.0::DOUBLE/(1+(i-j)*(i-j))) AS homogeneity FROM o GROUP BY 1)"
_BASE = "b AS (SELECT channel, count(*)::DOUBLE AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM flat GROUP BY 1)"
_LAG = "l AS (SELECT a.channel, corr(a.value,b.value) FILTER (b.x-a.x=1) AS lag1, corr(a.value,b.value) FILTER (b.x-a.x=2) AS lag2, corr(a.value,b.value) FILTER (b.x-a.x=4) AS lag4 FROM flat a JOIN flat b ON a.channel=b.channel AND a.y=b.y AND b.x-a.x IN (1,2,4) GROUP BY 1)"
_MORAN = "m AS (SELECT a.channel, count(*) AS w, sum((a.value-mean)*(c.value-mean)) AS s FROM flat a JOIN b ON a.channel=b.channel JOIN flat c ON a.channel=c.channel AND ((c.y=a.y AND c.x=a.x+1) OR (c.y=a.y+1 AND c.x=a.x)) GROUP BY 1)"
_GRAD = "d AS (SELECT c.channel, (e.value-w.value)/2 gx, (s.value-n.value)/2 gy FROM flat c JOIN flat e ON c.channel=e.channel AND c.y=e.y AND e.x=c.x+1 JOIN flat w ON c.channel=w.channel AND c.y=w.y AND w.x=c.x-1 JOIN flat s ON c.channel=s.channel AND c.x=s.x AND s.y=c.y+1 JOIN flat n ON c.channel=n.channel AND c.x=n.x AND n.y=c.y-1), g AS (SELECT channel, sqrt(pow(sum(gx*gx)-sum(gy*gy),2)+4*pow(sum(gx*gy),2))/(sum(gx*gx)+sum(gy*gy)) AS coherency FROM d GROUP BY 1)"
_TEXTURE = {"granularity": {"lags": [1, 2, 4]}, "glcm": {"levels": 8, "low": 0.0, "high": 50.0}}


@query(f"{G}, {_BASE}, {_LAG}, {_MORAN}, {_GRAD}, {_GLCM} SELECT channel, round(n,5) AS intensity_n, round(mean,5) AS intensity_mean, round(sd,5) AS intensity_sd, round(sd/mean,5) AS intensity_cv, round(coherency,5) AS gradient_coherency, round(lag1,5) AS granularity_lag1, round(lag2,5) AS granularity_lag2, round(lag4,5) AS granularity_lag4, round(n/w*s/(n*sd*sd),5) AS moran_i, round(contrast,5) AS glcm_contrast, round(homogeneity,5) AS glcm_homogeneity FROM b JOIN l USING (channel) JOIN m USING (channel) JOIN g USING (channel) JOIN t USING (channel)")
def n04_families(spark, sf):
    got = measure(_flat(spark, sf), ["channel"], ["intensity", "gradient", "granularity", "moran", "glcm"], _TEXTURE)
    return rounded(got.drop("gradient_angle", "gradient_entropy", "glcm_energy", "glcm_entropy", "glcm_correlation"), 5)


#: A preset of this library.
TEXTURE = Preset("texture", ("moran", "granularity"), {"granularity": {"lags": [1, 2, 4]}})


@query(f"{G}, {_BASE}, {_LAG}, {_MORAN} SELECT channel, round(n/w*s/(n*sd*sd),5) AS moran_i, round(lag1,5) AS granularity_lag1, round(lag2,5) AS granularity_lag2, round(lag4,5) AS granularity_lag4 FROM b JOIN l USING (channel) JOIN m USING (channel)")
def n05_preset(spark, sf):
    return rounded(TEXTURE.measure(_flat(spark, sf), ["channel"]), 5)


@query()
def k26_smoothed_anisotropy(spark, sf):
    return measure(_flat(spark, sf), ["channel"], ["anisotropy"])


_WAVES = f"""{G}, e AS (SELECT channel, min(y) y0, min(x) x0, max(y)-min(y)+1 AS h, max(x)-min(x)+1 AS w, avg(value) AS mean FROM flat GROUP BY 1),
v AS (SELECT channel, y-y0 AS y, x-x0 AS x, h, w, (value-mean)*(0.5-0.5*cos(2*pi()*(y-y0)/(h-1)))*(0.5-0.5*cos(2*pi()*(x-x0)/(w-1))) AS v FROM flat JOIN e USING (channel)),
r AS (SELECT channel, y, h, w, k AS kx, sum(v*cos(2*pi()*k*x/w)) AS re, -sum(v*sin(2*pi()*k*x/w)) AS im FROM v JOIN range(0,128) q(k) ON k<w GROUP BY 1,2,3,4,5),
c AS (SELECT channel, h, w, k AS ky, kx, sum(re*cos(2*pi()*k*y/h)+im*sin(2*pi()*k*y/h)) AS re, sum(im*cos(2*pi()*k*y/h)-re*sin(2*pi()*k*y/h)) AS im FROM r JOIN range(0,65) q(k) ON k<=h//2 GROUP BY 1,2,3,4,5),
p AS (SELECT channel, h, w, ky, kx AS i, CASE WHEN kx>w//2 THEN kx-w ELSE kx END AS kx, re*re+im*im AS p FROM c WHERE ky>0 OR (kx>0 AND kx<=w//2)),
s AS (SELECT channel, max(p) AS top, sum(p) AS total, median(p) FILTER (p>0) AS mid FROM p GROUP BY 1),
b AS (SELECT * FROM p JOIN s USING (channel) WHERE p>=top*(1-1e-9) QUALIFY row_number() OVER (PARTITION BY channel ORDER BY ky, i)=1)
SELECT channel, round(1/sqrt(pow(kx/w,2)+pow(ky/h,2)),4) AS wavelength, round(CASE WHEN a>90 THEN 270-a ELSE 90-a END,4) AS angle, round(p/mid,2) AS stripiness, round(p/total,6) AS peak FROM (SELECT *, degrees(atan2(ky/h,kx/w)) AS a FROM b)"""


@query(_WAVES)
def k27_spectrum(spark, sf):
    got = spectrum(_flat(spark, sf), ["channel"])
    return got.select("channel", *[(F.round(c, d) + F.lit(0.0)).alias(c) for c, d in (("wavelength", 4), ("angle", 4), ("stripiness", 2), ("peak", 6))])


_SIDE = lambda a, p, m: f"(coalesce({p}.value,c.value)-coalesce({m}.value,c.value))/greatest(1,({p}.value IS NOT NULL)::INT+({m}.value IS NOT NULL)::INT) AS g{a}"
_NEAR = " ".join(f"LEFT JOIN voxels {n} ON {n}.channel=c.channel AND {n}.z=c.z+({dz}) AND {n}.y=c.y+({dy}) AND {n}.x=c.x+({dx})" for n, dz, dy, dx in (("e", 0, 0, 1), ("w", 0, 0, -1), ("s", 0, 1, 0), ("n", 0, -1, 0), ("d", 1, 0, 0), ("u", -1, 0, 0)))
_TENSOR = f"""WITH {GRID}, g AS (SELECT c.channel, {_SIDE("x", "e", "w")}, {_SIDE("y", "s", "n")}, {_SIDE("z", "d", "u")} FROM voxels c {_NEAR}),
t AS (SELECT channel, sum(gx*gx) xx, sum(gy*gy) yy, sum(gz*gz) zz, sum(gx*gy) xy, sum(gx*gz) xz, sum(gy*gz) yz FROM g GROUP BY 1),
q AS (SELECT *, (xx+yy+zz)/3 AS q FROM t), p AS (SELECT *, sqrt((pow(xx-q,2)+pow(yy-q,2)+pow(zz-q,2)+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM q),
r AS (SELECT *, acos(greatest(-1,least(1,((xx-q)*((yy-q)*(zz-q)-yz*yz)-xy*(xy*(zz-q)-yz*xz)+xz*(xy*yz-(yy-q)*xz))/(2*p*p*p))))/3 AS phi FROM p),
l AS (SELECT *, q+2*p*cos(phi) AS l1, q+2*p*cos(phi+2*pi()/3) AS l3 FROM r),
v AS (SELECT *, 3*q-l1-l3 AS l2, xy*yz-xz*(yy-l1) AS vx, xz*xy-(xx-l1)*yz AS vy FROM l),
a AS (SELECT channel, least(17,floor(round((CASE WHEN t>=pi() THEN t-pi() WHEN t<0 THEN t+pi() ELSE t END)/pi()*18,9))) AS bin FROM (SELECT channel, atan2(gy,gx)+pi()/2 AS t FROM g WHERE sqrt(gx*gx+gy*gy)>1e-9)),
h AS (SELECT channel, -sum(f*ln(f))/ln(18) AS entropy FROM (SELECT channel, count(*)/sum(count(*)) OVER (PARTITION BY channel) AS f FROM a GROUP BY channel, bin) GROUP BY 1)
SELECT channel, round((l1-l2)/(xx+yy+zz),5) AS coherency, round(CASE WHEN w>=180 THEN w-180 WHEN w<0 THEN w+180 ELSE w END,3) AS angle, round(entropy,5) AS entropy FROM (SELECT *, degrees(atan2(vy,vx))+90 AS w FROM v) JOIN h USING (channel)"""


@query(_TENSOR)
def k26_anisotropy3d(spark, sf):
    got = anisotropy3d(_v(spark, sf), ["channel"])
    return got.select("channel", *[(F.round(c, d) + F.lit(0.0)).alias(c) for c, d in (("coherency", 5), ("angle", 3), ("entropy", 5))])


_FRAME = f"""WITH {GRID}, o AS (SELECT label, {", ".join(f"avg({a}) AS c{a}, min({a}) AS {a}0, max({a}) AS {a}1" for a in "xyz")} FROM labels WHERE channel='A' GROUP BY 1),
f AS (SELECT *, sqrt({"+".join(f"pow(greatest(abs({a}0-c{a}),abs({a}1-c{a})),2)" for a in "xyz")}) AS r FROM o),
m AS (SELECT f.*, CASE WHEN r>0 THEN r ELSE 1 END AS far, v.channel, v.value, s.value AS src, {", ".join(f"v.{a}-c{a} AS d{a}" for a in "xyz")} FROM f JOIN voxels v ON v.x BETWEEN x0 AND x1 AND v.y BETWEEN y0 AND y1 AND v.z BETWEEN z0 AND z1 LEFT JOIN voxels s ON s.channel='A' AND s.z=v.z AND s.y=v.y AND s.x=v.x),
t AS (SELECT *, sqrt(dx*dx+dy*dy+dz*dz)/far AS share, round(atan2(dy,dx)/(2*pi()),12) AS turn FROM m),
b AS ({" UNION ALL ".join(f"SELECT label, channel, '{n}' AS profile, CAST(greatest(0,least({k - 1},floor(round(({e})*{k},9)))) AS INT) AS bin, value FROM t" for n, k, e in [("radial", 20, "share"), ("shell", 3, "share"), ("angular", 12, "CASE WHEN turn<0 THEN turn+1 ELSE turn END"), *[(a, 50, f"(1+d{a}/greatest(1e-9,CASE WHEN d{a}<0 THEN c{a}-{a}0 ELSE {a}1-c{a} END))/2") for a in "xyz"]])}),
h AS (SELECT label, channel, min(value) AS lo, max(value) AS hi FROM m GROUP BY 1,2),
c AS (SELECT label, channel, profile, bin, count(*) AS n, avg(value) AS mean FROM b GROUP BY 1,2,3,4)"""


def _profiles(spark, sf):
    one = labels(spark, sf).where("channel = 'A'").select(F.lit(1).alias("g"), "z", "y", "x", "label")
    return profiles(one, _v(spark, sf).withColumn("g", F.lit(1)), ["g"], "A", Profile())


@query(f"{_FRAME} SELECT label, channel, profile, bin, n, round(mean,7) AS mean, round(CASE WHEN hi>lo THEN (mean-lo)/(hi-lo) ELSE 0 END,7) AS normed FROM c JOIN h USING (label, channel)")
def k45_profiles(spark, sf):
    return rounded(_profiles(spark, sf)["curves"].where("profile NOT LIKE 'axis%'").drop("g"), 7)


@query(f"""{_FRAME}, s AS (SELECT label, channel, CASE WHEN sum(value)>0 THEN sqrt(pow(sum(value*dx)/sum(value),2)+pow(sum(value*dy)/sum(value),2)+pow(sum(value*dz)/sum(value),2))/any_value(far) END AS polarity, CASE WHEN var_pop(src) FILTER (src IS NOT NULL)>1e-9 AND var_pop(value) FILTER (src IS NOT NULL)>1e-9 THEN corr(src,value) END AS pearson, sum(src*value)/nullif(sqrt(sum(src*src)*sum(value*value) FILTER (src IS NOT NULL)),0) AS manders FROM m GROUP BY 1,2), k AS (SELECT label, channel, max(mean) FILTER (profile='shell' AND bin=0) AS "inner", max(mean) FILTER (profile='shell' AND bin=1) AS middle, max(mean) FILTER (profile='shell' AND bin=2) AS "outer", coalesce(avg(mean) FILTER (profile='radial' AND bin<6),0) AS core, coalesce(avg(mean) FILTER (profile='radial' AND bin>=13),0) AS edge, (arg_max(bin, round(mean,9)*1000-bin*1e-9) FILTER (profile='radial')+0.5)/20 AS peak, greatest(0,1-stddev_pop(mean) FILTER (profile='angular')/avg(mean) FILTER (profile='angular')) AS uniformity FROM c GROUP BY 1,2), a AS (SELECT label, channel, max(mean) AS top FROM c WHERE profile='angular' GROUP BY 1,2), r AS (SELECT c.label, c.channel, count(*)/12 AS ring FROM c JOIN a ON a.label=c.label AND a.channel=c.channel AND profile='angular' AND mean>=0.5*top GROUP BY 1,2) SELECT label, channel, round(CASE WHEN edge>0 THEN core/edge END,4) AS core_edge, round(peak,4) AS peak, round(polarity,4) AS polarity, round(ring,4) AS ring, round(uniformity,4) AS uniformity, round("inner",4) AS "inner", round(middle,4) AS middle, round("outer",4) AS "outer", round(pearson,4) AS pearson, round(manders,4) AS manders FROM s JOIN k USING (label, channel) JOIN r USING (label, channel)""")
def k45_profile_summary(spark, sf):
    return rounded(_profiles(spark, sf)["summary"].drop("g", "axis_polarity", "elongation", "flatness"))


@query(f"""{G}, h AS (SELECT channel, value, count(*)::DOUBLE AS c FROM flat GROUP BY 1,2),
w AS (SELECT *, sum(c) OVER o AS w, sum(c*value) OVER o AS s, sum(c) OVER a AS n, sum(c*value) OVER a AS t FROM h WINDOW o AS (PARTITION BY channel ORDER BY value), a AS (PARTITION BY channel)),
k AS (SELECT channel, value AS split FROM w WHERE w<n QUALIFY row_number() OVER (PARTITION BY channel ORDER BY round(w*(n-w)*pow(s/w-(t-s)/(n-w),2)/(n*n),9) DESC, value)=1),
r AS (SELECT channel, 20*log10((avg(value) FILTER (value>=split)-avg(value) FILTER (value<split))/stddev_pop(value) FILTER (value<split)) AS snr_db FROM flat JOIN k USING (channel) GROUP BY 1),
e AS (SELECT channel, avg(value) AS mean, min(y) AS y0, min(x) AS x0, (max(y)-min(y)+1)//4 AS sy, (max(x)-min(x)+1)//4 AS sx FROM flat GROUP BY 1),
b AS (SELECT channel, (y-y0)//sy AS ty, (x-x0)//sx AS tx, list_sort(list(value)) AS l FROM flat JOIN e USING (channel) WHERE value<mean AND (y-y0)//sy<4 AND (x-x0)//sx<4 GROUP BY 1,2,3),
m AS (SELECT channel, l[len(l)//2+1] AS m FROM b WHERE l[len(l)//2+1]>0)
SELECT r.channel, round(any_value(snr_db),4) AS snr_db, round(stddev_pop(m)/avg(m),6) AS background_cv FROM r JOIN m USING (channel) GROUP BY 1""")
def k46_background(spark, sf):
    f = _flat(spark, sf)
    both = signal_db(f, ["channel"]).join(background_cv(f, ["channel"]), "channel")
    return both.select("channel", F.round("snr_db", 4).alias("snr_db"), F.round("background_cv", 6).alias("background_cv"))
