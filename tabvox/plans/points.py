"""Point patterns and clustering over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvox.operators import points as P
from tabvox.operators.aggregate import regression
from tabvox.plans.base import query, rounded
from tabvox.sources.driver import role, role_sql

PTS = role_sql("points")
NN = f"{PTS}, nn AS (SELECT a.section, a.id, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS distance FROM points a JOIN points b ON a.section=b.section AND a.id<>b.id GROUP BY 1,2)"
WIN = f"{NN}, b AS (SELECT section, count(*) n, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM points GROUP BY 1), pad AS (SELECT section, quantile_cont(distance,0.5)/2 pad FROM nn WHERE distance>0 GROUP BY 1), win AS (SELECT section, n, x0-pad x0, x1+pad x1, y0-pad y0, y1+pad y1, (x1-x0+2*pad)*(y1-y0+2*pad) area FROM b JOIN pad USING (section))"
RADII = [1.0, 2.0, 3.0, 4.0]
R = "r(r) AS (VALUES (1.0::DOUBLE),(2.0),(3.0),(4.0))"


def _points(spark, sf):
    return role(spark, sf, "points")


def _nn(spark, sf):
    return P.nn_distance(_points(spark, sf).select("section", "id", "x", "y"), ["section"], 2.0)


@query(f"{NN} SELECT section, id, round(distance,5) AS distance FROM nn")
def j01_nn_distance(spark, sf):
    return rounded(_nn(spark, sf).select("section", "id", "distance"), 5)


@query(f"{WIN} SELECT section, n, round(area,3) AS area FROM win")
def j02_window(spark, sf):
    return rounded(P.window(_points(spark, sf), _nn(spark, sf), ["section"]).select("section", "n", "area"), 3)


@query(f"{NN}, {R} SELECT section, r, round(avg(CASE WHEN distance<=r THEN 1.0 ELSE 0.0 END),6) AS g FROM nn CROSS JOIN r GROUP BY 1,2")
def j04_g_function(spark, sf):
    return rounded(P.g_function(_nn(spark, sf), ["section"], RADII), 6)


RIP = f"{WIN}, {R}, e AS (SELECT p.section, id, x, y, least(x-x0,x1-x,y-y0,y1-y) edge FROM points p JOIN win USING (section)), a AS (SELECT section, r, count(*) FILTER (edge>=r) anchors FROM e CROSS JOIN r GROUP BY 1,2), d AS (SELECT a.section, a.edge, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) d FROM e a JOIN e b ON a.section=b.section AND a.id<>b.id AND abs(a.x-b.x)<=4 AND abs(a.y-b.y)<=4), q AS (SELECT section, r, count(*) pairs FROM d CROSS JOIN r WHERE d<=r AND edge>=r GROUP BY 1,2), k AS (SELECT a.section, a.r, area*coalesce(pairs,0)/(anchors*(n-1)) k FROM a JOIN win USING (section) LEFT JOIN q ON q.section=a.section AND q.r=a.r)"


def _ripley(spark, sf):
    p = _points(spark, sf).select("section", "id", "x", "y")
    return P.ripley(p, P.window(p, _nn(spark, sf), ["section"]), ["section"], RADII)


@query(f"{RIP} SELECT section, r, round(k,4) AS k FROM k")
def j05_ripley_k(spark, sf):
    return rounded(_ripley(spark, sf).drop("l"))


@query(f"{RIP} SELECT section, r, round(sqrt(k/pi())-r,4) AS l FROM k")
def j06_l_function(spark, sf):
    return rounded(_ripley(spark, sf).drop("k"))


@query()
def j07_csr_envelope(spark, sf):
    p = _points(spark, sf).select("section", "id", "x", "y")
    return P.csr_envelope(P.window(p, _nn(spark, sf), ["section"]), ["section"], RADII)


SITES = f"{PTS}, sites AS (SELECT section, id, x, y FROM points), cells AS (SELECT section, gx, gy FROM (SELECT DISTINCT section FROM sites) CROSS JOIN range(0,51) a(gx) CROSS JOIN range(0,51) b(gy)), own AS (SELECT c.section, gx, gy, min(row(sqrt((gx*2.0::DOUBLE-x)*(gx*2.0::DOUBLE-x)+(gy*2.0::DOUBLE-y)*(gy*2.0::DOUBLE-y)), s.id))[2] AS owner FROM cells c JOIN sites s ON c.section=s.section GROUP BY 1,2,3)"


def _owned(spark, sf):
    return P.territories(_points(spark, sf).select("section", "id", "x", "y"), ["section"], 50, 50, 2.0)


@query(f"{SITES} SELECT section, owner AS id, round(count(*)*4.0,4) AS area FROM own GROUP BY 1,2")
def j08_territory(spark, sf):
    return rounded(P.territory_area(_owned(spark, sf), ["section"], 2.0))


EDGES = f"{SITES}, edges AS (SELECT DISTINCT a.section, least(a.owner,b.owner) AS a, greatest(a.owner,b.owner) AS b FROM own a JOIN own b ON a.section=b.section AND a.owner<>b.owner AND ((b.gx=a.gx+1 AND b.gy=a.gy) OR (b.gx=a.gx AND b.gy=a.gy+1)))"


@query(f"{EDGES} SELECT section, a, b FROM edges")
def j09_neighbour_graph(spark, sf):
    return P.neighbour_graph(_owned(spark, sf), ["section"])


@query(f"{EDGES} SELECT e.section, least(p.type,q.type) AS t, greatest(p.type,q.type) AS u, count(*) AS n FROM edges e JOIN points p ON p.section=e.section AND p.id=a JOIN points q ON q.section=e.section AND q.id=b GROUP BY 1,2,3")
def j10_interaction(spark, sf):
    return P.interaction(P.neighbour_graph(_owned(spark, sf), ["section"]), _points(spark, sf), ["section"])


@query()
def j11_interaction_p(spark, sf):
    return P.interaction_p(P.neighbour_graph(_owned(spark, sf), ["section"]), _points(spark, sf).select("section", "id", "type"), ["section"])


@query(f"{PTS}, p AS (SELECT section, x, y, greatest(0,CAST(round(x) AS INT)-6) ax, least(99,CAST(round(x) AS INT)+6) bx, greatest(0,CAST(round(y) AS INT)-6) ay, least(99,CAST(round(y) AS INT)+6) \"by\" FROM points WHERE round(x)<100 AND round(y)<100), n AS (SELECT section, count(*) n FROM p GROUP BY 1), q AS (SELECT section, x, y, ay, \"by\", unnest(range(ax,bx+1)) px FROM p), s AS (SELECT section, x, y, px, unnest(range(ay,\"by\"+1)) py FROM q) SELECT section, CAST(px AS INT) AS px, CAST(py AS INT) AS py, round(1e6*sum(exp(-((px-x)*(px-x)+(py-y)*(py-y))/8.0::DOUBLE))/(max(n)*2*pi()*4),4) AS density FROM s JOIN n USING (section) GROUP BY 1,2,3")
def j12_kde(spark, sf):
    d = P.kde(_points(spark, sf), ["section"], 100, 100, 2.0)
    return rounded(d.withColumn("density", F.col("density") * 1e6))


@query(f"{PTS} SELECT section, round(pow(count(*),-0.2::DOUBLE)*(stddev_samp(x)+stddev_samp(y))/2,5) AS bandwidth FROM points GROUP BY 1")
def j13_scott(spark, sf):
    return rounded(P.scott(_points(spark, sf), ["section"]), 5)


@query(f"{PTS} SELECT id, round((x-avg(x) OVER w)/stddev_pop(x) OVER w,5) AS x, round((mark-avg(mark) OVER w)/stddev_pop(mark) OVER w,5) AS mark FROM points WINDOW w AS (PARTITION BY section)")
def j14_zscore(spark, sf):
    return rounded(P.zscore(_points(spark, sf).select("section", "id", "x", "mark"), ["x", "mark"], ["section"]).drop("section"), 5)


#: The embeddings have 64 elements.
SIZE = 64
FEATURES = [f"f{i}" for i in range(SIZE)]


def _vectors(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f) for i, f in enumerate(FEATURES)])


@query()
def j15_kmeans(spark, sf):
    got, _ = P.kmeans(P.zscore(_vectors(spark, sf), FEATURES), FEATURES, 4)
    return got.select("id", "cluster")


VEC = "v AS (SELECT vec_id AS id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(SIZE)) + " FROM embeddings)"
DIST = "sqrt(" + "+".join(f"(a.f{i}-b.f{i})*(a.f{i}-b.f{i})" for i in range(SIZE)) + ")"


@query(f"WITH {VEC}, m AS (SELECT a.id, a.label, b.label other, sum({DIST}) s, count(*) n FROM v a JOIN v b ON true GROUP BY 1,2,3), z AS (SELECT id, max(CASE WHEN other=label THEN s/greatest(1,n-1) END) a, max(CASE WHEN other=label THEN n END) n, min(CASE WHEN other<>label THEN s/n END) b FROM m GROUP BY 1) SELECT id, round(CASE WHEN n<2 OR b IS NULL THEN 0 ELSE (b-a)/greatest(a,b) END,5) AS silhouette FROM z")
def j16_silhouette(spark, sf):
    return rounded(P.silhouette(_vectors(spark, sf), "id", "label", FEATURES), 5)


@query()
def j17_phenotypes(spark, sf):
    from tabvox.operators.aggregate import cluster_profile

    _, got = P.auto_k(P.zscore(_vectors(spark, sf), FEATURES), FEATURES)
    return cluster_profile(got, "cluster", FEATURES)


@query(f"{NN} SELECT section, regr_count(mark,distance) AS n, round(regr_slope(mark,distance),4) AS slope, round(regr_r2(mark,distance),6) AS r2 FROM nn JOIN points USING (section, id) GROUP BY 1")
def j18_proximity_response(spark, sf):
    df = _nn(spark, sf).select("section", "id", "distance").join(_points(spark, sf).select("section", "id", "mark"), ["section", "id"])
    return regression(df, ["section"], "mark", "distance").select("section", "n", F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"))


@query()
def j20_forest(spark, sf):
    v = _vectors(spark, sf).withColumn("label", (F.col("label") % 2).cast("int"))
    model, _ = P.forest(v, FEATURES)
    return P.forest_score(model, v, FEATURES).select("id", "score", "keep")
