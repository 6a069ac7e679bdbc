"""Hypothesis tests over the driver's tables: order values by priority (condition), customer (subject) and status (metric)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvox.functions.scalar import NORM_CDF_SQL
from tabvox.operators import stats as T
from tabvox.plans.base import query, rounded
from tabvox.sources.driver import role, role_sql

S = role_sql("samples")
G = f"{S}, g AS (SELECT metric, condition, count(value) n, avg(value) mean, var_samp(value) v FROM samples GROUP BY 1,2)"
P = f"{G}, p AS (SELECT a.metric, a.condition a_condition, b.condition b_condition, a.n an, b.n bn, a.mean am, b.mean bm, a.v av, b.v bv FROM g a JOIN g b ON a.metric=b.metric AND a.condition<b.condition)"
CASES = f"{S}, k AS (SELECT metric, count(DISTINCT condition) k FROM samples GROUP BY 1), o AS (SELECT metric, subject FROM samples JOIN k USING (metric) GROUP BY 1,2,k HAVING count(DISTINCT condition)=k), c AS (SELECT s.* FROM samples s JOIN o USING (metric, subject))"
RANKS = f"{S}, r AS (SELECT metric, condition, subject, rank() OVER (PARTITION BY metric ORDER BY value)+(count(*) OVER (PARTITION BY metric, value)-1)/2.0 r, count(*) OVER (PARTITION BY metric, value) t FROM samples)"


def _s(spark, sf):
    return role(spark, sf, "samples")


@query(f"{G} SELECT metric, count(*) AS groups, min(n) AS smallest, CASE WHEN count(*)<2 THEN 'fewer than two groups' WHEN min(n)<3 THEN 'a group has fewer than 3' END AS reason FROM g GROUP BY 1".replace("AS groups", 'AS "groups"'))
def i01_eligibility(spark, sf):
    return T.eligibility(_s(spark, sf))


@query(
    f"""{S}, m AS (SELECT *, avg(value) OVER (PARTITION BY metric, condition) mu FROM samples), x AS (SELECT metric, condition, count(*)::DOUBLE n, avg(pow(value-mu,2)) m2, avg(pow(value-mu,3)) m3, avg(pow(value-mu,4)) m4 FROM m GROUP BY 1,2),
 a AS (SELECT *, m3/pow(m2,1.5)*sqrt((n+1)*(n+3)/(6*(n-2))) y, 3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) b2, (m4/(m2*m2)-3*(n-1)/(n+1))/sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) xk, 6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) sb FROM x),
 b AS (SELECT *, -1+sqrt(2*(b2-1)) w2, 6+8/sb*(2/sb+sqrt(1+4/(sb*sb))) aa FROM a), c AS (SELECT *, sqrt(2/(w2-1)) al, (1-2/aa)/(1+xk*sqrt(2/(aa-4))) inn FROM b),
 d AS (SELECT *, ln(y/al+sqrt(y/al*y/al+1))/sqrt(ln(sqrt(w2))) zs, ((1-2/(9*aa))-sign(inn)*pow(abs(inn),1/3.0::DOUBLE))/sqrt(2/(9*aa)) zk FROM c)
 SELECT metric, condition, CAST(n AS BIGINT) AS n, round(zs*zs+zk*zk,3) AS k2, zs*zs+zk*zk < 5.991 AS normal FROM d"""
)
def i02_normality(spark, sf):
    return rounded(T.normality(_s(spark, sf)), 3)


@query(f"{P} SELECT metric, a_condition, b_condition, round((am-bm)/sqrt(av/an+bv/bn),4) AS t, round(pow(av/an+bv/bn,2)/(pow(av/an,2)/(an-1)+pow(bv/bn,2)/(bn-1)),3) AS df FROM p")
def i03_welch_stat(spark, sf):
    return T.welch(_s(spark, sf)).select("metric", "a_condition", "b_condition", F.round("t", 4).alias("t"), F.round("df", 3).alias("df"))


@query(f"{G}, t AS (SELECT metric, sum(n) nn, sum(n*mean)/sum(n) gm, count(*) k, sum((n-1)*v) ssw FROM g GROUP BY 1), b AS (SELECT g.metric, sum(n*pow(mean-gm,2)) ssb FROM g JOIN t USING (metric) GROUP BY 1) SELECT metric, round((ssb/(k-1))/(ssw/(nn-k)),4) AS f, k-1 AS d1, CAST(nn-k AS BIGINT) AS d2 FROM t JOIN b USING (metric)")
def i04_anova_stat(spark, sf):
    return rounded(T.anova(_s(spark, sf)).drop("p"))


MW = f"{S}, q AS (SELECT DISTINCT a.metric, a.condition a_condition, b.condition b_condition FROM samples a JOIN samples b ON a.metric=b.metric AND a.condition<b.condition), w AS (SELECT q.*, value, s.condition=a_condition isa FROM q JOIN samples s ON s.metric=q.metric AND s.condition IN (a_condition,b_condition)), r AS (SELECT *, rank() OVER (PARTITION BY metric,a_condition,b_condition ORDER BY value)+(count(*) OVER (PARTITION BY metric,a_condition,b_condition,value)-1)/2.0 r, count(*) OVER (PARTITION BY metric,a_condition,b_condition,value) t FROM w), z AS (SELECT metric,a_condition,b_condition, sum(r) FILTER (isa)::DOUBLE ra, count(*) FILTER (isa)::DOUBLE na, count(*) FILTER (NOT isa)::DOUBLE nb, sum(t*t-1)::DOUBLE tie FROM r GROUP BY 1,2,3), u AS (SELECT *, ra-na*(na+1)/2 u, na*nb/12*((na+nb+1)-tie/((na+nb)*(na+nb-1))) v FROM z), zz AS (SELECT *, (u-na*nb/2)/sqrt(v) z FROM u)"


@query(f"{MW} SELECT metric, a_condition, b_condition, round(least(u,na*nb-u),1) AS u, round(z,4) AS z, round(2*(1-{NORM_CDF_SQL.format(z='abs(z)')}),5) AS p FROM zz")
def i05_mann_whitney(spark, sf):
    out = T.mann_whitney(_s(spark, sf))
    return out.select("metric", "a_condition", "b_condition", F.round("u", 1).alias("u"), F.round("z", 4).alias("z"), F.round("p", 5).alias("p"))


@query(f"{MW} SELECT metric, a_condition, b_condition, round(least(1,(2*(1-{NORM_CDF_SQL.format(z='abs(z)')}))*count(*) OVER (PARTITION BY metric)),5) AS adjusted FROM zz")
def i11_bonferroni(spark, sf):
    return rounded(T.bonferroni(T.mann_whitney(_s(spark, sf))).select("metric", "a_condition", "b_condition", "adjusted"), 5)


@query(f"{RANKS}, g AS (SELECT metric, condition, count(*)::DOUBLE n, sum(r)::DOUBLE s, sum(t*t-1)::DOUBLE tie FROM r GROUP BY 1,2), h AS (SELECT metric, sum(n) n, sum(s*s/n) s, sum(tie) tie, count(*) k FROM g GROUP BY 1) SELECT metric, round((12/(n*(n+1))*s-3*(n+1))/(1-tie/(n*n*n-n)),4) AS h, k FROM h")
def i06_kruskal(spark, sf):
    return rounded(T.kruskal(_s(spark, sf)))


DIFF = f"{S}, d AS (SELECT a.metric, a.condition a_condition, b.condition b_condition, a.subject, a.value-b.value d FROM samples a JOIN samples b ON a.metric=b.metric AND a.subject=b.subject AND a.condition<b.condition)"


@query(f"{DIFF} SELECT metric, a_condition, b_condition, count(*) AS n, round(avg(d)/(stddev_samp(d)/sqrt(count(*))),4) AS t FROM d GROUP BY 1,2,3")
def i07_paired_stat(spark, sf):
    return rounded(T.paired_t(_s(spark, sf)).drop("p"))


@query(f"{DIFF}, v AS (SELECT *, CASE WHEN abs(d)<4e6 THEN floor(abs(d)*1e9+0.5)/1e9 ELSE abs(d) END AS size FROM d), r AS (SELECT *, rank() OVER (PARTITION BY metric,a_condition,b_condition ORDER BY size)+(count(*) OVER (PARTITION BY metric,a_condition,b_condition,size)-1)/2.0 r FROM v) SELECT metric, a_condition, b_condition, count(*) FILTER (d<>0) AS n, round(least(sum(CASE WHEN d>0 THEN r ELSE 0 END),sum(CASE WHEN d<0 THEN r ELSE 0 END)),1) AS w FROM r GROUP BY 1,2,3")
def i08_wilcoxon_stat(spark, sf):
    return rounded(T.wilcoxon(_s(spark, sf)).drop("p"), 1)


@query(f"{CASES}, x AS (SELECT *, avg(value) OVER (PARTITION BY metric) g, avg(value) OVER (PARTITION BY metric,subject) s, avg(value) OVER (PARTITION BY metric,condition) cc FROM c), t AS (SELECT metric, count(DISTINCT subject) n, count(DISTINCT condition) k, sum(pow(cc-g,2)) a, sum(pow(value-s-cc+g,2)) e FROM x GROUP BY 1) SELECT metric, round((a/(k-1))/(e/((k-1)*(n-1))),4) AS f, k-1 AS d1, (k-1)*(n-1) AS d2 FROM t")
def i09_rm_anova_stat(spark, sf):
    return rounded(T.rm_anova(_s(spark, sf)).drop("p"))


@query(f"{CASES}, r AS (SELECT *, rank() OVER (PARTITION BY metric,subject ORDER BY value)+(count(*) OVER (PARTITION BY metric,subject,value)-1)/2.0 r, count(*) OVER (PARTITION BY metric,subject,value) t FROM c), g AS (SELECT metric, condition, sum(r)::DOUBLE s, count(*)::DOUBLE n, sum(t*t-1)::DOUBLE tie FROM r GROUP BY 1,2), h AS (SELECT metric, sum(s*s) rr, max(n) n, count(*)::DOUBLE k, sum(tie) tie FROM g GROUP BY 1) SELECT metric, round((12/(n*k*(k+1))*rr-3*n*(k+1))/(1-tie/(n*k*(k*k-1))),4) AS chi2, CAST(k AS BIGINT) AS k FROM h")
def i10_friedman(spark, sf):
    return rounded(T.friedman(_s(spark, sf)))


@query(f"{P}, t AS (SELECT metric, count(*) k, sum(n)-count(*) df, sum((n-1)*v)/(sum(n)-count(*)) ms FROM g GROUP BY 1) SELECT metric, a_condition, b_condition, round(abs(am-bm)/sqrt(ms/2*(1.0/an+1.0/bn)),4) AS q, k, CAST(df AS DOUBLE) AS df FROM p JOIN t USING (metric)")
def i12_tukey_q(spark, sf):
    return rounded(T.tukey(_s(spark, sf)).drop("p"))


@query(f"{RANKS}, g AS (SELECT metric, condition, count(*) n, avg(r)::DOUBLE m, sum(t*t-1)::DOUBLE tie FROM r GROUP BY 1,2), t AS (SELECT metric, sum(n)::DOUBLE nn, sum(tie) tie FROM g GROUP BY 1), z AS (SELECT a.metric, a.condition a_condition, b.condition b_condition, (a.m-b.m)/sqrt((nn*(nn+1)/12-t.tie/(12*(nn-1)))*(1.0/a.n+1.0/b.n)) z FROM g a JOIN g b ON a.metric=b.metric AND a.condition<b.condition JOIN t ON t.metric=a.metric WHERE a.n>=3 AND b.n>=3) SELECT metric, a_condition, b_condition, round(z,4) AS z, round(least(1,2*(1-{NORM_CDF_SQL.format(z='abs(z)')})*count(*) OVER (PARTITION BY metric)),5) AS adjusted FROM z")
def i13_dunn(spark, sf):
    out = T.dunn(_s(spark, sf))
    return out.select("metric", "a_condition", "b_condition", F.round("z", 4).alias("z"), F.round("adjusted", 5).alias("adjusted"))


@query(f"{P} SELECT metric, a_condition, b_condition, round(bm-am,3) AS difference FROM p")
def i14_effect_size(spark, sf):
    return rounded(T.welch(_s(spark, sf)).select("metric", "a_condition", "b_condition", "difference"), 3)


@query()
def i15_route(spark, sf):
    return T.route(_s(spark, sf))
