"""Reading modes, merging of result tables and small rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvox.functions.scalar import finite, num_or_zero, safe_divide
from tabvox.operators import aggregate as A
from tabvox.operators import joins as J
from tabvox.operators import quality as Q
from tabvox.plans.base import query, rounded
from tabvox.sources.driver import role, role_sql

OBJ, SAMPLES = role_sql("objects"), role_sql("samples")


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("SELECT event_id, try_cast(props AS DOUBLE) AS of_text, CASE WHEN isfinite(try_cast(CAST(value AS VARCHAR) AS DOUBLE)) THEN round(try_cast(CAST(value AS VARCHAR) AS DOUBLE),4) END AS of_number, coalesce(try_cast(event_type AS DOUBLE),0) AS or_zero FROM events")
def a03_parse_modes(spark, sf):
    e = _read(spark, sf, "events")
    return rounded(e.select("event_id", finite(F.col("props")).alias("of_text"), finite(F.col("value").cast("string")).alias("of_number"), num_or_zero(F.col("event_type")).alias("or_zero")))


@query(f"{OBJ} SELECT animal, channel, label, volume, CASE WHEN run_id='O' THEN run_id END AS run_id FROM objects WHERE run_id IN ('F','O')")
def a04_append_tables(spark, sf):
    o = role(spark, sf, "objects").select("animal", "channel", "label", "volume", "run_id")
    return J.append_tables(o.where("run_id = 'F'").drop("run_id"), o.where("run_id = 'O'"))


@query("SELECT c_custkey, c_name, round(coalesce(o.total,c_acctbal),2) AS c_acctbal, n FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey=c_custkey")
def a05_merge_columns(spark, sf):
    new = _read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("c_acctbal"), F.count("*").alias("n"))
    return rounded(J.merge_columns(_read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), new, ["c_custkey"]), 2)


@query("SELECT c_custkey AS key, round(c_acctbal,2) AS balance, c_mktsegment AS segment, NULL AS nation FROM customer UNION ALL SELECT s_suppkey, round(s_acctbal,2), NULL, s_nationkey FROM supplier")
def a06_extend_rows(spark, sf):
    c = _read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = _read(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return rounded(J.extend_rows(c, s), 2)


@query(f"{OBJ} SELECT animal, label, channel, volume FROM objects WHERE volume>0 AND trim(animal)<>''")
def b01_drop_placeholders(spark, sf):
    return A.drop_placeholders(role(spark, sf, "objects")).select("animal", "label", "channel", "volume")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars>0 AND trim(lang)<>''")
def b02_blank_animals(spark, sf):
    return A.drop_placeholders(_read(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "n_chars", "lang")


@query(f"{OBJ}, m AS (SELECT animal, count(*) AS n, count(DISTINCT section) AS s FROM objects WHERE volume>0 GROUP BY 1), v AS (SELECT 'A'||s_suppkey AS animal, CASE WHEN s_acctbal>0 THEN s_acctbal ELSE s_suppkey*1e6*20/1e9 END AS volume FROM supplier) SELECT m.animal, n, round(CASE WHEN abs(volume)>=1e-10 THEN n/s/volume END,6) AS n_permm3 FROM m LEFT JOIN v ON m.animal=v.animal")
def c06_roi_volume(spark, sf):
    found = A.drop_placeholders(role(spark, sf, "objects"))
    empty = F.lit(None).cast("double")
    rois = _read(spark, sf, "supplier").select(
        F.concat(F.lit("A"), "s_suppkey").alias("animal"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("volume_mm3"),
        (F.col("s_suppkey") * 1e6).alias("area_um2"), F.lit(20.0).alias("depth_um"), empty.alias("area_px"), empty.alias("pixel_um"),
    )
    master = found.groupBy("animal").agg(F.count("*").alias("n"))
    return rounded(A.per_mm3(master, A.roi_volumes(rois, "animal"), A.distinct_sections(found, "animal", ["section"]), "animal", ["n"]), 6)


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(l_discount)>=1e-10 THEN l_tax/l_discount END,6) AS ratio FROM lineitem")
def h10_safe_divide(spark, sf):
    return rounded(_read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", safe_divide(F.col("l_tax"), F.col("l_discount")).alias("ratio")), 6)


@query("SELECT sha256(text) AS hash, count(*) AS n, min(CAST(doc_id AS VARCHAR)) AS \"first\" FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*)>1")
def l02_duplicate_texts(spark, sf):
    d = _read(spark, sf, "documents").where("text IS NOT NULL")
    return Q.duplicate_files(d.select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").alias("length"), F.sha2("text", 256).alias("hash")))


@query(f"{SAMPLES} SELECT condition, metric, round(CASE WHEN metric='F' THEN sum(value) ELSE avg(value) END,2) AS value FROM samples GROUP BY 1,2")
def n02_override(spark, sf):
    return rounded(A.animal_collapse(role(spark, sf, "samples"), ["condition"], override={"F": "SUM", "O": "MEAN", "P": "AUTO"}), 2)
