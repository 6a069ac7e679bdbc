"""Query of operator 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabvox.llm import url_filter
from tabvox.llm.queries.tables import read

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(read(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
