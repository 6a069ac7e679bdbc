"""Query of operator 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabvox.llm import decontaminate
from tabvox.llm.queries.tables import read


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
