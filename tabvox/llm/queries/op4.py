"""Query of operator 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabvox.llm import jaccard_join
from tabvox.llm.queries.tables import read


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(read(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=85)
