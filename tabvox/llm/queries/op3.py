"""Query of operator 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvox.llm import toxicity
from tabvox.llm.queries.tables import read
from tabvox.llm.textbytes import fold


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    trained = fold(F.col("doc_id"), 4) != 2
    index = toxicity.fit(docs.where(trained), read(spark, sf_dir, "labels").select("doc_id", "toxic").where(trained))
    return toxicity.score(docs, index).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", "evidence")
