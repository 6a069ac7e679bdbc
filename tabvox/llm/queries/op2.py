"""Query of operator 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvox.llm import suffix_tree
from tabvox.llm.queries.tables import read
from tabvox.llm.textbytes import fold


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_tree.score(docs, fold(F.col("doc_id"), 7) != 2).select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
