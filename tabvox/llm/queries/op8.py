"""Query of operator 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvox.llm import quality_rules
from tabvox.llm.queries.tables import read


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rules = quality_rules.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"), where=~failed)
    return quality_rules.statistics(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & quality_rules.verdict(rules)).alias("kept"), quality_rules.fired(rules).alias("rule"),
    )
