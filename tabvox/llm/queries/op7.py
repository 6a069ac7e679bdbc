"""Query of operator 7."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabvox.llm import token_file
from tabvox.llm.queries.tables import read


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_file.new_path(spark)
    token_file.write(read(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_file.read_digests(spark, path).withColumnRenamed("key", "doc_id")
