"""Corpus pipeline: filter documents stage by stage, then encode what is kept.

Each stage takes all documents that the one before it kept, written as Parquet and read again. doc_id
tells documents apart: rows that share one are judged together by the near-duplicate stage, each by its
own text by the others. Columns beside those of documents pass through the first four stages, whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvox.llm import bpe, decontaminate, jaccard_join, language_id, toxicity
from tabvox.llm.textbytes import fold, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples call toxic go; null and empty texts are scored by the rate among examples without a term, and all stay where no labels are."""
    trained = fold(F.col("doc_id"), 4) != 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(trained)
    index = toxicity.fit(docs.where(trained), labels)
    return toxicity.score(docs, index).where("predicted = 0").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or in no language that is known well enough, go."""
    model = language_id.fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    return language_id.predict(docs, model).where("NOT rejected").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that five-word shingles link at 0.8 or more, the one of the smallest id stays.

    Texts without a word are linked with none and stay, and so do rows without an id, which have no group.
    """
    found = jaccard_join.components(docs, width=5, percent=80)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's question and answer go; null and empty texts stay."""
    return decontaminate.flag(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("NOT contaminated").select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes that they decode to; a null text counts as empty, repeated rows have a row each."""
    return bpe.digests(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]
#: Learned models and components aren't SQL; tests/llm holds the operators of the stages against brute force and runs the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
