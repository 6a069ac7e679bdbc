"""Blocks of the suffix tree and the answers to them lie in the same buckets."""

from pyspark.sql import functions as F

from tabvox.llm import suffix_tree


def test_answers_are_not_shuffled_again(spark):
    rows = [(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 40))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (60, None), (61, "")], "doc_id long, text string")
    got = suffix_tree.score(docs, F.col("doc_id") % 7 != 2)
    # the last round reads all answers; those of earlier rounds were shuffled anew by each
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(62))
