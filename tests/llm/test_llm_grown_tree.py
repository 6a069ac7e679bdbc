"""The suffix tree holds every run that occurs often enough, whatever its share of the tokens."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from tabvox.llm import suffix_tree

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())), None]


def plain_scores(texts, learned, depth, at_least):
    """Scores of texts by dictionaries of all runs: discounted, tested against the parent, backed off."""
    count = collections.Counter(tuple(t[i : i + k]) for t, yes in zip(texts, learned, strict=True) if yes for k in range(1, depth + 2) for i in range(len(t) - k + 1))
    n, v = sum(c for g, c in count.items() if len(g) == 1), sum(len(g) == 1 for g in count)
    runs = {g: c for g, c in count.items() if c >= at_least}
    after = collections.defaultdict(list)
    for g in runs:
        after[g[:-1]].append(g)
    back = {}

    def own(g):
        return (runs[g] - 0.7) / runs[g[:-1]]

    def prob(g):  # log10 of the last word's probability after the others
        if len(g) == 1:
            return math.log10((count.get(g, 0) + 1) / (n + v + 1))
        c = g[:-1]
        if c in back:
            return math.log10(own(g)) if g in runs else back[c] + prob(g[1:])
        return prob(g[1:])

    for k in range(1, depth + 1):
        for c in [c for c in after if len(c) == k]:
            parent = {g: prob(g[1:]) for g in after[c]}
            listed, listed_parent = sum(map(own, parent)), sum(10**p for p in parent.values())
            free = max(1 - listed, 1e-12) / max(1 - listed_parent, 1e-12)
            gain = sum(runs[g] * (math.log(own(g)) - p * math.log(10)) for g, p in parent.items()) + (runs[c] - sum(runs[g] for g in parent)) * math.log(free)
            if gain > (len(parent) + 1) / 2 * math.log(n) and listed_parent < 1 - 1e-9 and listed < 1:
                back[c] = math.log10(free)
    return [sum(prob(tuple(t[max(0, i - depth) : i + 1])) for i in range(len(t))) for t in texts], back


@pytest.mark.parametrize("depth, at_least, block_bytes", [(3, 4, 1 << 16), (2, 2, 4 << 20), (0, 4, 4 << 20)])
def test_equals_plain_tree(spark, monkeypatch, depth, at_least, block_bytes):
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(suffix_tree, "BLOCKS_A_RANGE", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want, back = plain_scores([tokens(r["text"]) for r in rows], [r["doc_id"] % 7 != 2 for r in rows], depth, at_least)
    assert {len(c) for c in back} == set(range(1, depth + 1))
    got = {r["doc_id"]: r for r in suffix_tree.score(docs.repartition(3), F.col("doc_id") % 7 != 2, depth=depth, at_least=at_least).collect()}
    assert len(got) == len(rows)
    for r, score in zip(rows, want, strict=True):
        assert got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-6), r["doc_id"]
        assert got[r["doc_id"]]["learned"] == (r["doc_id"] % 7 != 2)


def test_rare_share_is_kept(spark):
    """Twelve times in 2.4 million tokens, a hundred and fifty-thousandth, once fell out of the tree."""
    docs = spark.createDataFrame([(0, "x " * 2_400_000), *((i, "p q") for i in range(1, 13))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_tree.score(docs, F.lit(True)).collect()}
    n = 2_400_000 + 1 + 12 * 3
    assert got[3]["train_tokens"] == n
    root = math.log10(13 / (n + 4 + 1))
    assert got[3]["base_score"] == pytest.approx(2 * root + math.log10(14 / (n + 5)))
    assert got[3]["score"] == pytest.approx(root + 2 * math.log10(11.3 / 12))
