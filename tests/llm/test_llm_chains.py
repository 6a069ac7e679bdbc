"""Chains of words in frequent pairs: no word is sent on more than once, and their windows are those of the texts."""

import random
from collections import Counter

import pytest

from tabvox.llm import collocations as C


@pytest.mark.parametrize("part", [2, 32])
def test_chains_hold_the_words_once_and_give_all_windows(spark, monkeypatch, part):
    monkeypatch.setattr(C, "PART", part)
    r = random.Random(4)
    rows = [("en" if i % 3 else "de", ". ".join(" ".join(r.choice("a b c d e f".split()) for _ in range(r.randint(1, 9))) for _ in range(20))) for i in range(60)]
    rows.append(("en", "Long " * 100))
    texts = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    bitmap = spark.sparkContext.broadcast(C._bitmap(C._frequent_pairs(texts, 1), 27))  # all pairs are frequent
    chains = C._chains(texts, 5, bitmap).collect()
    n = sum(len(t.split()) for _, t in rows)
    assert sum(x["starts"] * x["n"] for x in chains) == n
    if part == 32:
        assert sum(len(x["words"]) for x in chains) <= n + 4 * 3  # four words more for each cut of the long one
    want = Counter()
    for lang, text in rows:
        for piece in text.lower().split("."):
            w = piece.split()
            want.update((lang, *(w[i : i + 5] + [None] * 5)[:5]) for i in range(len(w)))
    got = Counter()
    for lang, *w, k in C._windows(texts, 5, bitmap).collect():
        got[lang, *w] += k
    assert got == want
