"""Operators 11 to 13 against plain Python, and their queries against SQL or the library."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from compare import connect, rows
from pyspark.sql import functions as F

from tabvox.llm import collocations, merkle, packing, queries

SF = "/root/testdata/sf0.01"
TOKENIZER = P.path("byte_bpe_50k.json")
ODD = [(1, "a b c", "en"), (2, None, None), (3, "", "en"), (4, "x y. z", "en"), (4, "x y. z", "en"), (5, "w" * 60_000 + " " + "word " * 6000, "fr"), (None, "null key", "de"), (None, None, "de"), (6, "$ 1", None), (7, "Ünï 👍 it's <|endoftext|>\n", "es")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and keys, and columns whose names clash with inner and resulting ones."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(1) for c in ("g", "pos", "total", "digest", "key", "leaf", "path", "block", "piece", "length", "n", "w1", "phrase", "f", "range_")})


# ---- Merkle manifest


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """Root, and each leaf's siblings from below, "" for none."""
    level, at = list(leaves), list(range(len(leaves)))
    paths = [[] for _ in leaves]
    while len(level) > 1:
        for i, a in enumerate(at):
            paths[i].append(level[a ^ 1] if a ^ 1 < len(level) else "")
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        at = [a // 2 for a in at]
    return level[0], paths


def plain_manifest(docs):
    """Counter of (key, leaf, subroot, root, proof) of rows (key, text, lang)."""
    groups = {}
    for k, t, g in docs:
        groups.setdefault(g, []).append((k, leaf_of([k, t, g])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs[g] = tree([x[1] for x in groups[g]])
    root, tops = tree([subs[g][0] for g in names])
    out = Counter()
    for g, top in zip(names, tops):
        for (k, leaf), path in zip(groups[g], subs[g][1]):
            out[k, leaf, subs[g][0], root, sha("".join(path + top))] += 1
    return out


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_equals_plain_trees(spark, odd, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 1 << levels)
    r = random.Random(levels)
    docs = [(i, f"t{i % 17}", r.choice("abc")) for i in range(70)] + [(900, "alone", "z")] + ODD
    r.shuffle(docs)
    got = merkle.manifest(spark.createDataFrame(docs, odd.select("doc_id", "text", "lang").schema).repartition(5), ["doc_id", "text", "lang"]).collect()
    assert Counter((x["doc_id"], x["leaf"], x["subroot"], x["root"], x["proof_sha256"]) for x in got) == plain_manifest(docs)
    assert all(x["verified"] and x["folded_root"] == x["root"] for x in got)


def test_manifest_of_odd_rows_and_changes(spark, odd):
    changed = F.when(F.col("doc_id") == 4, merkle.leaf(F.lit("other")))
    got = merkle.manifest(odd, ["doc_id", "text", "lang"], claim=changed).collect()
    assert Counter((x["doc_id"], x["leaf"], x["subroot"], x["root"], x["proof_sha256"]) for x in got) == plain_manifest(ODD)
    assert all(x["verified"] == (x["doc_id"] != 4) for x in got)
    assert merkle.manifest(odd.where("false"), ["doc_id", "text"]).count() == 0
    one = merkle.manifest(odd.where("doc_id = 1"), ["doc_id"]).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha("")


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_collocations"])
def test_queries_equal_their_sql(spark, name):
    df, want = queries.queries()[name](spark, SF), connect(SF).sql(queries.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


# ---- packing


def test_knapsack_equals_brute_force():
    r = random.Random(3)
    for _ in range(60):
        room = r.randint(1, 24)
        count = np.array([0] + [r.choice([0, 0, 1, 2, 5]) for _ in range(room)])
        price = np.array([0.0] + [r.random() * (i + 1) for i in range(room)])
        chosen = packing.knapsack(count, price)
        assert (chosen <= count).all() and (chosen * np.arange(room + 1)).sum() <= room
        best = {0: 0.0}
        for length in range(1, room + 1):
            for _ in range(count[length]):
                for used, value in list(best.items()):
                    if used + length <= room:
                        best[used + length] = max(best.get(used + length, 0), value + price[length])
        assert abs((chosen * price).sum() - max(best.values())) < 1e-9


@pytest.mark.parametrize("shape", ["small", "large", "halves", "one", "none", "full"])
def test_solution_is_whole_and_near_the_bound(shape):
    r, room = np.random.default_rng(7), 512
    lengths = {
        "small": r.integers(1, 60, 4000), "large": np.concatenate([r.integers(150, 512, 3000), r.integers(1, 100, 3000)]), "halves": np.full(1001, 257),
        "one": np.array([9]), "none": np.zeros(0, int), "full": np.full(50, 512),
    }[shape]
    count = np.bincount(lengths.astype(int), minlength=room + 1)
    bins = packing.solve(count)
    assert sum((n * c for n, c in bins), np.zeros(room + 1, int)).tolist() == count.tolist()
    assert all(n > 0 and 0 < (c * np.arange(room + 1)).sum() <= room for n, c in bins)
    used = sum(n for n, _ in bins)
    bound = max(-(-int(lengths.sum()) // room), int((lengths > room / 2).sum()))
    assert used <= bound + (2 if shape in ("small", "large") else 0)
    assert used <= len(packing.best_fit(count))


def plain_pieces(docs, end_id, capacity):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(TOKENIZER), Counter()
    for k, t, *_ in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id]
        many = -(-len(ids) // capacity)
        cuts = [0, *range(len(ids) - (many - 1) * capacity, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(itertools.pairwise(cuts)):
            out[k, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return out


def check_sequences(got, capacity):
    own = {}
    for x in got:
        own.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for places in own.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(own)


@pytest.mark.parametrize("capacity", [1, 7, 64, 2048])
def test_pack_odd_rows(spark, odd, capacity):
    docs = ODD if capacity > 7 else [d for d in ODD if len(d[1] or "") < 1000]
    got = packing.pack(odd.where(F.coalesce(F.length("text"), F.lit(0)) < (1000 if capacity <= 7 else 1 << 30)), TOKENIZER, end_id=0, capacity=capacity).collect()
    assert Counter(tuple(x)[:5] for x in got) == plain_pieces(docs, 0, capacity)
    check_sequences(got, capacity)
    assert packing.pack(odd.where("false"), TOKENIZER, end_id=0, capacity=capacity).count() == 0


def test_packing_query(spark):
    got = queries.queries()["op12_packing"](spark, SF).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(x)[:5] for x in got) == plain_pieces(docs, 0, 2048)
    assert check_sequences(got, 2048) == -(-sum(x["length"] for x in got) // 2048)  # no fewer sequences could hold them


# ---- phrases


def plain_phrases(docs, longest, least, percent, top):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    c = {p: v for p, v in f.items() if len(p[1]) > 1 and v >= least}
    inside = lambda s, b: any(b[i : i + len(s)] == s for i in range(len(b) - len(s) + 1))
    out = []
    for (lang, p), a in c.items():
        if any(lg == lang and len(b) > len(p) and 100 * v >= percent * a and inside(p, b) for (lg, b), v in c.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    got, rank = [], Counter()
    for lang, s, a, p, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -s))
    return sorted(got)


@pytest.mark.parametrize("longest,least,percent,top,bits", [(5, 3, 100, 2000, 27), (5, 2, 60, 7, 10), (3, 2, 100, 2000, 6), (2, 4, 100, 3, 27)])
def test_phrases_equal_plain_counts(spark, monkeypatch, longest, least, percent, top, bits):
    """Small bitmaps let windows run on; all counts stay exact."""
    monkeypatch.setattr(collocations, "HELD", 500)
    monkeypatch.setattr(collocations, "SENT", 90)
    make = collocations.counts
    monkeypatch.setattr(collocations, "counts", lambda *a, **k: make(*a, **k, bits=bits))
    r = random.Random(longest * 10 + least)
    words = ["the", "The", "of", "new", "york", "é", "É", "a-b", "x1", "data", "👍"]
    docs = []
    for _ in range(150):
        text = "".join(r.choice(["new york", "of the new york data", *words]) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!?"]) for _ in range(r.randint(0, 25)))
        docs.append((r.choice([text, text, None]), r.choice(["en", "en", "fr", None])))
    docs += [("a a a a a", "de")] * 3 + [("", "en"), ("   ", "en"), ("...", "fr")]
    df = spark.createDataFrame(docs, "text string, lang string").withColumns({"n": F.lit(1), "w1": F.lit("x"), "phrase": F.lit(2)}).repartition(3)
    got = sorted(tuple(x) for x in collocations.mine(df, longest=longest, least=least, percent=percent, top=top).collect())
    assert got == plain_phrases(docs, longest, least, percent, top) and got


def test_phrases_of_odd_rows_and_large_products(spark, odd):
    got = sorted(tuple(x) for x in collocations.mine(odd, least=2).collect())
    assert got == plain_phrases([(t, g) for _, t, g in ODD], 5, 2, 100, 2000)
    assert collocations.mine(odd.where("false")).count() == 0
    assert collocations.mine(odd, least=10**9).count() == 0
    big = spark.range(1).selectExpr("(CAST(1000 AS DECIMAL(19,0)) * CAST(30000000000000 AS DECIMAL(19,0)) * CAST(900000000000000 AS DECIMAL(19,0))) div (CAST(30000000000001 AS DECIMAL(19,0)) * CAST(31000000000000 AS DECIMAL(19,0))) AS s").first()[0]
    assert big == 1000 * 30000000000000 * 900000000000000 // (30000000000001 * 31000000000000)
