"""Each operator against brute force, round trips or held-out labels, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabvox.llm import bpe, decontaminate, html_text, jaccard_join, language_id, pretokens, quality_rules, suffix_tree, token_file, toxicity, url_filter
from tabvox.llm.textbytes import as_bytes

SF = "/root/testdata/sf0.001"
RANKS, TOKENIZER = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = [(1, "a b c d e f g h i j k l", "en"), (2, None, None), (3, "", "en"), (4, "a b c d e f g h i j k l", "en"), (4, "a b c d e f g h i j k l", "en"), (5, "x" * 70_000 + " " + "word " * 3000, "fr"), (None, "null key here", "de"), (6, "$$$ 123", None), (7, "Ünïcode ñ 字 👍 it's\n\n", "es"), (8, " \n\t ", "en")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with results."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.withColumns({"score": F.lit("mine"), "ids": F.lit(1), "contaminated": F.lit("x"), "n_words": F.lit("y"), "key": F.lit(0)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def plain_words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


# ---- language identification


def test_language_on_held_out(spark, docs):
    train, rest = docs.where("doc_id % 4 <> 2"), docs.where("doc_id % 4 = 2")
    got = language_id.predict(rest, language_id.fit(train)).select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark, odd, docs):
    got = language_id.predict(odd, language_id.fit(docs)).collect()
    assert len(got) == len(ODD)
    for r in got:
        none = r["text"] is None or not re.search(r"[^\W\d_]", r["text"])
        assert (r["lang_pred"] == "und") == none and (r["rejected"] or not none)
    empty = odd.where("false")
    assert language_id.predict(odd, language_id.fit(empty)).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(empty, language_id.fit(docs)).count() == 0


# ---- suffix tree


def test_suffix_tree_base_and_gain(spark, docs):
    got = suffix_tree.score(docs, F.col("doc_id") % 7 != 2).collect()
    texts = {r["doc_id"]: plain_words(r["text"]) + [None] for r in docs.select("doc_id", "text").collect()}
    c = collections.Counter(w for i, t in texts.items() if i % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for r in got:
        t = texts[r["doc_id"]]
        assert r["n_tokens"] == len(t) and r["n_known"] == sum(c[w] > 0 for w in t) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), abs=1e-6)
    held = [r for r in got if r["doc_id"] % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_suffix_tree_distributions_sum_to_one():
    tree = suffix_tree.Tree(np.arange(3, dtype=np.uint64), np.array([50, 30, 20]), 100, 3)
    level = suffix_tree.Level(np.array([1, 3, 5], np.int64), np.zeros(3), np.zeros(0), np.zeros(0, bool))
    suffix_tree.retain(tree, level, np.array([45, 20, 5]), tree.counts, np.log10((tree.counts[[1, 0, 2]] + 1) / 104))
    tree.levels.append(level)
    assert level.retained[0]
    for before in range(3):
        total = 0
        for after in range(3):
            symbols = np.array([before, after])
            root = np.log10((tree.counts[symbols] + 1) / 104)
            total += 10 ** tree.extra(symbols, np.array([0]), root)[1]
        unseen = 10 ** tree.extra(np.array([before, -1]), np.array([0]), np.log10(np.array([1.0, 1 / 104])))[1]
        assert total + unseen == pytest.approx(1)


def test_suffix_tree_odd_rows(odd):
    got = suffix_tree.score(odd, F.col("doc_id") > 0).collect()
    assert len(got) == len(ODD) and all(r["n_tokens"] >= 1 and r["score"] <= 0 for r in got)
    assert suffix_tree.score(odd.where("false"), F.lit(True)).count() == 0


# ---- toxicity


def test_nearest_is_exact():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["aa" + chr(97 + i % 26) * 3 for i in range(30)], rng.integers(1, 8))) for _ in range(300)]
    toxic = rng.integers(0, 2, 300)
    buf, off = as_bytes(pa.array(texts, pa.large_string()))
    h, _ = toxicity.terms(buf, off)
    index = toxicity.Index(np.unique(h >> np.uint64(1)), np.ones(0))
    index.idf = 1 + rng.random(len(index.vocabulary))
    toxicity.build(index, pa.array(texts, pa.large_string()), toxic, np.ones(300), list(range(300)))
    dense = np.zeros((len(index.toxic), len(index.vocabulary)))
    for t in range(len(index.vocabulary)):
        s = slice(index.starts[t], index.starts[t + 1])
        dense[index.entry[s], t] = index.weight[s]
    doc, term, value = index.vectors(buf, off)
    for i in range(0, 300, 7):
        q = doc == i
        sims = dense[:, term[q]] @ value[q]
        order = np.lexsort((np.arange(len(sims)), -np.round(sims, 12)))[: index.k]
        order = order[sims[order] > 0]
        e, s = index.nearest(term[q], value[q])
        assert e.tolist() == order.tolist() and np.allclose(s, sims[order])


def test_toxicity_held_out_and_odd_rows(spark, odd):
    rng = random.Random(2)
    stems = ["the", "of", "ran", "to", "house", "tree", "blue", "sang", "far", "hill"]
    rows = [(i, " ".join(rng.choices(stems, k=30)) + (" vilething" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.fit(df.where("doc_id < 300").drop("toxic"), df.select("doc_id", "toxic").where("doc_id < 300"))
    got = toxicity.score(df.where("doc_id >= 300"), index).collect()
    assert all(r["predicted"] == r["toxic"] and 0 <= r["score"] <= 1 for r in got)
    assert all(r["evidence"] for r in got if r["toxic"])
    assert toxicity.score(odd, index).where("predicted = 1").count() == 0
    none = toxicity.fit(df.where("false").drop("toxic"), df.select("doc_id", "toxic").where("false"))
    assert toxicity.score(odd, none).count() == len(ODD)


# ---- Jaccard join


def brute_components(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = plain_words(text)
        sets[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, width, percent):
    rng = random.Random(width)
    base = [[f"w{rng.randrange(4000)}" for _ in range(n)] for n in (3, 12, 40, 90, 150)]
    shared = [f"s{i}" for i in range(40)]
    rows = []
    for i in range(260):
        words = list(base[i % 5])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 7, 12])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        if i % 3 == 0:
            words = words + shared
        rows.append((i, " ".join(words).upper() if i % 2 else "  ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "n": F.lit(2)})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(df, width=width, percent=percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_jaccard_links_and_a_word_that_many_sets_share(spark):
    rng = random.Random(8)
    rows = [(i, f"same four words here u{i} v{i} w{i}") for i in range(3000)]  # one shingle in all sets, no link
    base = " ".join(f"b{i}" for i in range(120)).split()
    for i in range(300):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((5000 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.components(df).collect()}
    want = {i: c for i, (_, c) in brute_components(rows[3000:], 4, 85).items()} | {i: i for i, _ in rows[:3000]}
    assert got == want
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, t in rows for w in [t.split()]}
    pairs, members = jaccard_join.links(df.where("doc_id >= 3000"))
    of = {r["doc_id"]: r["representative"] for r in members.collect()}
    assert all(sets[i] == sets[r] for i, r in of.items())
    reps = sorted(set(of.values()))
    assert {(r["x"], r["y"]) for r in pairs.collect()} == {(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}


def test_jaccard_odd_rows(odd):
    got = jaccard_join.components(odd).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 4)} == {1}
    assert jaccard_join.components(odd.where("false")).count() == 0


# ---- URL filter


def test_url_rules_and_propagation(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", '<a href="http://b.com/">'), (2, "http://B.com/", "<a href='//c.com/z'>"), (3, "http://c.com?q", "x"), (4, "http://s.net/", "y"), (5, "http://e.com/", "<A class=k HREF=http://s.net/q>"), (6, None, None), (7, "no scheme", "z"), (8, "http://t.s.net/en/1#f", "")], "page_id int, url string, html string").withColumn("rule", F.lit("clash"))
    rules = spark.createDataFrame([("a.com", "/", "allow"), ("net", "/", "block"), ("s.net", "/en/", "allow")], "host string, path string, verdict string")
    clash = ("r", "rules", "found", "pages", "hot_", "n")
    out = url_filter.judge(pages.withColumns({c: F.lit("mine") for c in clash}), rules).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert got[1] == ("a.com", "/x", "a.com/", "allow") and got[2] == ("b.com", "/", None, "allow")
    assert got[4][2:] == ("net/", "block") and got[8] == ("t.s.net", "/en/1", "s.net/en/", "allow")
    assert got[5][2:] == (None, "block") and got[6] == ("", "", None, "allow") and got[7][:2] == ("", "")
    ranks = {r["page_id"]: (r["trust"], r["distrust"]) for r in out}
    assert ranks[1][0] > ranks[2][0] > ranks[3][0] > 0 and ranks[5][1] > 0
    assert all(r[c] == "mine" for r in out for c in clash)
    assert url_filter.judge(pages.where("false"), rules).count() == 0


def test_ranks_are_a_dense_personalised_pagerank(spark):
    rng = np.random.default_rng(5)
    n, seeds = 12, [0, 3]
    links = {(int(a), int(b)): int(rng.integers(1, 5)) for a, b in rng.integers(0, n - 2, (30, 2)) if a != b}
    w = np.zeros((n, n))
    for (a, b), k in links.items():
        w[a, b] = k
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", k) for (a, b), k in links.items()], "a string, b string, n long")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(edges, spark.createDataFrame([("h0", 2, 0), ("h3", 1, 1)], "host string, trust int, distrust int")).collect()}
    for kind, matrix, jump in ((0, w, {0: 2 / 3, 3: 1 / 3}), (1, w.T, {3: 1.0})):
        p = np.array([jump.get(i, 0.0) for i in range(n)])
        m = matrix / np.maximum(matrix.sum(1, keepdims=True), 1)
        rank = p.copy()
        for _ in range(300):
            moved = 0.85 * rank @ m
            rank = moved + (1 - moved.sum()) * p
        for i in range(n):
            assert got.get(f"h{i}", (0.0, 0.0))[kind] == pytest.approx(rank[i], abs=1e-3)


# ---- decontamination


def test_bm25_finds_all_above_the_threshold():
    rng = random.Random(4)
    words = ["q" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(8, 40)))) for i in range(60)]
    index = decontaminate.build(items, 0.3)
    position = {h: i for i, h in enumerate(index.vocabulary.tolist())}
    from tabvox.llm.textbytes import hash_bytes

    passages = [rng.choices(words, k=64) if i % 3 else items[i][1].split() for i in range(60)]
    pairs = sorted({(p, position[h]) for p, ws in enumerate(passages) for h in hash_bytes([w.encode() for w in ws]).tolist() if h in position})
    got = {(p, i): s for p, i, s in zip(*decontaminate.above(index, np.array([p for p, _ in pairs]), np.array([t for _, t in pairs])), strict=True)}
    weight = {}
    for t in range(len(index.vocabulary)):
        for e in range(index.entry_of[t], index.entry_of[t + 1]):
            for k in range(index.posting_of[e], index.posting_of[e + 1]):
                weight[t, index.item[k]] = index.weight[k]
    for p in range(60):
        terms = [t for q, t in pairs if q == p]
        for i in range(60):
            s = sum(weight.get((t, i), 0) for t in terms)
            assert ((p, i) in got) == (s >= index.threshold[i] - 1e-9 and s > 0)
            if (p, i) in got:
                assert got[p, i] == pytest.approx(s)


@pytest.mark.parametrize("size", [5, 33, 64, 100, 150, 200, 300, 400])
def test_copies_are_found_at_every_length_and_offset(size):
    rng = random.Random(size)
    words = ["q" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(600)]
    items = [(i, " ".join(rng.choices(words, k=size))) for i in range(20)]
    index = decontaminate.build(items, 0.5)
    order = [k[0] if isinstance(k, tuple) else k for k in index.items]
    texts = [" ".join(["zz"] * offset + [items[offset % 20][1]] + ["zz"] * (offset * 7 % 90)) for offset in range(70)]
    buf, off = as_bytes(pa.array(texts, pa.large_string()))
    got = {(row[0], order[row[1]]) for row in decontaminate.find(index, buf, off, 64, 5, 0.6, 0.6)}
    assert got == {(offset, offset % 20) for offset in range(70)}


def test_leaks_are_found_and_clean_texts_kept(spark, docs, odd):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: re.findall(r"[^\W_]+", r["text"].lower()) for r in benchmark.collect()}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        text = " " + " ".join(re.findall(r"[^\W_]+", (r["text"] or "").lower())) + " "
        want |= {(r["doc_id"], i) for i, w in items.items() if f" {' '.join(w)} " in text}
    whole = sorted(map(tuple, decontaminate.hits(docs, benchmark).collect()))
    assert {(r[0], r[1]) for r in whole} == want and want
    split = sorted(map(tuple, decontaminate.hits(docs, benchmark, group_items=7).collect()))
    assert [r[:2] + r[3:] for r in split] == [r[:2] + r[3:] for r in whole]
    assert [r[2] for r in split] == pytest.approx([r[2] for r in whole])  # scores don't depend on the groups
    flagged = {r["doc_id"] for r in decontaminate.flag(docs, benchmark).where("contaminated").collect()}
    assert flagged == {d for d, _ in want}
    assert decontaminate.hits(odd, benchmark).count() == 0 and decontaminate.flag(odd, benchmark.where("false")).where("contaminated").count() == 0
    assert decontaminate.hits(docs.where("false"), benchmark).count() == 0 and decontaminate.hits(docs.where("false"), benchmark, group_items=3).count() == 0


def test_digits_answers_and_letter_case(spark):
    items = [
        (1, "What is 12 * 7? 84", None), (2, "12 + 5", None), (3, "Anna has 31 apples and gives 14 to Ben, how many are left?", "17"), (4, "A question without an answer", "?!"),
        (5, "ΠΌΣΟ ΚΆΝΕΙ ΤΟ ΨΩΜΊ ΣΤΟ ΧΩΡΙΌ ΤΏΡΑ; ΔΎΟ ΕΥΡΏ", None), (6, "КТО НАПИСАЛ ВОЙНУ И МИР? ЛЕВ ТОЛСТОЙ", None), (7, "水的沸点是多少度", None), (8, "!!", None), (9, None, "x"),
    ]
    benchmark = spark.createDataFrame(items, "item_id int, text string, answer string")
    texts = {
        10: "so what is 3 plus nothing here", 11: "he asked what is 12 * 7? 84 of course", 12: "what is 12 * 7? 85", 13: "we saw 12 + 5 there",
        14: "Anna has 31 apples and gives 14 to Ben, how many are left? 17", 15: "Anna has 52 apples and gives 25 to Ben, how many are left? 27", 16: "a question without an answer",
        17: "πόσο κάνει το ψωμί στο χωριό τώρα; δύο ευρώ".upper().lower(), 18: "Кто написал войну и мир? Лев Толстой", 19: "水的沸点是多少度", 20: "!!", 21: None, 22: "",
    }
    docs = spark.createDataFrame([*texts.items(), (11, texts[11])], "doc_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.hits(docs, benchmark, answer="answer").collect()]
    assert sorted(got) == [(11, 1), (11, 1), (13, 2), (14, 3), (17, 5), (18, 6), (19, 7)]
    flagged = [r["doc_id"] for r in decontaminate.flag(docs, benchmark, answer="answer", group_items=2).where("contaminated").collect()]
    assert sorted(flagged) == [11, 11, 13, 14, 17, 18, 19]
    # without answers the item's own end is the answer
    assert {r["item_id"] for r in decontaminate.hits(docs.where("doc_id = 15"), benchmark.drop("answer")).collect()} <= {3}


def test_bm25_scores_equal_the_formula_from_texts(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(6, 20)))) for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=10) + items[i % 30][1].split() + rng.choices(words, k=9))) for i in range(60)]
    n, length = len(items), {i: len(t.split()) for i, t in items}
    mean = sum(length.values()) / n
    df = collections.Counter(w for _, t in items for w in set(t.split()))

    def weights(i):
        tf = collections.Counter(items[i][1].split())
        return {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[i] / mean)) for w, f in tf.items()}

    def share(part, around):
        k = min(5, len(part))
        grams = lambda ws: {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)}
        return len(grams(part) & grams(around)) / len(grams(part))

    want = {}
    for d, t in docs:  # each text is one passage
        for i, it in items:
            w, ws = weights(i), it.split()
            s, k = sum(v for x, v in w.items() if x in set(t.split())), max(1, len(ws) // 3)
            q, a = share(ws[:-k], t.split()), share(ws[-k:], t.split())
            if s >= 0.5 * sum(w.values()) and q >= 0.6 and a >= 0.6:
                want[d, i] = (s, q, a)
    schema = "doc_id long, text string"
    for group_items in (100, 11):
        got = decontaminate.hits(spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id long, text string"), group_items=group_items).collect()
        assert {(r["doc_id"], r["item_id"]): pytest.approx((r["score"], r["question_overlap"], r["answer_overlap"])) for r in got} == want and len(want) >= 60


# ---- token file


@pytest.mark.parametrize("bits", [3, 8])
def test_codes_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 511, 512, 5000):
        ids = np.where(rng.random(n) < 0.5, rng.integers(0, 200, n), rng.integers(0, 70_000, n))
        codes = token_file.Codes(token_file.pack(ids, bits), n, bits)
        assert codes.all().tolist() == ids.tolist()
        at = rng.integers(0, max(1, n), 300) if n else np.zeros(0, int)
        assert codes.at(at).tolist() == ids[at].tolist()


def test_token_file(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    path = token_file.new_path(spark)
    token_file.write(odd, path, TOKENIZER, end_id=2, parts=3)
    rows = sorted(((r[0], r[1]) for r in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for k, t in rows}
    got = sorted(token_file.read(spark, path).collect(), key=lambda r: r["start"])
    assert [r["key"] for r in got] == [k for k, _ in rows]
    at = 0
    for r in got:
        assert r["start"] == at and list(r["ids"]) == ids[r["key"]]
        at += len(r["ids"])
    digests = {(r["key"], r["ids_crc32"]) for r in token_file.read_digests(spark, path).collect()}
    assert digests == {(k, zlib.crc32(np.array(v, "<u4").tobytes())) for k, v in ids.items()}
    flat = [x for k, _ in rows for x in ids[k]]
    places = [0, 7, len(flat) - 1, 7, len(flat) + 3, -1, None]
    found = sorted((r[0], r[1]) for r in token_file.tokens_at(spark, path, spark.createDataFrame([(p,) for p in places], "position long")).collect())
    assert found == sorted((p, flat[p]) for p in (0, 7, 7, len(flat) - 1))


def test_token_file_is_the_librarys(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(7)
    end = "<|endoftext|>"
    parts = ["a", " b", "it's", "\n\n", "  ", "é", "字", "9", "!", end, "<|endof", "text|>", "\u1c89", "a\ua7cb", "\U000105c0\U000105c1", "\U00013460", "\u0378", "👍"]
    texts = [end, end * 3, f"a {end} b", "<|endof", "text|> next", "\u1c89 x\ua7cby", "plain words only", ""] + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(300)]
    for some in (texts, texts[:2]):
        path = token_file.new_path(spark)
        token_file.write(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), path, TOKENIZER, end_id=2, parts=2)
        got = {r["key"]: list(r["ids"]) for r in token_file.read(spark, path).collect()}
        assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(some)}


def test_classes_are_the_librarys_where_python_knows_the_character():
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(TOKENIZER).pre_tokenizer.pre_tokenize_str
    kinds, no = pretokens._classes()
    some = [c for c in (*range(0x32000), *range(0xE0000, 0xE1000)) if not no[c] and not 0xD800 <= c < 0xE000]

    def joined(x):  # is the character in one piece with x?
        begins = {a for _, (a, _) in split("".join(f"{x}{chr(c)}\n" for c in some))}
        return np.array([3 * i + 1 not in begins for i in range(len(some))])

    want = np.select([joined("a"), joined("1"), joined("!")], [pretokens.LETTER, pretokens.NUMBER, pretokens.OTHER], pretokens.SPACE)
    assert (kinds[some] == want).all()


# ---- quality rules


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(docs, odd):
    for df in (docs, odd):
        texts = [r["text"] for r in df.select("text").collect()]
        got = [tuple(r) for r in quality_rules.statistics(df).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()]
        assert sorted(got) == sorted(map(brute_quality, texts))


def test_decision_list_is_learned_and_applied(spark):
    rng = np.random.default_rng(0)
    n = 2000
    x = {"symbols": rng.random(n), "upper": rng.random(n), "words": rng.random(n)}
    bad = (x["symbols"] > 0.8) | ((x["upper"] > 0.7) & (x["words"] < 0.4))
    rules = quality_rules.learn(x, bad)
    hit = np.any([r.holds(x) for r in rules], axis=0)
    assert (hit & bad).sum() / bad.sum() > 0.9 and (hit & ~bad).sum() / max(1, hit.sum()) < 0.05
    df = spark.createDataFrame([("ok fine words here", 1), ("## ## ##", 0)], "text string, y int")
    rule = quality_rules.Rule((("symbols", ">=", 0.5),), 1.0, 1)
    got = quality_rules.statistics(df).select(quality_rules.verdict([rule]).alias("v"), quality_rules.fired([rule]).alias("f")).collect()
    assert sorted(map(tuple, got)) == [(False, 1), (True, 0)]
    assert quality_rules.learn(x, np.zeros(n, bool)) == []


# ---- HTML


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
        ("<div>a</div><div>b <b>c</b>\n d</div>", "a\nb c d"),
        ("<script>x<p></script><style>p{}</style>y<!-- <p>z -->", "y"),
        ("<title>t</title><p>a<span hidden>b</span><i style='display: none'>c</i>d", "ad"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "* a\n* b\n  * c"),
        ("<ol start=9><li>a<li>b</ol>", " 9. a\n10. b"),
        ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>x<br>y<td>2</table>", "Name       N\nlong name  1\nx          2\ny"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("<p>a</p></div></p>b", "a\n\nb"),
        ("<a href='x>y'>k</a><", "k<"),
        ("<div>" * 5000 + "deep" + "</div>" * 10, "deep"),
        ("<table><tr><td>out<table><tr><td>in</table></table>", "out\n\nin"),
    ],
)
def test_render(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize(
    "piece",
    ["<!-- a -->x", "<table><tr><td>", "<table><tr><td>a<tr><td>b<td>", "<table><caption>c", "<tr><td rowspan=0>x", "<tr><td><td>x", "<ul><li>a"],
)
def test_render_in_proportion_to_the_page(piece):
    """Four times the page takes about four times as long, and its text is a bounded multiple of it."""
    first = "<table><tr><td>" + "w" * 5000 + "<td>y" if piece.startswith("<tr") else ""
    took = []
    for n in (4000, 16000):
        page = first + piece * n
        began = time.process_time()
        text = html_text.render(page)
        took.append(time.process_time() - began)
        assert len(text) < 50 * len(page)
        assert text.count("x") == page.count("x")
    assert took[1] < 8 * took[0] + 0.2


def test_deep_tables_keep_their_text_and_near_ones_their_columns():
    deep = html_text.render("<table><tr><td>" * 12 + "<table><tr><td>a<td>b<tr><td>c<td>d</table>")
    assert deep.split("\n") == ["a", "b", "c", "d"]
    assert html_text.render("<table><tr><td>k<td><table><tr><td>a<td>b<tr><td>ccc<td>d</table></table>").split("\n") == ["k  a    b", "   ccc  d"]
    wide = html_text.render("<table><tr><td>" + "w" * 300 + "<td>y<tr><td>a<td>z</table>").split("\n")
    assert wide == ["w" * 300 + "  y", "a" + " " * (html_text.MOST_BEGIN - 1) + "z"]


def test_extract_of_an_empty_table_and_repeated_rows(spark):
    kind = "page_id int, html string, text string"
    assert html_text.extract(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, "<p>a", "k")] * 2 + [(None, "<p>" + "long " * 50000, None)]
    assert sorted((r["page_id"] or 0, len(r["text"])) for r in html_text.extract(spark.createDataFrame(rows, kind)).collect()) == [(0, 249999), (1, 1), (1, 1)]


def test_extract_keeps_columns(spark):
    df = spark.createDataFrame([(1, "<p>a", "k"), (2, None, None)], "page_id int, html string, text string")
    assert sorted(map(tuple, html_text.extract(df).collect())) == [(1, "a"), (2, "")]


# ---- byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(RANKS))


@pytest.fixture(scope="module")
def reference(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocabulary.tokens)}, special_tokens={})


def test_ids_are_tiktokens(vocabulary, reference):
    rng = random.Random(1)
    alphabet = list("ab  \n\n\t''''sstmdrevell 129ß²é.,!?-—字あ👍 \u0085 \x1c")
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(4000)] + [t for _, t, _ in ODD if t] + ["a" * 300, " " * 200, "!" * 500]
    buf, off = as_bytes(pa.array(texts))
    ids, begin = bpe._encode(pretokens.Memory(vocabulary.encode), buf, off)
    for i, text in enumerate(texts):
        assert ids[begin[i] : begin[i + 1]].tolist() == reference.encode_ordinary(text)


def test_appends_and_edits_are_exact(vocabulary):
    rng = random.Random(3)
    p = bpe.Prefixes(vocabulary).append(b"internationalisation" * 20)
    data = bytearray(b"internationalisation" * 20)
    for _ in range(20):
        at, gone, new = rng.randrange(len(data)), rng.randint(0, 3), bytes(rng.choices(b"abcxyz", k=rng.randint(0, 4)))
        p.edit(at, gone, new)
        data[at : at + gone] = new
        assert bytes(p.data) == bytes(data) and p.last == bpe.Prefixes(vocabulary).append(bytes(data)).last
    assert p.append(b"ing").ids() == bpe.Prefixes(vocabulary).append(bytes(data) + b"ing").ids()


def test_encode_decode_and_digests(spark, odd, reference):
    texts = [r["text"] or "" for r in odd.select("text").collect()]
    rows = bpe.decode(bpe.encode(odd, RANKS), RANKS).collect()
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted(t.encode() for t in texts)
    assert sorted(tuple(r["ids"]) for r in rows) == sorted(tuple(reference.encode_ordinary(t)) for t in texts)
    got = {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(odd, RANKS).collect()}
    ids = [reference.encode_ordinary(t) for t in texts]
    assert got == {(len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for x, t in zip(ids, texts, strict=True)}
