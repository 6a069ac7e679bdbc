"""The pipeline's stages take effect, one after the other."""

import itertools
import re

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline as C
from tabvox.llm import bpe

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.where(F.col("text").isNotNull()).limit(1).select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text", "lang", "source", "n_chars")
    blank = spark.createDataFrame([(20_000_000, "123", None, None, None), (20_000_001, None, None, None, None)], docs.schema)
    now, kept = docs.unionByName(extra).unionByName(blank), []
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns, name
        now = spark.createDataFrame(out.collect(), docs.schema)
        kept.append({r["doc_id"] for r in now.collect()})
    assert all(b <= a for a, b in zip(kept, kept[1:], strict=False))
    assert 20_000_000 in kept[0] and not {20_000_000, 20_000_001} & kept[1]
    assert 10_000_000 + extra.first()["doc_id"] - 10_000_000 not in kept[2]
    last = C.STAGES[-1][1](spark, now, SF)
    assert {r["doc_id"] for r in last.collect()} == kept[-1]
    assert bpe.digests(now.select("doc_id", "text"), P.path("byte_bpe_50k.tiktoken")).exceptAll(last).count() == 0


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    sets = {}
    for r in rows:
        w = words(r["text"])
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["doc_id"] for r in C.near_duplicate_stage(spark, docs, SF).collect()}
    assert got == {d for d in sets if find(d) == d} and len(got) < len(sets)


def test_decontamination_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r["doc_id"] for r in docs.collect() if not any(i in plain(r["text"]) for i in items)}
    assert {r["doc_id"] for r in C.decontamination_stage(spark, docs, SF).collect()} == want and len(want) < docs.count()


def test_stages_on_empty_tables_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in C.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    more = docs.withColumns({c: F.lit(1) for c in ("score", "predicted", "contaminated", "rejected", "component_id", "key", "node", "root")})
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, more, SF)
        assert out.columns == more.columns and 0 < out.count() <= more.count(), name


def test_run(spark):
    assert C.run(spark, SF).count() > 0
