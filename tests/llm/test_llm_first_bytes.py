"""First tokens of sets by the upper bytes of their hashes: less to store and to shuffle, and no candidate less."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabvox.llm import jaccard_join as J


def test_upper_bytes_keep_order_and_range():
    h = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    for size in (1, 5, 8):
        raw = J._pack(h, size)
        assert len(raw) == size * len(h)
        assert (J._unpack(raw, size) == h >> np.uint64(64 - 8 * size) << np.uint64(64 - 8 * size)).all()
    assert J._pack(h[:0], 5) == b"" and len(J._unpack(b"", 5)) == 0


@pytest.mark.parametrize("size", [1, 5])
def test_clashes_lose_no_candidate(spark, monkeypatch, size):
    monkeypatch.setattr(J, "FIRST_BYTES", size)
    rng = np.random.default_rng(2)
    base = [[f"w{x}" for x in rng.integers(0, 10**6, 60)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 + i, " ".join([*w[:-1], "other"])) for i, w in enumerate(base[:20])]
    docs = spark.createDataFrame(rows, "key long, text string")
    own = J.sets(docs, "text", 4, 85)
    # 57 shingles: the first 57 - 49 + 8 of them
    assert {r[0] for r in own.select(F.octet_length("first")).collect()} == {16 * size}
    got = {r["key"] for r in J.candidates(own.select("key", "n", "s1", "first"), 85).collect()}
    linked = {*range(20), *range(100, 120)}
    assert got >= linked and (size == 1 or got == linked)
    found = {r["key"]: r["component_id"] for r in J.components(docs, key="key").collect()}
    assert found == {i: i - 100 if i >= 100 else i for i, _ in rows}
