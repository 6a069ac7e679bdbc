"""Language identification: averaged hashed subword embeddings and a linear softmax.

Training runs in numpy on a bounded sample of labelled rows (per_language texts of each language at
most, about); scoring is one map over all rows. A text is the mean embedding of its hashed byte
n-grams; as the softmax layer is linear, scoring adds each n-gram's logits. A temperature fitted on
texts kept out of training calibrates the probabilities, and what stays under `reject_below` is
rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvox.llm.textbytes import chunks, letters_only, plus, share, sums

BITS = 16
ORDERS = (2, 3, 4)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # (2**BITS + 1, languages): the embedding of each bucket through the softmax layer
    bias: np.ndarray
    temperature: float


def grams(buf: np.ndarray, off: np.ndarray):
    """Yield for each order the buckets of its n-grams and their range for each text."""
    text = letters_only(buf)
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32)
    off = np.concatenate([[0], np.cumsum(keep)])[off]
    text = text[keep].astype(np.uint32)
    for k in ORDERS:
        n = len(text) - k + 1
        if n <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(off), np.int64)
            continue
        value = np.zeros(n, np.uint32)
        for j in range(k):
            value |= text[j : j + n] << np.uint32(8 * j)
        bucket = ((value * np.uint32(2654435761) + np.uint32(k * 40503)) * np.uint32(2246822519)) >> np.uint32(32 - BITS)
        inside = np.ones(n, bool)  # n-grams don't cross the end of a text
        for j in range(1, k):
            at = off[1:] - j
            inside[at[(at >= 0) & (at < n)]] = False
        ranges = np.concatenate([[0], np.cumsum(inside)])[np.minimum(off, n)]
        yield bucket[inside].astype(np.int64), ranges


def train(texts: list[str], languages: list[str], dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Fit by stochastic gradient descent; a fifth of the texts only fits the temperature."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((2**BITS, 0), np.float32), np.zeros(0), 1.0)
    docs = []
    for _, buf, off in chunks([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])], limit=1 << 20):
        parts = list(grams(buf, off))
        for i in range(len(off) - 1):
            count = np.bincount(np.concatenate([b[r[i] : r[i + 1]] for b, r in parts]))
            ids = np.flatnonzero(count)
            docs.append((ids.astype(np.int32), (count[ids] / max(1, count.sum())).astype(np.float32)))
    label = np.array([names.index(x) for x in languages])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs))
    held = order[: len(docs) // 5]
    order = order[len(docs) // 5 :]
    table = rng.normal(0, 0.1, (2**BITS, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (dim, len(names))).astype(np.float32), np.zeros(len(names), np.float32)

    def softmax(z):
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(order):
            ids, weight = docs[i]
            if not len(ids):
                continue
            mean = weight @ table[ids]
            error = softmax(mean @ out + bias)
            error[label[i]] -= 1
            back = out @ error
            out -= step * np.outer(mean, error)
            bias -= step * 0.1 * error
            table[ids] -= (step / np.sqrt((weight**2).sum())) * np.outer(weight, back)
    logits = table @ out
    z = np.array([docs[i][1] @ logits[docs[i][0]] + bias for i in held if len(docs[i][0])]).reshape(-1, len(names))
    y = label[[i for i in held if len(docs[i][0])]]
    temperature = 1.0
    if len(z):
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(z)), y] + 1e-12).mean()
        temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
    return Model(names, logits.astype(np.float32), bias.astype(np.float64), temperature)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 800, **settings) -> Model:
    """Train on about per_language rows of each language, picked by a hash of key and text; equal texts count once.

    The sample's size is bounded by per_language times the number of languages, but for chance. Rows
    without a text or language are left out.
    """
    own = docs.select(F.col(f"`{lang}`").alias("l"), F.col(f"`{text}`").alias("t"), F.col(f"`{key}`").alias("k"))
    known = own.where(F.col("l").isNotNull() & F.col("t").isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy("l").count().collect()}
    if not sizes:
        return train([], [])
    rate = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, per_language / n))])
    picked = known.where(share(F.struct("k", "t"), rate[F.col("l")])).groupBy("l", "t").agg(F.lit(1)).select("l", "t").toArrow()
    rows = sorted(zip(picked.column("l").to_pylist(), picked.column("t").to_pylist(), strict=True))  # Spark may deliver them in any order
    return train([t for _, t in rows], [x for x, _ in rows], **settings)


def score(model: Model, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Calibrated probabilities of each language for each text."""
    total, count = np.zeros((len(off) - 1, len(model.languages))), np.zeros(len(off) - 1)
    for bucket, ranges in grams(buf, off):
        count += np.diff(ranges)
        for j in range(len(model.languages)):
            total[:, j] += sums(np.ascontiguousarray(model.logits[:, j])[bucket], ranges)
    z = (total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def predict(docs: DataFrame, model: Model, text: str = "text", reject_below: float = 0.5) -> DataFrame:
    """Add lang_pred, score and rejected to docs.

    Null texts and texts without a letter get `und`, score 0 and are rejected; so is what scores
    under reject_below. An empty training set makes every row `und`. Columns of docs by these names
    are replaced; all other columns stay.
    """
    made = ["lang_pred", "score", "rejected"]
    docs = docs.drop(*made)
    if not model.languages:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = plus(docs.schema, ("lang_pred", "int"), ("score", "double"))

    def run(batches):
        m = shared.value
        for part, buf, off in chunks(batches, text):
            p = score(m, buf, off)
            best = p.argmax(1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best, pa.int32()), pa.array(p[np.arange(len(best)), best])], [*part.schema.names, "lang_pred", "score"])

    out = docs.mapInArrow(run, schema)
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    name = F.array(*[F.lit(x) for x in model.languages])
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(letter, F.element_at(name, F.col("lang_pred") + 1)).otherwise(F.lit("und")).alias("lang_pred"),
        F.when(letter, F.col("score")).otherwise(F.lit(0.0)).alias("score"),
        (~letter | (F.col("score") < reject_below)).alias("rejected"),
    )
