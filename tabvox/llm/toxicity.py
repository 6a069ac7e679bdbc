"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled texts (max_examples of each class, about) gives the terms (words and
word beginnings that differ significantly between the classes) and the examples; the terms' document
frequencies come from all training texts. Examples with equal vectors are one entry with its counts,
so the index is bounded by the sample and may be broadcast. A query reads entries block by block in
the order of their upper bounds and stops when no block can hold a nearer one: the neighbours are
exact. Similarity-weighted votes, calibrated by isotonic regression on leave-one-out votes, give the
score, and the nearest examples are its evidence.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvox.llm.textbytes import Hasher, chunks, letters_only, owner, plus, ranges_of, share, spans, sums

BLOCK = 32
BEGINNINGS = (4, 5, 6, 7)


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of letters and of their beginnings, and the text of each."""
    plain = letters_only(buf)
    start, end, ranges = spans(plain != 32, off)
    doc, h = owner(ranges), Hasher(plain)
    out, of = [h(start, end)], [doc]
    for k in BEGINNINGS:
        longer = end - start > k
        out.append(h(start[longer], start[longer] + k) ^ np.uint64(k))
        of.append(doc[longer])
    return np.concatenate(out), np.concatenate(of)  # select() and vectors() leave the lowest bit out


@dataclass
class Index:
    vocabulary: np.ndarray  # sorted hashes
    idf: np.ndarray
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of each term's postings
    entry: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    block_max: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # (terms, blocks)
    cuts: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))  # where each block begins in a term's postings
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))  # weights of the examples of each entry
    clean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # an example's key for each entry
    prior: float = 0.0
    none_rate: float = 0.0  # of texts without a term
    knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    k: int = 16
    flags: np.ndarray | None = None

    def vectors(self, buf, off):
        """(text, term, tf-idf weight) of unit vectors, in the order of texts and terms."""
        h, doc = terms(buf, off)
        h >>= np.uint64(1)
        if self.flags is None:
            self.flags = np.zeros(1 << 20, bool)
            self.flags[(self.vocabulary >> np.uint64(43)).astype(np.int64)] = True
        maybe = np.flatnonzero(self.flags[(h >> np.uint64(43)).astype(np.int64)])
        h, doc = h[maybe], doc[maybe]
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == h
        pair, count = np.unique(doc[hit] * np.int64(len(self.vocabulary)) + at[hit], return_counts=True)
        doc, term = np.divmod(pair, len(self.vocabulary))
        value = (1 + np.log(count)) * self.idf[term]
        norm = np.sqrt(np.bincount(doc, value**2, len(off) - 1))
        return doc, term, value / norm[doc]

    def nearest(self, term: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k entries of largest cosine with the query, exactly; ties go to the smaller entry."""
        bound = value @ self.block_max[term]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        # the blocks of the largest bounds first, then all others that may still hold one of the k
        first = order[: 1 + self.k // BLOCK]
        e, s = self._inside(term, value, first)
        e, s = self._best(e, s)
        rest = order[len(first) :]
        if len(e) == self.k:
            rest = rest[bound[rest] >= s[-1] - 1e-12]
        if len(rest):
            more_e, more_s = self._inside(term, value, rest)
            e, s = self._best(np.concatenate([e, more_e]), np.concatenate([s, more_s]))
        return e, s

    def _best(self, e: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((e, -np.round(s, 12)))[: self.k]
        return e[order], s[order]

    def _inside(self, term: np.ndarray, value: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the blocks that share a term with the query, and their cosines."""
        lo, hi = self.cuts[term][:, blocks], self.cuts[term][:, blocks + 1]
        count = (hi - lo).ravel()
        at = ranges_of(lo.ravel(), count)
        slot = np.repeat(np.tile(np.arange(len(blocks)), len(term)) * BLOCK, count) + self.entry[at] % BLOCK
        got = np.bincount(slot, self.weight[at] * np.repeat(np.repeat(value, len(blocks)), count), len(blocks) * BLOCK)
        some = np.flatnonzero(got)
        return blocks[some // BLOCK] * BLOCK + some % BLOCK, got[some]

    def vote(self, entry, sim, without: tuple[int, float, float] | None = None) -> float:
        toxic, clean = self.toxic[entry], self.clean[entry]
        if without:
            toxic, clean = toxic - (entry == without[0]) * without[1], clean - (entry == without[0]) * without[2]
        w = sim**4
        return float(((w * toxic).sum() + 0.5 * self.prior) / ((w * (toxic + clean)).sum() + 0.5))

    def calibrated(self, votes):
        return np.interp(votes, *self.knots)


def select(texts: pa.Array, toxic: np.ndarray, least: float = 19.51, at_least: int = 6) -> np.ndarray:
    """Terms whose presence depends on the class: likelihood ratio statistic of at least `least`.

    19.51 is the 0.99999 quantile of its distribution for a term that doesn't. Other terms would only make
    texts of one topic near each other, whatever their class.
    """
    held, first = [], 0
    for _, buf, off in chunks([pa.RecordBatch.from_arrays([texts], ["text"])], limit=1 << 20):
        h, doc = terms(buf, off)
        order = np.argsort(doc, kind="stable")
        h, at = h[order], np.searchsorted(doc[order], np.arange(len(off)))
        # the lowest bit holds the class
        held += [(np.unique(h[at[i] : at[i + 1]] >> np.uint64(1)) << np.uint64(1)) | np.uint64(toxic[first + i]) for i in range(len(off) - 1)]
        first += len(off) - 1
    h = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
    del held
    name, at, n = np.unique(h >> np.uint64(1), return_index=True, return_counts=True)
    k = sums((h & np.uint64(1)).astype(np.int64), np.append(at, len(h)))
    total, total_k = len(toxic), int(toxic.sum())

    def g(observed, expected):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12)), 0)

    stat = 2 * sum(g(o, e) for o, e in ((k, n * total_k / total), (n - k, n * (total - total_k) / total), (total_k - k, (total - n) * total_k / total), (total - total_k - n + k, (total - n) * (total - total_k) / total)))
    return name[(stat >= least) & (n >= at_least) & (n <= total / 2)]


def build(index: Index, texts: pa.Array, toxic, weights, keys) -> Index:
    """Put the examples into blocks and fit the calibration."""
    n, first, parts = len(texts), 0, []
    for _, buf, off in chunks([pa.RecordBatch.from_arrays([texts], ["text"])], limit=1 << 20):
        doc, term, value = index.vectors(buf, off)
        parts.append((doc + first, term, value))
        first += len(off) - 1
    doc, term, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    ranges = np.searchsorted(doc, np.arange(n + 1))
    by: dict[bytes, int] = {}
    at = np.full(n, -1)
    for i in range(n):
        a, b = ranges[i], ranges[i + 1]
        if b > a:
            at[i] = by.setdefault(term[a:b].tobytes() + np.round(value[a:b], 9).tobytes(), len(by))
    none = at < 0
    index.prior = float((weights * toxic).sum() / max(weights.sum(), 1e-12))
    index.none_rate = float((weights * toxic)[none].sum() / max(weights[none].sum(), 1e-12)) if none.any() else index.prior
    first = np.full(len(by), -1)
    for i in np.flatnonzero(~none)[::-1]:
        first[at[i]] = i
    # similar vectors side by side, so that the bounds of a block are near its entries
    order = sorted(range(len(by)), key=lambda e: [int(x) for x in term[ranges[first[e]] : ranges[first[e] + 1]][np.argsort(-value[ranges[first[e]] : ranges[first[e] + 1]], kind="stable")][:4]])
    place = np.empty(len(by), np.int64)
    place[order] = np.arange(len(by))
    rows = [(t, place[e], v) for e in range(len(by)) for t, v in zip(term[ranges[first[e]] : ranges[first[e] + 1]], value[ranges[first[e]] : ranges[first[e] + 1]], strict=True)]
    rows.sort()
    t, e, v = (np.array([r[j] for r in rows], kind) for j, kind in ((0, np.int64), (1, np.int64), (2, float)))
    index.starts = np.searchsorted(t, np.arange(len(index.vocabulary) + 1))
    index.entry, index.weight = e, v
    n_blocks = -(-max(1, len(by)) // BLOCK)
    index.cuts = np.searchsorted(t * (n_blocks + 1) + e // BLOCK, np.arange(len(index.vocabulary))[:, None] * (n_blocks + 1) + np.arange(n_blocks + 1)[None, :])
    index.block_max = np.zeros((len(index.vocabulary), n_blocks))
    np.maximum.at(index.block_max, (t, e // BLOCK), v)
    seen = np.flatnonzero(~none)
    index.toxic = np.bincount(place[at[seen]], (weights * toxic)[seen], len(by))
    index.clean = np.bincount(place[at[seen]], (weights * (1 - toxic))[seen], len(by))
    index.example = np.asarray(keys)[first[order]] if len(by) else np.zeros(0, np.int64)
    votes = np.full(n, index.none_rate)
    cached: dict[int, tuple] = {}
    for i in seen:
        p = int(place[at[i]])
        if p not in cached:
            cached[p] = index.nearest(term[ranges[i] : ranges[i + 1]], value[ranges[i] : ranges[i + 1]])
        votes[i] = index.vote(*cached[p], without=(p, weights[i] * toxic[i], weights[i] * (1 - toxic[i])))
    index.knots = isotonic(votes[seen], toxic[seen].astype(float), weights[seen]) if len(seen) else index.knots
    return index


def isotonic(x, y, w) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least-squares nondecreasing fit, as knots for linear interpolation."""
    stack: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        stack.append([x[i], x[i], y[i] * w[i], w[i]])
        while len(stack) > 1 and stack[-2][2] / stack[-2][3] >= stack[-1][2] / stack[-1][3]:
            top = stack.pop()
            stack[-1] = [stack[-1][0], top[1], stack[-1][2] + top[2], stack[-1][3] + top[3]]
    px = np.array([v for s in stack for v in (s[0], s[1])])
    py = np.array([v for s in stack for v in [(s[2]) / (s[3])] * 2])
    return px, np.clip(py, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", max_examples: int = 2000, k: int = 16) -> Index:
    """Build the index from the texts of docs that labels (key, label 0 or 1) marks.

    At most about max_examples rows of each class, picked by a hash of key, are the examples: few
    enough to be sent to every task. Document frequencies of the terms are counted over all rows of
    docs. Null keys and labels are left out; of a key's several labels the largest counts, of its several
    texts the smallest. Other columns of docs don't matter.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.max(label) > 0).cast("int").alias("y"))
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    empty = Index(np.zeros(0, np.uint64), np.zeros(0))
    if not sizes:
        return empty
    rates = {y: min(1.0, max_examples / n) for y, n in sizes.items()}
    picked = known.where(share(F.col("k"), F.when(F.col("y") > 0, F.lit(rates.get(1, 0.0))).otherwise(F.lit(rates.get(0, 0.0))), 13))
    own = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    rows = own.join(F.broadcast(picked), "k").groupBy("k", "y").agg(F.min("t").alias("t")).select(F.col("k").cast("string"), "y", "t")
    rows = rows.toArrow().sort_by([("k", "ascending"), ("y", "ascending"), ("t", "ascending")])
    texts = pa.concat_arrays([c.cast(pa.large_string()) for c in rows.column("t").chunks]) if rows.num_rows else pa.array([], pa.large_string())
    toxic = rows.column("y").to_numpy().astype(int)
    weights = np.where(toxic > 0, 1 / max(rates.get(1, 1.0), 1e-9), 1 / max(rates.get(0, 1.0), 1e-9))
    empty.prior = empty.none_rate = sizes.get(1, 0) / sum(sizes.values())
    names = select(texts, toxic) if len(toxic) and toxic.min() != toxic.max() else np.zeros(0, np.uint64)
    if not len(names):
        return empty
    df, n = frequencies(docs, text, names)
    return build(Index(names, np.log((n + 1) / (df + 1)) + 1, k=k), texts, toxic, weights, rows.column("k").to_pylist())


def frequencies(docs: DataFrame, text: str, names: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many texts each term occurs, over all rows: one partial row for each term and task."""
    probe = Index(names, np.ones(len(names)))
    shared = docs.sparkSession.sparkContext.broadcast(probe)

    def count(batches):
        n, total = np.zeros(len(shared.value.vocabulary), np.int64), 0
        for part, buf, off in chunks(batches, text):
            _, term, _ = shared.value.vectors(buf, off)
            n += np.bincount(term, minlength=len(n))
            total += part.num_rows
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(n[some], total))], ["term", "n"])

    rows = docs.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect()
    df, total = np.zeros(len(names)), 0
    for term, n in rows:
        if term < 0:
            total = n
        else:
            df[term] = n
    return df, total


def score(docs: DataFrame, index: Index, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add score, predicted and evidence (keys of the nearest examples, nearest first) to docs.

    Texts without a term of the index (null and empty ones too) get the rate of such examples.
    Columns of docs by these names are replaced; all others stay.
    """
    docs = docs.drop("score", "predicted", "evidence")
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = plus(docs.schema, ("score", "double"), ("evidence", "array<string>"))

    def run(batches):
        ix, seen = shared.value, {}
        for part, buf, off in chunks(batches, text):
            n = part.num_rows
            out, why = np.full(n, ix.none_rate), [[] for _ in range(n)]
            if len(ix.vocabulary):
                doc, term, value = ix.vectors(buf, off)
                ranges = np.searchsorted(doc, np.arange(n + 1))
                for i in np.unique(doc):
                    q = slice(ranges[i], ranges[i + 1])
                    name = term[q].tobytes() + value[q].tobytes()
                    if name not in seen:
                        if len(seen) > 50_000:
                            seen.clear()
                        e, s = ix.nearest(term[q], value[q])
                        seen[name] = (float(ix.calibrated(ix.vote(e, s))), [str(ix.example[x]) for x in e[:3]])
                    out[i], why[i] = seen[name]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.clip(out, 0.0, 1.0)), pa.array(why, pa.list_(pa.string()))], [*part.schema.names, "score", "evidence"])

    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
