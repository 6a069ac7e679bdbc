"""Phrase collocations: frequent phrases of 2 to `longest` words whose words attract each other.

Only the longest windows are counted. Each word of a piece of text starts one window of `longest` lead
columns, padded with nulls beyond the piece; a ROLLUP over the columns then sums the windows of every
shorter prefix, and as each occurrence of a phrase starts exactly one window, these sums are the counts
of all phrases, of all words, and of the words in all. No shorter n-gram is made for counting.

Two words that don't follow each other often enough can't stand in a phrase that is frequent, so a
window is cut (padded) where that is so. The pairs are found beforehand by 64-bit hashes and passed on as
a bitmap of a fixed size; a clash there only leaves a window longer. Texts are cut into chains where that
is so, and Spark makes a chain's windows and sums them before it shuffles: chains have no word twice (but a few
in long ones), so no more is sent than the texts hold, however many pairs become frequent. What is
shuffled, rolled up and compared are the words themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabvox.llm.textbytes import FOLD, Hasher, chunks, gather, hash_bytes, mix, owner, ranges_of, release, spans, table

# fixed values: the characters that end a piece of text, and those between words
STOPS, BLANKS = (*map(ord, ".,;:!?"), 0x0A, 0x0B, 0x0C, 0x0D), (0x20, 0x09)
_STOP, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(STOPS)] = True
_BREAK[[*STOPS, *BLANKS]] = True
HELD = 1 << 20  # distinct rows that a task holds before it sends them on
SENT = 1 << 15  # of them in a batch
PART = 32  # windows that a row of a chain starts
SALTS = 16
U = np.uint64


class _Words:
    """The words of a chunk: where they lie, their group's number, hashes by group, and whether the next one is in the same piece."""

    def __init__(self, batch: pa.RecordBatch, buf: np.ndarray, off: np.ndarray):
        self.start, self.end, ranges = spans(~_BREAK[buf], off)
        groups = batch.column("lang").dictionary_encode()
        self.names = groups.dictionary.to_pylist()
        self.group = groups.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner(ranges)]
        self.salt = mix(hash_bytes([x.encode() for x in self.names], folded=False))
        self.hash = mix(Hasher(buf)(self.start, self.end) ^ self.salt[self.group]) if len(self.start) else np.zeros(0, U)
        piece = np.concatenate([[0], np.cumsum(_STOP[buf])])[self.start] + owner(ranges)  # grows at each stop and at each text
        self.joins = np.zeros(len(self.start), bool)
        self.joins[:-1] = piece[1:] == piece[:-1]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(0x9E3779B97F4A7C15) + b)


def _count(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct key, and how often it occurs."""
    _, at, n = np.unique(keys, return_index=True, return_counts=True)
    return at, n


def _merged(parts):
    """Parts (keys, columns of numbers, counts), one row a key as far as a task holds them."""
    held, rows = [], 0

    def parted(key, columns, n):
        for i in range(0, len(key), SENT):
            yield key[i : i + SENT], [c[i : i + SENT] for c in columns], n[i : i + SENT]

    def joined():
        release()
        key, at, which = np.unique(np.concatenate([k for k, _, _ in held]), return_index=True, return_inverse=True)
        n = np.bincount(which, np.concatenate([c for _, _, c in held]), len(key)).astype(np.int64)  # below 2**53, so exact
        return key, [np.concatenate([p[1][i] for p in held])[at] for i in range(len(held[0][1]))], n

    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows >= HELD:
            held = [joined()]
            rows = len(held[0][0])
            if rows >= HELD // 2:
                yield from parted(*held.pop())
                rows = 0
    if held:
        yield from parted(*joined())


def _frequent_pairs(texts: DataFrame, least: int) -> DataFrame:
    """(a, b): hashes of words that follow each other at least `least` times within a group."""

    def parts(batches):
        for batch, buf, off in chunks(batches):
            w = _Words(batch, buf, off)
            first = np.flatnonzero(w.joins)
            key = _pair(w.hash[first], w.hash[first + 1])
            at, n = _count(key)
            yield key[at], [w.hash[first[at] + k] for k in (0, 1)], n

    def run(batches):
        for _, pair, n in _merged(parts(batches)):
            yield pa.RecordBatch.from_arrays([*(pa.array(h.view(np.int64)) for h in pair), pa.array(n)], ["a", "b", "n"])

    return texts.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("a", "b")


def _bitmap(pairs: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, set at the hashes of pairs and of their words."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False).view(U) for c in ("a", "b"))
            at = np.unique(np.concatenate([_pair(a, b), a, b]) >> U(64 - bits))
            slot, begin = np.unique(at >> U(6), return_index=True)
            if len(slot):
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(np.bitwise_or.reduceat(U(1) << (at & U(63)), begin).view(np.int64))], ["slot", "bits"])

    rows = pairs.mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2**bits / 64 rows at most
    out = np.zeros(1 << (bits - 6), U)
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(U)
    return out


def _chains(texts: DataFrame, longest: int, bitmap) -> DataFrame:
    """(lang, words, starts, n): chains of words that follow each other in frequent pairs; the first `starts` words start a window each.

    A long chain comes in parts, each with the words that follow it in its last windows. A chain of one
    word comes once a chunk, n times; so do, without words, the words that are in no frequent pair, as they count among all words.
    """

    def run(batches):
        bits = bitmap.value
        shift = U(64 - (len(bits) * 64).bit_length() + 1)

        def known(h):
            at = h >> shift
            return (bits[at >> U(6)] >> (at & U(63))) & U(1) > 0

        for batch, buf, off in chunks(batches):
            w = _Words(batch, buf, off)
            if not len(w.hash):
                continue
            inside, leads = known(w.hash), np.zeros(len(w.hash), bool)
            first = np.flatnonzero(w.joins & inside)
            leads[first] = inside[first + 1] & known(_pair(w.hash[first], w.hash[first + 1]))
            opens = inside.copy()
            opens[1:] &= ~leads[:-1]
            begin, end = np.flatnonzero(opens), np.flatnonzero(inside & ~leads) + 1
            one, many = _count(w.hash[begin[end - begin == 1]])
            one = begin[end - begin == 1][one]
            begin, end = begin[end - begin > 1], end[end - begin > 1]
            parts = -(-(end - begin) // PART)
            at = ranges_of(np.zeros(len(parts), np.int64), parts) * PART + np.repeat(begin, parts)
            left = np.repeat(end, parts) - at
            other = np.bincount(w.group[~inside], minlength=len(w.names))
            none = np.flatnonzero(other)
            ones = np.ones(len(one) + len(none), np.int64)

            first = np.concatenate([at, one, np.zeros(len(none), np.int64)])
            size = np.concatenate([np.minimum(left, PART + longest - 1), ones[: len(one)], 0 * none])
            group = np.concatenate([w.group[at], w.group[one], none])
            word = ranges_of(first, size)
            length = w.end[word] - w.start[word]
            data, ends = FOLD[gather(buf, w.start[word], length)], np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            text = pa.Array.from_buffers(pa.string(), len(word), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), text)
            starts = np.concatenate([np.minimum(left, PART), ones]).astype(np.int32)
            n = np.concatenate([np.ones(len(at), np.int64), many, other[none]])
            made = pa.RecordBatch.from_arrays([pa.array(w.names, pa.string()).take(pa.array(group)), lists, pa.array(starts), pa.array(n)], ["lang", "words", "starts", "n"])
            for i in range(0, len(made), SENT):
                yield made.slice(i, SENT)

    return texts.mapInArrow(run, "lang string, words array<string>, starts int, n long")


def _windows(texts: DataFrame, longest: int, bitmap) -> DataFrame:
    """(lang, w1 ... w<longest>, n): windows and how often they occur; one of nulls only for the words that are in no frequent pair."""
    chains = _chains(texts, longest, bitmap)
    at = chains.select("lang", "words", "n", F.explode(F.sequence(F.lit(0), F.col("starts") - 1)).alias("at"))
    return at.select("lang", *[F.get("words", F.col("at") + k).alias(f"w{k + 1}") for k in range(longest)], "n")


def _salted(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """rows JOIN small (one row a key): small in SALTS copies, so that rows of one key go to as many tasks."""
    spread = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt_", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    return dealt.join(spread.hint("shuffle_hash"), [*on, "salt_"]).drop("salt_")


def counts(docs: DataFrame, longest: int = 5, least: int = 100, text: str = "text", lang: str = "lang", bits: int = 27) -> DataFrame:
    """(lang, k, phrase, words, f): how often each phrase of k words occurs, as a written table.

    Holds every phrase of 2 or more words that occurs `least` times or more, all words of these, and for
    each lang a row of k = 0, the number of its words.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(_frequent_pairs(texts, least), bits))
    names = [f"w{k + 1}" for k in range(longest)]
    sums = _windows(texts, longest, bitmap).rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("id"))
    level = F.lit(longest) - F.length(F.regexp_replace(F.bin("id"), "0", ""))  # each column that is summed over sets a bit
    last = F.element_at(F.array(F.lit(""), *names), F.col("k") + 1)  # null where the prefix is padded
    sums = sums.where(F.col("id") < (1 << (longest + 1)) - 1).withColumn("k", level.cast("int")).where(last.isNotNull() & ((F.col("k") < 2) | (F.col("f") >= least)))
    words = F.slice(F.array(*names), F.lit(1), F.col("k"))
    return table(sums.select("lang", "k", F.array_join(words, " ").alias("phrase"), words.alias("words"), "f"), "phrases")


def mine(docs: DataFrame, longest: int = 5, least: int = 100, scale: int = 1000, percent: int = 100, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's `top` phrases of 2 to `longest` words.

    A phrase with a = f(phrase) >= least, cut after its first k words, gives l = f(first part), r = f(rest)
    and floor(scale * a * n / (l * r)), where n is the lang's words; its lowest-scoring cut counts, of equal
    ones that of the smallest k. A phrase inside a longer one that occurs in at least percent of its cases
    is dropped. Rank goes by score and a, descending, then by the phrase's bytes, so there are no ties.
    Words are runs other than space and tab, with A-Z as a-z; pieces end at . , ; : ! ? and line ends.
    A null lang is `und`; null and empty texts have no words; repeated rows count again; other columns,
    whatever their names, don't matter; an empty table, or one without frequent phrases, gives no rows.
    Products are decimals of 38 digits; one beyond them is an error.
    """
    known = counts(docs, longest, least, text, lang)
    found = known.where("k >= 2").withColumnRenamed("f", "a")
    in_all = known.where("k = 0").select("lang", F.col("f").alias("n"))
    parts = known.where("k >= 1").select("lang", F.col("phrase").alias("part"), "f")

    # an occurrence of a longer phrase is one of its first and of its last words
    inner = found.where("k >= 3").select("lang", F.col("a").alias("longer"), F.explode(F.array(*[F.array_join(F.slice("words", s, F.col("k") - 1), " ") for s in (1, 2)])).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = found.join(inner.hint("shuffle_hash"), ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR 100 * longer < {percent} * a")).drop("longer")

    cut = free.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.withColumns({"first": F.array_join(F.slice("words", F.lit(1), F.col("cut")), " "), "rest": F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ")})
    cut = _salted(cut, parts.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"])
    cut = _salted(cut, parts.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
    cut = _salted(cut, in_all, ["lang"])
    whole = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    cut = cut.withColumn("score", F.expr(f"({whole(scale)} * {whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})"))
    best = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)  # of SALTS * top rows at most
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
