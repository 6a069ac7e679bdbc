"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap of question and answer.

Every text is cut into overlapping passages of `window` words (step `window // 2`; the last one ends with
the text), and every passage is a query against the index of items. Postings of each term are cut into
blocks of items with the largest weight of each block: passages whose terms' largest weights can't reach
the threshold are left at once, then blocks that can't, and only then items are scored. An item longer
than half a window is indexed as a whole and as overlapping stretches of half a window, and one of them is
enough: any such stretch of a text lies whole in a passage. The threshold of a stretch is a share of the
score that its own words get, so all stretches above it are found, whatever the item's length. A hit is
verified on the words around the passage: enough of the item's question and of its answer must be there
in order, as n-grams.

Items are indexed in groups of at most `group_items`; a group's index is sent to every task (its size is
bounded by three times the group's words), and further groups take further passes over the texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tabvox.llm.textbytes import Hasher, chunks, gather, hash_bytes, letters_and_digits, plus, spans, table, unique

BLOCK = 16
STEP = 1 << 20  # entries of the index that are looked at together
K1, B = 1.2, 0.75
_LETTERS = re.compile(rb"[^\x20]+")


def plain_words(text: str) -> list[bytes]:
    """Words of letters and digits, in lower case."""
    return _LETTERS.findall(letters_and_digits(np.frombuffer(text.encode(), np.uint8)).tobytes()) if text else []


def parts(text: str, answer: str | None = None) -> tuple[list[bytes], list[bytes]]:
    """Words of an item's question and answer; without an answer the last sentence (or, of one sentence, the last third) is it. An item of one word is both."""
    if answer is not None:
        return plain_words(text), plain_words(answer)
    cut = [m.end() for m in re.finditer(r"[.!?]\s+(?=\S)", text.rstrip())]
    if cut and plain_words(text[cut[-1] :]) and plain_words(text[: cut[-1]]):
        return plain_words(text[: cut[-1]]), plain_words(text[cut[-1] :])
    all_ = plain_words(text)
    k = max(1, len(all_) // 3)
    return (all_[:-k], all_[-k:]) if len(all_) > 1 else (all_, all_)


@dataclass
class Index:
    items: list  # keys
    vocabulary: np.ndarray  # sorted hashes of the items' words
    flags: np.ndarray  # which top bits of a hash occur in the vocabulary
    term_max: np.ndarray  # largest weight of each term
    entry_of: np.ndarray  # where each term's entries begin; an entry is a term's postings in one block of items
    block: np.ndarray  # of each entry
    block_max: np.ndarray  # largest weight of each entry
    posting_of: np.ndarray  # where each entry's postings begin
    item: np.ndarray  # stretch of each posting; a whole item is a stretch too
    weight: np.ndarray
    threshold: np.ndarray  # of each stretch
    lowest: np.ndarray  # threshold of each block
    question: list[np.ndarray]  # word hashes
    answer: list[np.ndarray]
    length: np.ndarray
    whole: np.ndarray  # the item of each stretch


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of word hashes; of fewer words the whole."""
    n = max(1, min(n, len(h)))
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (h[j : j + len(out)] ^ (h[j : j + len(out)] >> np.uint64(29)))
    return out


def stretches(n: int, size: int) -> list[tuple[int, int]]:
    """First word and end of the stretches of an item of n words: the whole, and if it is longer than size those of size words, half overlapping."""
    return [(0, n), *((a, a + size) for a in ([*range(0, n - size, max(1, size // 2)), n - size] if n > size else []))]


def build(rows: list[tuple], share: float, window: int = 64, corpus: tuple[int, float, dict[int, int]] | None = None) -> Index:
    """Index (key, text[, answer]) rows, short items first; items without a word are left out.

    corpus: the number of all items, their mean length and in how many of them each of these rows' words
    occurs, where these rows are a group of them.
    """
    rows = [(r, *parts(r[1], r[2] if len(r) > 2 else None)) for r in rows if r[1] is not None and plain_words(r[1])]
    rows.sort(key=lambda x: (len(x[1]) + len(x[2]), str(x[0][0]), x[0][1]))
    hashed = [(hash_bytes(q), hash_bytes(a)) for _, q, a in rows]
    docs = [np.concatenate(x) for x in hashed]
    vocabulary = np.unique(np.concatenate(docs)) if docs else np.zeros(0, np.uint64)
    half = max(1, window // 2)
    cut = sorted(((i, d[a:b]) for i, d in enumerate(docs) for a, b in stretches(len(d), half)), key=lambda x: len(x[1]))
    length = np.array([len(d) for d in docs], np.int64)
    whole, size = np.array([i for i, _ in cut], np.int64), np.array([len(d) for _, d in cut], np.int64)
    counted = [np.unique(np.searchsorted(vocabulary, d), return_counts=True) for _, d in cut]
    term, tf = (np.concatenate([c[j] for c in counted]) if docs else np.zeros(0, np.int64) for j in (0, 1))
    item = np.repeat(np.arange(len(cut)), [len(c[0]) for c in counted])
    # an item counts once for a term that several of its stretches hold
    df = np.bincount(unique(whole[item] * np.int64(len(vocabulary)) + term) % max(1, len(vocabulary)), minlength=len(vocabulary))
    items, mean = len(docs), length.mean() if len(docs) else 1.0
    if corpus:
        items, mean = corpus[:2]
        df = np.array([corpus[2][h] for h in vocabulary.view(np.int64).tolist()], np.int64)
    idf = np.log(1 + (items - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / max(1.0, mean)))
    threshold = share * np.bincount(item, weight, len(cut))
    order = np.lexsort((item, term))
    term, item, weight = term[order], item[order], weight[order]
    first = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(item // BLOCK, prepend=-1))
    block_max = np.maximum.reduceat(weight, first) if len(first) else weight
    term_max = np.zeros(len(vocabulary))
    np.maximum.at(term_max, term, weight)
    flags = np.zeros(1 << 20, bool)
    flags[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
    lowest = np.array([threshold[b : b + BLOCK].min() for b in range(0, len(cut), BLOCK)])
    return Index([r[0][0] for r in rows], vocabulary, flags, term_max, np.searchsorted(term[first], np.arange(len(vocabulary) + 1)), item[first] // BLOCK, block_max, np.append(first, len(term)), item, weight, threshold, lowest, [q for q, _ in hashed], [a for _, a in hashed], length, whole)


def above(index: Index, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, stretch, score) of all scores at or over a stretch's threshold; passage and term: distinct pairs, sorted.

    Passages, then blocks of stretches for a passage, are left when the sum of their terms' largest
    weights is under the threshold; what is left is scored exactly.
    """
    n = int(passage[-1]) + 1 if len(passage) else 0
    may = np.bincount(passage, index.term_max[term], n) >= index.threshold.min() - 1e-9
    keep = may[passage]
    passage, term = passage[keep], term[keep]
    found = []
    cost = np.cumsum(np.diff(index.entry_of)[term])
    at = 0
    while at < len(passage):  # some passages at a time, to bound memory
        stop = int(np.searchsorted(cost, (cost[at - 1] if at else 0) + STEP, "right"))
        stop = len(passage) if stop >= len(passage) else max(int(np.searchsorted(passage, passage[stop])), int(np.searchsorted(passage, passage[at], "right")))
        p, t = passage[at:stop], term[at:stop]
        base = int(p[0])
        at = stop
        count = np.diff(index.entry_of)[t]
        entry = gather(np.arange(len(index.block)), index.entry_of[:-1][t], count)
        pair = np.repeat(p - base, count) * len(index.lowest) + index.block[entry]
        bound = np.bincount(pair, index.block_max[entry])
        hold = (bound >= np.resize(index.lowest, len(bound)) - 1e-9)[pair]
        entry, pair = entry[hold], pair[hold]
        count = np.diff(index.posting_of)[entry]
        posting = gather(np.arange(len(index.item)), index.posting_of[:-1][entry], count)
        cell = np.repeat(pair // len(index.lowest), count) * len(index.threshold) + index.item[posting]
        score = np.bincount(cell, index.weight[posting])
        hit = np.flatnonzero(score >= np.resize(index.threshold, len(score)) - 1e-9)
        hit = hit[score[hit] > 0]
        found.append((hit // len(index.threshold) + base, hit % len(index.threshold), score[hit]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def find(index: Index, buf: np.ndarray, off: np.ndarray, window: int, n: int, question_share: float, answer_share: float):
    """Yield (text, item, score, question overlap, answer overlap, first word, words) of every verified hit of a chunk."""
    text = letters_and_digits(buf)
    start, end, ranges = spans(text != 32, off)
    h = Hasher(text)(start, end)
    maybe = np.flatnonzero(index.flags[(h >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(index.vocabulary, h[maybe]), len(index.vocabulary) - 1)
    hit = index.vocabulary[at] == h[maybe]
    place, term = maybe[hit], at[hit]
    step, size = max(1, window // 2), np.diff(ranges)
    many = np.where(size > 0, 1 + -(-np.maximum(0, size - window) // step), 0)
    doc = np.repeat(np.arange(len(size)), many)
    first = ranges[doc] + step * (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many))
    last = np.minimum(first + window, ranges[doc + 1])
    lo, hi = np.searchsorted(place, first), np.searchsorted(place, last)
    pair = unique(np.repeat(np.arange(len(first)), hi - lo) * np.int64(len(index.vocabulary)) + gather(term, lo, hi - lo))
    best: dict[tuple[int, int], tuple] = {}
    top: dict[tuple[int, int], float] = {}  # an item scores as its best stretch in the passage
    for p, stretch, score in zip(*above(index, pair // len(index.vocabulary), pair % len(index.vocabulary)), strict=True):
        top[p, index.whole[stretch]] = max(score, top.get((p, index.whole[stretch]), 0.0))
    for (p, item), score in top.items():
        i, reach = int(doc[p]), int(index.length[item])
        # the item's words may begin before or end after the passage
        x, y = max(int(ranges[i]), int(first[p]) - reach), min(int(ranges[i + 1]), int(last[p]) + reach)
        qs, ws = (_overlap(index.question[item], h[x:y], n), _overlap(index.answer[item], h[x:y], n))
        if qs >= question_share and ws >= answer_share:
            row = (float(score), qs, ws, int(first[p] - ranges[i]), int(last[p] - first[p]))
            old = best.get((i, int(item)))
            if old is None or (qs + ws, row[0]) > (old[1] + old[2], old[0]):
                best[i, int(item)] = row
    for (i, item), row in sorted(best.items()):
        yield i, item, *row


def _overlap(part: np.ndarray, around: np.ndarray, n: int) -> float:
    """Share of the part's n-grams that occur around; 0 for an empty part, which verifies nothing."""
    if not len(part):
        return 0.0
    n = min(n, len(part))
    return float(np.isin(np.unique(grams(part, n)), grams(around, n)).mean()) if len(around) >= n else 0.0


def _indexes(benchmark: DataFrame, item_key: str, item_text: str, answer: str | None, score_share: float, group_items: int, window: int):
    """Yield the broadcast index of each group of items, and the type of their keys."""
    items = benchmark.select(*[F.col(f"`{c}`") for c in (item_key, item_text, *([answer] if answer else []))])
    kind, send = items.schema[item_key].dataType, items.sparkSession.sparkContext.broadcast
    n_groups = max(1, -(-items.count() // group_items))
    if n_groups == 1:
        yield send(build([tuple(r) for r in items.collect()], score_share, window)), kind
        return
    grouped = items.withColumn("group_", F.pmod(F.xxhash64(item_key, item_text), F.lit(n_groups)))

    def words(batches):
        for batch in batches:
            rows = batch.to_pylist()
            docs = [hash_bytes(sum(parts(r[item_text], r[answer] if answer else None), [])) if r[item_text] is not None else np.zeros(0, np.uint64) for r in rows]
            own = [unique(d) for d in docs]
            who = np.repeat(np.arange(len(rows)), [max(1, len(d)) for d in own])
            flat = np.concatenate([d.view(np.int64) if len(d) else np.zeros(1, np.int64) for d in own])
            size = np.array([len(d) for d in docs], np.int64)[who]
            first = np.diff(who, prepend=-1) > 0  # an item's length counts once
            yield pa.RecordBatch.from_arrays([pa.array([rows[i]["group_"] for i in who], pa.int64()), pa.array(flat), pa.array(np.where(first, size, -1)), pa.array(size > 0)], ["group_", "hash", "size", "full"])

    found = table(grouped.mapInArrow(words, "group_ long, hash long, size long, full boolean"), "item-words").where("full")
    total, mean = found.where("size >= 0").agg(F.count("*"), F.avg("size")).first()
    counts = table(found.groupBy("hash").agg(F.count("*").alias("df")), "item-df")
    for g in range(n_groups):
        own = found.where(F.col("group_") == g).select("hash").distinct().join(counts.hint("merge"), "hash").collect()  # the words of group_items items at most
        rows = [tuple(r)[:-1] for r in grouped.where(F.col("group_") == g).collect()]
        yield send(build(rows, score_share, window, (total, float(mean or 1.0), dict(map(tuple, own))))), kind


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", answer: str | None = None, window: int = 64, score_share: float = 0.5, n: int = 5, question_share: float = 0.6, answer_share: float = 0.6, group_items: int = 20_000) -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap, first_word, n_words), a row for each text and item found in it.

    The passage of the best overlap is named by its first word (counted in words of letters and digits) and
    length; score is that of the item's best stretch in it. Null and wordless texts and items have no
    hit, nor has an item whose given answer has no word (with a null one it is split as without answers);
    repeated rows of docs have a row each, repeated items too; a score at the threshold counts. Columns other than those named are
    left out.
    """
    docs, out = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), None
    for shared, kind in _indexes(benchmark, item_key, item_text, answer, score_share, group_items, window):
        schema = T.StructType([*docs.select("key").schema.fields, T.StructField("item_id", kind), *plus(T.StructType([]), ("score", "double"), ("question_overlap", "double"), ("answer_overlap", "double"), ("first_word", "int"), ("n_words", "int")).fields])

        def run(batches, shared=shared, names=schema.names, kind=kind):
            index = shared.value
            for part, buf, off in chunks(batches, "text"):
                rows = list(find(index, buf, off, window, n, question_share, answer_share)) if index.items else []
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(cols[0])), pa.array([index.items[i] for i in cols[1]], to_arrow_type(kind)), *(pa.array(c, pa.float64()) for c in cols[2:5]), *(pa.array(c, pa.int32()) for c in cols[5:])], names)

        got = docs.mapInArrow(run, schema)
        out = got if out is None else out.union(got)
    return out.withColumnRenamed("key", key)


def flag(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", answer: str | None = None, window: int = 64, score_share: float = 0.5, n: int = 5, question_share: float = 0.6, answer_share: float = 0.6, group_items: int = 20_000) -> DataFrame:
    """docs with contaminated: does hits find an item in the row's text?

    Null and empty texts have none; a column of that name is replaced, all others stay.
    """
    docs = docs.drop("contaminated").withColumn("contaminated", F.lit(False))
    at = docs.columns.index("contaminated")
    for shared, _ in _indexes(benchmark, item_key, item_text, answer, score_share, group_items, window):

        def run(batches, shared=shared):
            for part, buf, off in chunks(batches, text):
                found = part.column(at).to_numpy(zero_copy_only=False).copy()
                if shared.value.items:
                    found[[row[0] for row in find(shared.value, buf, off, window, n, question_share, answer_share)]] = True
                yield part.set_column(at, "contaminated", pa.array(found))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
