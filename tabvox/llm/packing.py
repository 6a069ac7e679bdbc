"""Pack token sequences into as few bins of a capacity as possible, by a configuration linear program.

A configuration says how many pieces of each length lie in one bin. The linear program over the
histogram of lengths (as many rows as the capacity, whatever the number of documents) is solved by
multiplicative weights: each step prices the lengths, a bounded knapsack by dynamic programming finds
the dearest configuration, and the lengths that it covers lose weight. Steps are whole bins, so the
solution is rounded down as it grows; the last few bins' pieces are placed best fit.
Spark encodes, counts lengths, and gives each piece its rank among those of its length; the rank says
which bin of which configuration is its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvox.llm import pretokens
from tabvox.llm.positions import numbered
from tabvox.llm.textbytes import chunks, gather, owner, plus, table
from tabvox.llm.token_file import apart, library_memory

# ---- the linear program ----


def knapsack(count: np.ndarray, price: np.ndarray) -> np.ndarray:
    """The dearest configuration: how many of each length, at most count of it, fit into the capacity len(count) - 1."""
    room = len(count) - 1
    items = []
    for length in np.flatnonzero(count[1:] > 0)[::-1] + 1:
        most, size = int(min(count[length], room // length)), 1
        while most > 0:  # 1, 2, 4, ... copies and the rest give every number up to most
            k = min(size, most)
            items.append((int(length), k, float(price[length]) * k))
            most, size = most - k, 2 * size
    best = np.zeros(room + 1)
    took = np.zeros((len(items), room + 1), bool)
    for i, (length, k, gain) in enumerate(items):
        at = length * k
        got = best[: room + 1 - at] + gain
        np.greater(got, best[at:], out=took[i, at:])
        best[at:] = np.where(took[i, at:], got, best[at:])
    chosen, left = np.zeros(room + 1, np.int64), room
    for i in range(len(items) - 1, -1, -1):
        if took[i, left]:
            chosen[items[i][0]] += items[i][1]
            left -= items[i][0] * items[i][1]
    return chosen


def best_fit(count: np.ndarray) -> list[np.ndarray]:
    """Bins of the pieces of count, longest first, each into the fullest bin that has room."""
    room = len(count) - 1
    gaps: list[list[int]] = [[] for _ in range(room + 1)]
    open_, bins = 0, []  # open_: bit g is set if a bin has a gap of g
    for length in np.flatnonzero(count[1:] > 0)[::-1] + 1:
        length = int(length)
        for _ in range(int(count[length])):
            fits = open_ >> length
            if fits:
                gap = length + (fits & -fits).bit_length() - 1
                b = gaps[gap].pop()
                if not gaps[gap]:
                    open_ &= ~(1 << gap)
            else:
                gap, b = room, len(bins)
                bins.append(np.zeros(room + 1, np.int64))
            bins[b][length] += 1
            if gap > length:
                gaps[gap - length].append(b)
                open_ |= 1 << (gap - length)
    return bins


def solve(count: np.ndarray, steps: int = 256, rate: float = 0.2, tilt: float = 0.1, priced: int = 128, last: int = 4) -> list[tuple[int, np.ndarray]]:
    """(bins, configuration) that hold exactly count[l] pieces of each length l.

    The program: as few bins as possible in all, so that every length is covered count[l] times. Each
    step adds bins of one configuration: a `steps`-th of all, or fewer, so many that no length is covered
    twice over (so the solution stays feasible and is rounded down to whole bins as it grows). A length's
    price a token is its weight: it falls by exp(-rate) while all its pieces are covered and rises with
    the share of all tokens that is, so what lags behind gets dearer; tilt makes long pieces dearer from
    the start, as they have fewer places. Of many lengths a step prices the `priced` dearest and about as
    many spread over the others, and all of them if a configuration of those leaves room. What fits into
    `last` bins, fewer pieces than last * capacity, is placed best fit.
    """
    rest, out = count.astype(np.int64).copy(), []
    room = len(count) - 1
    full, rest[room] = int(rest[room]), 0
    if full:  # nothing fits beside them
        whole = np.zeros(room + 1, np.int64)
        whole[room] = 1
        out.append((full, whole))
    lengths = np.arange(room + 1, dtype=np.int64)
    some, all_tokens = np.maximum(rest, 1), int((rest * lengths).sum())
    most, turn = max(1, all_tokens // room // steps), 0
    while (left := int((rest * lengths).sum())) > last * room:
        weight = (1 + tilt * lengths / room) * np.exp(rate * (rest / some - left / all_tokens))
        here, offered = np.flatnonzero(rest), rest
        if len(here) > 2 * priced:
            dear = here[np.argsort(-weight[here], kind="stable")[:priced]]
            offered = np.zeros_like(rest)
            for part in (dear, here[turn % 7 :: len(here) // priced]):
                offered[part] = rest[part]
        config = knapsack(offered, lengths * weight)
        if int((config * lengths).sum()) < room and offered is not rest:
            config = knapsack(rest, lengths * weight)
        used = np.flatnonzero(config)
        times = int(min(most, (rest[used] // config[used]).min()))
        out.append((times, config))
        rest -= times * config
        turn += 1
    return out + [(1, b) for b in best_fit(rest)]


class Places:
    """Where the piece of a length and a rank among its equals lies: its bin and its offset there."""

    def __init__(self, bins: list[tuple[int, np.ndarray]]):
        rows, seen, first = [], {}, 0
        for times, config in bins:
            at = 0
            for length in np.flatnonzero(config)[::-1].tolist():
                n = int(config[length])
                rows.append(((length << 40) + seen.get(length, 0), n, first, at))
                seen[length] = seen.get(length, 0) + times * n
                at += n * length
            first += times
        self.key, self.n, self.first, self.at = (np.array(x, np.int64) for x in (zip(*sorted(rows), strict=True) if rows else ([],) * 4))

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << 40) + rank
        i = np.searchsorted(self.key, key, "right") - 1
        j = key - self.key[i]
        return self.first[i] + j // self.n[i], self.at[i] + j % self.n[i] * length


# ---- the Spark part ----


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32): each whole text (null: empty) as the library encodes it, then end_id.

    Only documents of more than capacity ids are cut, into pieces of capacity; the first may be shorter.
    """
    kind = docs.schema[key].dataType
    schema = plus(T.StructType([T.StructField("key", kind)]), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"))

    def run(batches):
        memory, added = library_memory(tokenizer)
        for batch, buf, off in chunks(batches):
            ids, at = encoded(memory, added, buf, off, end_id)
            size = np.diff(at)
            many = -(-size // capacity)
            who = np.repeat(np.arange(len(size)), many)
            piece = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
            short = size - (many - 1) * capacity
            start = np.where(piece > 0, short[who] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, short[who])
            raw, begin = ids.astype("<u4").tobytes(), (at[:-1][who] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(who)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], schema.names)

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def encoded(memory: pretokens.Memory, added: list[bytes], buf: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, end_id after each, and where each text's begin (len + 1)."""
    start, end, ranges = pretokens.split(buf, off)
    alone = apart(buf, off, added)
    if len(alone):
        keep = ~np.isin(owner(ranges), alone)
        start, end, ranges = start[keep], end[keep], np.concatenate([[0], np.cumsum(keep)])[ranges]
    ids, begin, number = memory.ids(buf, start, end)
    size = np.diff(begin)[number]
    at = np.concatenate([[0], np.cumsum(size)])[ranges]
    own = gather(ids, begin[:-1][number], size)
    if len(alone):
        made = [np.frombuffer(x, np.uint32) for x in memory.encode(buf, off[alone], off[alone + 1])]
        more = np.zeros(len(at), np.int64)
        more[alone + 1] = [len(x) for x in made]
        own = np.insert(own, np.repeat(at[alone], more[alone + 1]), np.concatenate(made))
        at = at + np.cumsum(more)
    return np.insert(own, at[1:], end_id), at + np.arange(len(at))


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of docs.

    start counts the document's ids before the piece; a sequence's pieces lie without gaps from offset 0,
    longest first. Null and empty texts are a piece of end_id alone; rows of null or equal keys are
    documents of their own; an empty table gives no rows. Other columns, whatever their names, don't
    matter. The driver holds the histogram and the configurations, whose sizes depend on capacity only.
    """
    if capacity < 1 or capacity >= 1 << 20:
        raise ValueError("capacity must be at least 1 and below 2**20")
    cut = table(pieces(docs, tokenizer, end_id, capacity, text, key), "pieces")
    count = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # capacity rows at most
        count[length] = n
    places = docs.sparkSession.sparkContext.broadcast(Places(solve(count)))
    ranked = numbered(cut, "length", ["key", "piece"], "ranked").drop("total")
    schema = plus(T.StructType([f for f in ranked.schema.fields if f.name != "pos"]), ("sequence_id", "long"), ("offset", "long"))

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "pos"))
            own = [batch.column(f.name) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, places.value.of(length, rank))], schema.names)

    return ranked.mapInArrow(run, schema).withColumnRenamed("key", key).select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
