"""Language-model scoring with a probabilistic suffix tree over words.

The root is the add-one distribution over all training tokens, with exact counts for every word. The
tree holds every run of up to `depth` + 1 words that training texts have `at_least` times, so it grows
with the corpus. It is kept in Spark, nowhere whole: texts are stored in blocks, and in round after
round each block asks ranges of hashes for the counts of its words, then of its pairs, triples and so
on; ranges add up what blocks counted and answer them. A block only asks for runs whose beginning and
end are listed, and learns of the tree what its own tokens meet. Runs are known by 64-bit hashes.

A context is retained if the likelihood that its own next-symbol distribution gains over its parent's
(its count times the divergence) exceeds what its parameters cost. The first block that asked for a
run adds the run's term; ranges sum the terms of a context and tell the blocks that have it. Distributions
are smoothed by absolute discounting, the mass set free going to the parent. A token is scored in the
state of its longest retained suffix.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvox.llm.textbytes import Hasher, chunks, mix, plus, release, shared_dir, sums, words

END = np.uint64(0x1B873593CC9E2D51)  # stands for the end of a text
STEP = np.uint64(0x9FB21C651E98DF25)
BLOCK_BYTES = 4 << 20
BLOCKS_A_RANGE = 3  # a range of hashes holds about what so many blocks ask for
DISCOUNT = 0.7


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, END after each, and the ranges of the texts."""
    start, end, ranges = words(buf, off)
    h = np.insert(Hasher(buf)(start, end), ranges[1:], END)
    return h, ranges + np.arange(len(ranges))


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in sorted_keys, -1 where absent."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def order_of(keys: np.ndarray) -> np.ndarray:
    """Stable argsort of numbers from 0: by one sort of keys with their places in the low bits, where those are spare."""
    if not len(keys):
        return np.zeros(0, np.int64)
    keys = keys.astype(np.uint64)
    spare = np.uint64(min(63, 64 - int(keys.max()).bit_length()))
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    order = (np.sort(((keys << spare) & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    got = keys[order]
    return order if (got[1:] >= got[:-1]).all() else np.argsort(keys, kind="stable")


def distinct(keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where each first occurs, and for each key its place among them; order: a stable argsort."""
    got = keys[order]
    new = np.ones(len(got), bool)
    new[1:] = got[1:] != got[:-1]
    inverse = np.empty(len(got), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return got[new], order[new], inverse


def planes(values: np.ndarray) -> bytes:
    """The numbers' first bytes, then all second ones, and so on, which compresses better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def steps(ascending: np.ndarray) -> bytes:
    return planes(np.diff(ascending, prepend=ascending.dtype.type(0)))


def unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


@dataclass
class Level:
    keys: np.ndarray  # context * symbols + next symbol, sorted: the states of the next level too
    logp: np.ndarray  # log10 of the next symbol's probability, used where the context is retained
    back: np.ndarray  # log10 of what each context multiplies its parent's probabilities by; 0 if not retained
    retained: np.ndarray  # for each context


@dataclass
class Tree:
    symbols: np.ndarray  # sorted hashes of the listed words
    counts: np.ndarray
    n: int  # training tokens
    v: int  # distinct training tokens
    levels: list[Level] = field(default_factory=list)

    def root(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.n + self.v + 1))

    def contexts(self, symbol: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """For each level the context before each token, -1 if there is none; first marks beginnings of texts."""
        before = earlier(symbol, first)
        out = [before]
        for level in self.levels[:-1]:
            c = np.concatenate([[-1], out[-1][:-1]])
            key = np.where((c >= 0) & (before >= 0), c * len(self.symbols) + before, -1)
            some = np.flatnonzero(key >= 0)
            state = np.full(len(symbol), -1)
            state[some] = find(level.keys, key[some])
            out.append(state)
        return out

    def extra(self, symbol: np.ndarray, first: np.ndarray, root: np.ndarray, states: list[np.ndarray] | None = None) -> np.ndarray:
        """log10 probability of each token in its longest retained state; root: in the root; states: the contexts, if known."""
        out, open_ = np.zeros(len(symbol)), np.ones(len(symbol), bool)
        states = self.contexts(symbol, first) if states is None else states
        for level, state in reversed(list(zip(self.levels, states, strict=False))):
            at = np.flatnonzero(open_ & (state >= 0))
            at = at[level.retained[state[at]]]
            known = at[symbol[at] >= 0]
            place = find(level.keys, state[known] * len(self.symbols) + symbol[known])
            hit = known[place >= 0]
            out[hit] += level.logp[place[place >= 0]]
            open_[hit] = False
            back = at[open_[at]]
            out[back] += level.back[state[back]]
        return out + np.where(open_, root, 0.0)


def earlier(place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The place of the token before each, -1 at beginnings of texts."""
    out = np.concatenate([[-1], place[:-1]])[: len(place)]
    out[first] = -1
    return out


def discounted(counts: np.ndarray, context_counts: np.ndarray) -> np.ndarray:
    """Probability of each next symbol; context_counts: of its context."""
    return np.maximum(counts - DISCOUNT, 1e-9) / context_counts


def terms(context: np.ndarray, counts: np.ndarray, context_counts: np.ndarray, parent_logp: np.ndarray) -> np.ndarray:
    """For each context the sums over its given next symbols: of gains, probabilities, the parent's probabilities, counts, and 1.

    counts: of the symbols; context_counts: of all contexts; parent_logp: log10 of each symbol's
    probability by the parent.
    """
    own, size = discounted(counts, context_counts[context]), len(context_counts)
    gain = counts * (np.log(own) - parent_logp * np.log(10))
    return np.stack([np.bincount(context, w, size) for w in (gain, own, 10**parent_logp, counts, np.ones(len(counts)))])


def verdict(total: np.ndarray, context_counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts are retained, by the sums of their terms, and log10 of the mass that they leave to the parent."""
    gain, listed, listed_parent, counted, number = total
    free = np.maximum(1 - listed, 1e-12) / np.maximum(1 - listed_parent, 1e-12)
    gain = gain + (context_counts - counted) * np.log(free)
    cost = (number + 1) * 0.5 * np.log(max(n, 2))
    retained = (gain > cost) & (listed_parent < 1 - 1e-9) & (listed < 1)
    return retained, np.where(retained, np.log10(free), 0.0)


def retain(tree: Tree, level: Level, counts: np.ndarray, context_counts: np.ndarray, parent_logp: np.ndarray) -> None:
    """Fill in a level whose counts are all here: smooth each context's distribution and test its divergence from the parent's."""
    context = level.keys // max(1, len(tree.symbols))
    level.retained, level.back = verdict(terms(context, counts, context_counts, parent_logp), context_counts, tree.n)
    level.logp = np.log10(discounted(counts, context_counts[context]))


class Block:
    """A block's tokens and what of the tree they meet, from the answers to its rounds so far.

    Round 0 asks for words, round r for runs of r + 1 words and, from 2 on, for the verdict on contexts of
    r - 1. Lists hold one item a length of runs: places of the run that ends at each token, -1 if not listed, and of the listed runs hashes,
    counts, log10 probabilities of the last word, and from two words on the run without its first and whether the block adds its term.
    """

    def __init__(self, stored: pa.Table, answered: pa.Table | None, rounds: int, depth: int, n: int, v: int, at_least: int):
        row = {c: stored.column(c)[0].as_py() for c in ("learned", "sizes", "names", "tokens")}
        self.sizes = unplanes(row["sizes"], np.uint32).astype(np.int64)
        self.ranges = np.concatenate([[0], np.cumsum(self.sizes)])
        self.first = self.ranges[:-1]
        self.learned = np.repeat(np.frombuffer(row["learned"], bool), self.sizes)
        names = unsteps(unsqueezed(row["names"]))
        order = order_of(names)
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        self.names = names[order]
        self.at = place[unplanes(unsqueezed(row["tokens"]), np.uint32)]
        if not rounds:
            return
        answers = answered.sort_by([("round", "ascending"), ("range", "ascending")]).select(["round", "totals", "retained", "backs"]).to_pylist()

        def joined(r: int, what: str, kind: type) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *(unplanes(x[what], kind) for x in answers if x["round"] == r and x[what] is not None)])

        self.total = joined(0, "totals", np.int64)
        listed = self.total >= at_least
        self.tree = Tree(self.names[listed], self.total[listed], n, v)
        symbol = np.where(listed, np.cumsum(listed) - 1, -1)[self.at]
        self.places, self.hashes, self.counts, self.logp = [symbol], [self.tree.symbols], [self.tree.counts], [self.tree.root(self.tree.counts)]
        self.suffix, self.adds = [], []
        for r in range(1, rounds):
            if r <= depth:
                self.descend(joined(r, "totals", np.int64))
            if r >= 2:
                self.judged(r - 2, joined(r, "retained", bool), joined(r, "backs", np.float64))

    def candidates(self):
        """Runs one word longer than the last listed: their tokens, keys, hashes, the order by hash, and each token's place among keys."""
        longest, m = self.places[-1], max(1, len(self.tree.symbols))
        context = earlier(longest, self.first)
        where = np.flatnonzero((context >= 0) & (longest >= 0))
        key = context[where] * m + self.places[0][where]
        keys, _, inverse = distinct(key, order_of(key))
        hashes = mix(self.hashes[-1][keys // m] * STEP + self.tree.symbols[keys % m])
        return where, keys, hashes, order_of(hashes), inverse

    def descend(self, answer: np.ndarray) -> None:
        where, keys, hashes, order, inverse = self.candidates()
        got = np.empty(len(keys), np.int64)
        got[order] = answer
        listed = got > 0
        place = np.full(len(self.at), -1)
        place[where] = np.where(listed, np.cumsum(listed) - 1, -1)[inverse]
        suffix = np.empty(int(listed.sum()), np.int64)
        hit = np.flatnonzero(place >= 0)
        suffix[place[hit]] = self.places[-1][hit]
        self.tree.levels.append(Level(keys[listed], np.zeros(0), np.zeros(0), np.zeros(0, bool)))
        self.places.append(place)
        self.hashes.append(hashes[listed])
        self.counts.append(got[listed] >> 1)
        self.adds.append((got[listed] & 1) == 1)
        self.suffix.append(suffix)

    def left(self, at: int) -> np.ndarray:
        """Contexts of a level after which the block has a word that the level doesn't list."""
        context = earlier(self.places[at], self.first)
        out = np.zeros(len(self.hashes[at]), bool)
        out[context[(context >= 0) & (self.places[at + 1] < 0)]] = True
        return out

    def judged(self, at: int, retained: np.ndarray, backs: np.ndarray) -> None:
        level, order = self.tree.levels[at], order_of(self.hashes[at])
        level.retained, level.back = np.zeros(len(order), bool), np.zeros(len(order))
        level.retained[order] = retained
        level.back[order[retained & self.left(at)[order]]] = backs
        context = level.keys // max(1, len(self.tree.symbols))
        level.logp = np.log10(discounted(self.counts[at + 1], self.counts[at][context]))
        self.logp.append(np.where(level.retained[context], level.logp, self.logp[at][self.suffix[at]]))

    def count(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending hashes of the runs to ask for next, and how often the block's training texts have them."""
        if not hasattr(self, "tree"):
            return self.names, np.bincount(self.at[self.learned], minlength=len(self.names))
        where, keys, hashes, order, inverse = self.candidates()
        return hashes[order], np.bincount(inverse[self.learned[where]], minlength=len(keys))[order]

    def report(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ascending hashes of the contexts of a level, which the block leaves, places of those that it has terms of, and their counts and terms."""
        adds = np.flatnonzero(self.adds[at])
        context = self.tree.levels[at].keys[adds] // max(1, len(self.tree.symbols))
        made = terms(context, self.counts[at + 1][adds], self.counts[at], self.logp[at][self.suffix[at][adds]])
        order = order_of(self.hashes[at])
        made = np.concatenate([self.counts[at][None].astype(float), made])[:, order]
        some = np.flatnonzero(made[-1])
        return self.hashes[at][order], self.left(at)[order], some, made[:, some]

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the known tokens, and log10 probabilities by the root alone and by the tree."""
        total = self.total[self.at]
        root = self.tree.root(total)
        states = [earlier(x, self.first) for x in self.places[:-1]]
        return sums((total > 0).astype(np.int64), self.ranges), sums(root, self.ranges), sums(self.tree.extra(self.places[0], self.first, root, states), self.ranges)


ASKED = "block long, range int, names binary, counts binary, contexts binary, left binary, some binary, terms binary"
ANSWERED = "round int, block long, range int, totals binary, retained binary, backs binary, n long, v long"


def rows_of(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.Table.from_pylist(rows, pa.schema([(c, kinds[k]) for c, k in (x.split() for x in schema.split(", "))]))


def ask(block: int, names, report, ranges: int) -> pa.Table:
    """A row for each range that the block asks: names and counts of runs, contexts and their terms."""
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)

    def cuts(ascending: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.searchsorted(ascending, edges), [len(ascending)]])

    rows: dict[int, dict] = {}
    if names is not None:
        h, counts = names
        cut = cuts(h)
        for r in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[r], cut[r + 1]
            rows.setdefault(r, {}).update(names=steps(h[a:b]), counts=planes(counts[a:b].astype(np.uint32)))
    if report is not None:
        h, left, some, made = report
        cut = cuts(h)
        for r in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[r], cut[r + 1]
            i, j = np.searchsorted(some, [a, b])
            rows.setdefault(r, {}).update(contexts=steps(h[a:b]), left=left[a:b].tobytes(), some=planes((some[i:j] - a).astype(np.uint32)), terms=planes(made[:, i:j].reshape(-1)))
    return rows_of(ASKED, [{"block": block, "range": r, **row} for r, row in rows.items()])


def answer(asked: pa.Table, round_: int, n: int, at_least: int) -> pa.Table:
    """What all blocks together have of a range: counts of runs, twice, plus 1 for the block that adds the run's term; verdicts on contexts.

    Rows are taken by block, so sums don't depend on the order of arrival.
    """
    order = np.argsort(asked.column("block").to_numpy(), kind="stable").tolist()
    out = [{"round": round_, "block": asked.column("block")[i].as_py(), "range": asked.column("range")[i].as_py(), "n": 0, "v": 0} for i in order]

    def column(what: str, read):
        return [read(x.as_buffer()) if (x := asked.column(what)[i]).is_valid else np.zeros(0, np.uint64) for i in order]

    def joined(what: str):
        lists = column(what, unsteps)
        at, every = np.cumsum([0, *map(len, lists)]), np.concatenate(lists)
        del lists
        return at, *distinct(every, np.argsort(every, kind="stable"))

    at, u, first, inverse = joined("names")
    if len(u):
        counts = np.concatenate(column("counts", lambda x: unplanes(x, np.uint32)))
        total = np.bincount(inverse, counts, len(u)).astype(np.int64)
        if round_:
            told = np.where(total >= at_least, total * 2, 0)[inverse]
            told[first] += told[first] > 0
        else:
            told = total[inverse]
            out[0].update(n=int(total.sum()), v=int((total > 0).sum()))
        for x, i, j in zip(out, at, at[1:], strict=False):
            x["totals"] = planes(told[i:j])
    at, u, first, inverse = joined("contexts")
    if len(u):
        counts, total = np.zeros(len(u)), np.zeros((5, len(u)))
        for some, made, i in zip(column("some", lambda x: unplanes(x, np.uint32)), column("terms", lambda x: unplanes(x, np.float64)), at, strict=False):
            c = inverse[i + some.astype(np.int64)]
            made = made.reshape(6, len(c))
            counts[c] = made[0]
            total[:, c] += made[1:]
        retained, back = verdict(total, counts, n)
        for x, left, i, j in zip(out, column("left", lambda x: np.frombuffer(x, bool)), at, at[1:], strict=False):
            told = inverse[i:j]
            x.update(retained=retained[told].tobytes(), backs=planes(back[told[retained[told] & left.astype(bool)]]))
    return rows_of(ANSWERED, out)


def stored(docs: DataFrame) -> DataFrame:
    """docs (key, text, learned) as blocks of about BLOCK_BYTES of text: distinct words, the most frequent first, and the tokens' places in them.

    They are written in buckets, and so are the answers to them, so that rounds read both without a shuffle.
    """
    key = docs.schema["key"].dataType

    def encode(batches):
        task, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def block():
            keys, learned, hashes, ranges = zip(*held, strict=True)
            h = np.concatenate(hashes)
            u, _, inverse = distinct(h, order_of(h))
            rank = np.argsort(-np.bincount(inverse), kind="stable")
            place = np.empty(len(u), np.uint32)
            place[rank] = np.arange(len(u), dtype=np.uint32)
            every = pa.concat_arrays(keys)
            sizes = np.concatenate([np.diff(r) for r in ranges]).astype(np.uint32)
            cols = {"block": pa.array([task + number]), "key": pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every), "learned": [np.concatenate(learned).tobytes()], "sizes": [planes(sizes)], "names": [squeezed(steps(u[rank]))], "tokens": [squeezed(planes(place[inverse]))]}
            return pa.RecordBatch.from_pydict(cols)

        for part, buf, off in chunks(batches, limit=BLOCK_BYTES // 4):
            held.append((part.column("key"), part.column("learned").to_numpy(zero_copy_only=False).astype(bool), *tokens(buf, off)))
            size += len(buf) + len(off)
            if size >= BLOCK_BYTES:
                yield block()
                number, held, size = number + 1, [], 0
        if held:
            yield block()

    binary = [T.StructField(c, T.BinaryType()) for c in ("learned", "sizes", "names", "tokens")]
    return in_buckets(docs.mapInArrow(encode, T.StructType([T.StructField("block", T.LongType()), T.StructField("key", T.ArrayType(key)), *binary])), f"tabvox_blocks_{uuid.uuid4().hex}")


def in_buckets(made: DataFrame, name: str) -> DataFrame:
    """The table of the name in the shared folder, in buckets of blocks, with the rows of made added."""
    release()
    spark = made.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.repartition(buckets, "block").write.mode("append").bucketBy(buckets, "block").option("path", f"{shared_dir(spark).rstrip('/')}/tabvox/{name}").saveAsTable(name, format="parquet")
    return spark.table(name)


def score(docs: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", depth: int = 3, at_least: int = 4) -> DataFrame:
    """Train on the rows where learn holds and score all rows.

    Returns key, learned, n_tokens, n_known, train_tokens, base_score (the root alone) and score, both
    log10 probabilities. Null texts count as empty: just an end. Rows where learn is null aren't learned
    from. Repeated keys give a row each; other columns are left out.
    """
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.coalesce(learn, F.lit(False)).alias("learned"))
    blocks = stored(docs)
    ranges = max(1, -(-blocks.count() // BLOCKS_A_RANGE))
    rounds = depth + 2 if depth else 1
    name, answers, n, v = f"tabvox_answers_{uuid.uuid4().hex}", None, 0, 0
    for r in range(rounds):
        every = in_buckets(exchange(blocks.drop("key"), answers, r, depth, ranges, n, v, at_least), name)
        if not r:
            n, v = (x or 0 for x in every.agg(F.sum("n"), F.sum("v")).first())
        answers = every.drop("n", "v")

    schema = plus(docs.select("key", "learned").schema, ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"))
    names = schema.names

    def judge(group: pa.Table, answered: pa.Table) -> pa.Table:
        b = Block(group, answered, rounds, depth, n, v, at_least)
        known, base, full = b.scores()
        keys = group.column("key").combine_chunks().flatten()
        learned = np.frombuffer(group.column("learned")[0].as_py(), bool)
        return pa.table([keys, pa.array(learned), pa.array(b.sizes), pa.array(known), pa.array(np.full(len(known), n)), pa.array(base), pa.array(full)], names)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, schema).withColumnRenamed("key", key)


def exchange(blocks: DataFrame, answers: DataFrame | None, r: int, depth: int, ranges: int, n: int, v: int, at_least: int) -> DataFrame:
    """Round r: blocks ask ranges of hashes, which answer them; answers: of the rounds before."""

    def asks(group: pa.Table, answered: pa.Table) -> pa.Table:
        b = Block(group, answered, r, depth, n, v, at_least)
        return ask(group.column("block")[0].as_py(), b.count() if r <= depth else None, b.report(r - 2) if r >= 2 else None, ranges)

    def first(batches):
        for batch in batches:
            for i in range(len(batch)):
                yield from asks(pa.Table.from_batches([batch.slice(i, 1)]), None).to_batches()

    def answering(group: pa.Table) -> pa.Table:
        return answer(group, r, n, at_least)

    asked = blocks.mapInArrow(first, ASKED) if answers is None else blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(asks, ASKED)
    return asked.groupBy("range").applyInArrow(answering, ANSWERED)
