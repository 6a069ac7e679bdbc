"""Exact Jaccard join of word-shingle sets, with its connected components.

Equal sets are one class first. Of each class's set the first tokens in the order of hashes are
counted over all sets; a set that shares too few of them with any other has no link and is skipped. Of
the sets left, all tokens are counted, and the rarest ones that must still hold a common token make a
set's index entries, each with its position in the set; tokens that occur once take up no place.

Index-level skipping: a list is kept in blocks of entries of like size and position. From the bounds of
a block (sizes, last position, most tokens after it) follows the largest overlap that any of its sets
can have with a query, or with a set of another block; a block that can't reach the link is skipped
without reading its entries.

Answer-level skipping: of each list one set (the pivot) is compared with the others, and from then on
sets that are like it are told apart by their differences to it alone: the overlap of two of them is
what both have of the pivot, less its size, plus the differences that they share. If that needs no
shared difference, both are linked to the pivot, so the pair tells nothing new. Else they must share
rare differences, and only these are indexed for them. Sets of unlike pivots meet in the plain lists;
sketches that differ in more bits than the sets may in tokens skip a pair. What stays is compared
exactly, so no link is lost that joins two components; `links` gives every link between different sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvox.llm.components import connected
from tabvox.llm.textbytes import Hasher, chunks, join_hot, mix, plus, table, unique, words

#: About so many tokens of sets are in a block, and of blocks' distinct tokens in a range of hashes.
BLOCK_TOKENS, RANGE_TOKENS = 500_000, 1_000_000
#: Bytes of a hash that are kept of the first tokens. A clash only adds a candidate, and these are compared by whole hashes.
FIRST_BYTES = 5
#: Bits of a set's sketch, in 64-bit words.
SKETCH_WORDS = 16
#: About so many entries are in a block of an index list, and blocks of one list in a task of a list's pairs.
BLOCK_ENTRIES, TASK_BLOCKS = 64, 32


def shingles(buf: np.ndarray, off: np.ndarray, width: int):
    """Yield for each text its sorted distinct shingle hashes; a text of fewer words is one shingle."""
    start, end, ranges = words(buf, off)
    w = Hasher(buf)(start, end)
    n = max(0, len(w) - width + 1)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n])
    for i in range(len(off) - 1):
        a, b = ranges[i], ranges[i + 1]
        if b - a >= width:
            yield unique(h[a : b - width + 1])
        elif b > a:
            one = np.uint64(b - a)
            for x in w[a:b]:
                one = mix(np.array([one]) * np.uint64(0x9E3779B97F4A7C15) + x)[0]
            yield np.array([one], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _least(n, percent: int):
    """The smallest overlap of a set of n with one linked to it."""
    return (n * percent + 99) // 100


def _spare(n, percent: int):
    """How many common tokens beyond one the first tokens of linked sets hold, at least."""
    return np.maximum(1, n * (100 - percent) // 100)


def _pack(h: np.ndarray, size: int) -> bytes:
    """The upper size bytes of each hash."""
    return h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unpack(raw: bytes, size: int) -> np.ndarray:
    """Hashes whose lower bytes are 0."""
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.reshape(-1).view(">u8").astype(np.uint64)


def _sign(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return int(mix(h).sum(dtype=np.uint64).astype(np.int64)), int(mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def sets(docs: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """(key, n, s1, s2, first): size and signature of each text's set and its first tokens in the order of hashes, by their upper bytes."""
    size = FIRST_BYTES

    def run(batches):
        for part, buf, off in chunks(batches, text):
            rows = []
            for h in shingles(buf, off, width):
                n = len(h)
                first = h[: min(n, n - _least(n, percent) + int(_spare(n, percent)))] if n else h
                rows.append((n, *_sign(h), _pack(first, size)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["key", "n", "s1", "s2", "first"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, n long, s1 long, s2 long, first binary")


def _count(sets: DataFrame, tokens: str, size: int, total: int, use, schema) -> DataFrame:
    """use(keys, sizes, sets, frequencies) for blocks of sets, with in how many sets of all each token is.

    size: bytes of a token. Blocks send their distinct tokens to ranges of hashes, which add up and answer each block in its
    own order; no row is made for a token.
    """
    n_blocks = max(1, total // BLOCK_TOKENS)
    bits = int(np.ceil(np.log2(max(1, total / RANGE_TOKENS))))
    placed = sets.select("key", "n", F.col(tokens).alias("tokens"), F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int").alias("block"))

    def ask(group: pa.Table) -> pa.Table:
        u, n = np.unique(_unpack(b"".join(group.column("tokens").to_pylist()), size), return_counts=True)
        n = n.astype(np.uint32)
        r = (u >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(u), np.int64)
        cut = np.flatnonzero(np.diff(r, prepend=-1))
        ends = [*cut[1:].tolist(), len(u)]
        block = group.column("block")[0].as_py()
        return pa.table({"range": pa.array(r[cut], pa.int32()), "block": pa.array([block] * len(cut), pa.int32()), "names": pa.array([_pack(u[i:j], size) for i, j in zip(cut, ends, strict=True)] if len(u) else [], pa.binary()), "counts": pa.array([n[i:j].tobytes() for i, j in zip(cut, ends, strict=True)] if len(u) else [], pa.binary())})

    def answer(group: pa.Table) -> pa.Table:
        names = [_unpack(x, size) for x in group.column("names").to_pylist()]
        own = [np.frombuffer(x, np.uint32) for x in group.column("counts").to_pylist()]
        u, inverse = np.unique(np.concatenate(names), return_inverse=True)
        df = np.bincount(inverse, np.concatenate(own)).astype(np.uint32)[inverse]
        at = np.cumsum([0, *map(len, names)])
        return pa.table({"block": group.column("block"), "range": group.column("range"), "dfs": pa.array([df[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())})

    def give(group: pa.Table, answered: pa.Table) -> pa.Table:
        raw = group.column("tokens").to_pylist()
        token = _unpack(b"".join(raw), size)
        dfs = answered.column("dfs").to_pylist()
        df = np.frombuffer(b"".join(dfs[i] for i in np.argsort(answered.column("range").to_numpy())), np.uint32)
        df = df[np.searchsorted(unique(token), token)]
        at = np.cumsum([0, *(len(x) // size for x in raw)])
        return use(group.column("key"), group.column("n").to_numpy(), token, df, at)

    answers = placed.groupBy("block").applyInArrow(ask, "range int, block int, names binary, counts binary").groupBy("range").applyInArrow(answer, "block int, range int, dfs binary")
    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(give, schema)


def candidates(reps: DataFrame, percent: int) -> DataFrame:
    """(key): the sets that share enough of their first tokens with others."""
    total = (reps.agg(F.sum(F.octet_length("first"))).first()[0] or 0) // FIRST_BYTES

    def use(keys, n, token, df, at):
        shared = np.add.reduceat(df > 1, at[:-1], dtype=np.int64) if len(n) else np.zeros(0, np.int64)
        return pa.table({"key": keys.filter(pa.array(shared >= _spare(_least(n, percent), percent)))})

    return _count(reps.drop("s1"), "first", FIRST_BYTES, total, use, reps.select("key").schema)


def entries(full: DataFrame, percent: int) -> DataFrame:
    """Index entries (token, key, n, pos, rest, df): of the sets that share enough tokens, the rarest that must hold a common one.

    pos: shared tokens of the set before this one, the rarest first; rest: those after it; df: length of the list, at most.
    """
    total = full.agg(F.sum("n")).first()[0] or 0

    def use(keys, n, token, df, at):
        least, own, made = _least(n, percent), [], [[], [], [], []]
        for i in range(len(n)):
            d, t = df[at[i] : at[i + 1]], token[at[i] : at[i + 1]]
            d, t = d[d > 1], t[d > 1]
            if len(t) >= least[i]:
                order = np.lexsort((t, d))[: len(t) - least[i] + 1]
                pos = np.arange(len(order))
                own.append(i)
                for a, b in zip(made, (t[order], pos, len(t) - 1 - pos, d[order]), strict=True):
                    a.append(b)
        who = np.repeat(np.array(own, np.int64), [len(x) for x in made[0]])
        cols = [pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for x in made]
        return pa.table({"key": keys.take(pa.array(who)), "n": pa.array(n[who], pa.int64()), "token": cols[0], "pos": cols[1], "rest": cols[2], "df": cols[3]})

    return _count(full, "set", 8, total, use, plus(full.select("key").schema, *((c, "long") for c in ("n", "token", "pos", "rest", "df"))))


def _full(docs: DataFrame, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(key, n, set, sketch) of the wanted (key, s1): sets as sorted 64-bit hashes.

    A bit of the sketch is the parity of the tokens that fall on it, so two sketches differ in no more
    bits than the sets in tokens.
    """
    docs = docs.join(wanted.hint("shuffle_hash"), "key")  # a key is wanted once

    def sketch(h: np.ndarray) -> list[int]:
        bit = np.bincount((mix(h) >> np.uint64(54)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
        return np.packbits(bit.astype(np.uint8)).view(np.int64).tolist()

    def run(batches):
        for part, buf, off in chunks(batches, text):
            wanted_sign = part.column("s1").to_pylist()
            some = [(i, h) for i, h in enumerate(shingles(buf, off, width)) if _sign(h)[0] == wanted_sign[i]]
            sets_ = [h for _, h in some]
            keys = part.column("key").take(pa.array([i for i, _ in some], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(h) for h in sets_], pa.int64()), pa.array([h.tobytes() for h in sets_], pa.binary()), pa.array([sketch(h) for h in sets_], pa.list_(pa.int64()))], ["key", "n", "set", "sketch"])

    made = docs.mapInArrow(run, plus(docs.select("key").schema, ("n", "long"), ("set", "binary"), ("sketch", "array<long>")))
    return made.dropDuplicates(["key"])


def _verify(pairs: DataFrame, full: DataFrame, differences: bool = False) -> DataFrame:
    """pairs (x, y, ...) with both = size of the intersection; delta: the tokens of one set only, where both is half of y or more."""
    left = full.select(F.col("key").alias("x"), F.col("set").alias("set_x"))
    right = full.select(F.col("key").alias("y"), F.col("set").alias("set_y"))
    got = pairs.join(left.hint("merge"), "x").join(right.hint("merge"), "y")
    kept = [c for c in pairs.columns]

    def run(batches):
        for batch in batches:
            out, deltas = [], []
            for a, b in zip(batch.column("set_x").to_pylist(), batch.column("set_y").to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.sort(np.concatenate([a, b]))
                twice = both[1:] == both[:-1]
                out.append(int(twice.sum()))
                if differences:
                    once = np.ones(len(both), bool)
                    once[1:] &= ~twice
                    once[:-1] &= ~twice
                    deltas.append(both[once].view(np.int64) if 2 * out[-1] >= len(b) else None)
            cols = [*(batch.column(c) for c in kept), pa.array(out, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(deltas, pa.list_(pa.int64()))] * differences, [*kept, "both"] + ["delta"] * differences)

    return got.select(*kept, "set_x", "set_y").mapInArrow(run, plus(pairs.schema, ("both", "long"), *[("delta", "array<long>")] * differences))


def _linked(both, nx, ny, percent: int) -> Column:
    return 100 * both >= percent * (nx + ny - both)


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _need(nx, ny, percent: int) -> Column:
    """The overlap from which on sets of these sizes are linked."""
    return F.ceil(F.lit(percent) * (nx + ny) / F.lit(100 + percent))


def _reach(a: str, b: str, percent: int, ends: tuple = (("n", "n", "pos", "rest", "have"),) * 2) -> Column:
    """Can entries (or blocks) a and b of one list, columns of these prefixes, be of linked sets?

    ends: names of least and largest size, position, rest and what is known of the overlap. Before the
    places of a common token lie no more common ones than the smaller position, after it no more than
    the smaller rest; the others of the overlap are known. An entry's gain is what is known, less its part of the overlap
    needed, times 100 + percent; a block's the largest of its entries, which bounds them closer than its sizes and what is known apart.
    """
    (al, ah, ap, ar, av), (bl, bh, bp, br, bv) = ([F.col(f"{side}.{c}") for c in names] for side, names in zip((a, b), ends, strict=True))
    sizes = (100 * ah >= percent * bl) & (100 * bh >= percent * al)
    ga, gb = (v if names[-1] == "gain1" else _gain(n, v, percent) for n, v, names in zip((al, bl), (av, bv), ends, strict=True))
    return sizes & ((100 + percent) * (F.least(ap, bp) + 1 + F.least(ar, br) - F.col("list.np")) + ga + gb >= 0)


def _gain(n, have, percent: int) -> Column:
    return (100 + percent) * have - percent * n


_BLOCK, _ENTRY = ("n0", "n1", "pos1", "rest1", "gain1"), ("n", "n", "pos", "rest", "have")


def in_blocks(index: DataFrame, percent: int, *carried: str, where: Column | None = None) -> DataFrame:
    """The lists in blocks (list, id, b: bounds, df, entries) of like sizes, positions and knowledge.

    A block's sets have one pivot, and one root (home) if they have found a link; where chooses the
    entries that blocks keep.
    """
    index = index if "free" in index.columns else index.withColumn("free", F.lit(True))
    home = F.when(~F.col("free"), F.col("root")).alias("home")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / min(percent, 99))).alias("band")
    step = F.floor(F.log2(F.col("pos") + 1)).alias("step")
    end = F.floor(F.log2(F.col("rest") + 1)).alias("end")
    lacking = F.col("list.np") / 2 - _gain(F.col("n"), F.col("have"), percent) / (100 + percent)  # of the shared tokens that a pair needs
    more = (F.signum(lacking) * F.floor(2 * F.log2(F.abs(lacking) + 1))).cast("int").alias("more")
    salt = F.pmod(F.xxhash64("key"), F.ceil(F.col("df") / BLOCK_ENTRIES)).alias("salt")
    entry = F.struct("key", "n", "pos", "rest", "have", *carried)
    bounds = F.struct(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max("pos").alias("pos1"), F.max("rest").alias("rest1"), F.max(_gain(F.col("n"), F.col("have"), percent)).alias("gain1")).alias("b")
    kept = index if where is None else index.where(where)
    return kept.groupBy("list", "pivot", home, band, step, end, more, salt).agg(bounds, F.max("df").alias("df"), F.collect_list(entry).alias("entries")).select("list", "pivot", F.struct("band", "step", "end", "more", "salt", "pivot", "home").alias("id"), "b", "df", "entries")


def _plain(index: DataFrame) -> DataFrame:
    """Entries of the plain lists: nothing is known of an overlap beforehand."""
    kind = index.schema["key"].dataType
    none = F.lit(None).cast(kind)
    return index.select(F.struct("token", none.alias("of"), F.lit(0).cast("long").alias("np")).alias("list"), "key", "n", "pos", "rest", F.lit(0).cast("long").alias("have"), "df")


def link_classes(docs: DataFrame, reps: DataFrame, text: str, width: int, percent: int, rounds: int = 1) -> DataFrame:
    """(key, root) for the class representatives that have a link."""
    full, index = _index(docs, reps, text, width, percent)
    plain = _plain(index).withColumn("pivot", F.lit(None).cast(index.schema["key"].dataType))
    compared = labels = None
    for r in range(rounds):
        order = F.col("key") if r == 0 else F.xxhash64(F.lit(r), F.col("key"))
        here = plain.withColumn("root", F.col("key")) if labels is None else _rooted(plain, labels)
        pivot = F.min(F.struct(order.alias("o"), "key", "n", "pos", "rest", "have", "root")).alias("p")
        lists = here.groupBy("list").agg(pivot, F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("list", "p")
        # first every set gets a pivot, linked or not; then only sets without a link seek one
        seekers = in_blocks(here, percent, "root", where=None if r == 0 else F.col("free"))
        block, entry = (F.lit(True), F.lit(True)) if r == 0 else (_reach("p", "b", percent, (_ENTRY, _BLOCK)), _reach("p", "e", percent))
        pairs = seekers.join(lists.hint("merge"), "list").where(block)
        pairs = pairs.select("list", "p", F.explode("entries").alias("e")).where(entry & (F.col("e.root") != F.col("p.root")))
        # the pivot that most of its lists have
        votes = pairs.groupBy(F.col("e.key").alias("x"), F.col("e.n").alias("nx"), F.col("p.key").alias("y"), F.col("p.n").alias("ny")).count()
        chosen = votes.groupBy("x", "nx").agg(F.max_by(F.struct("y", "ny"), F.struct("count", "y")).alias("p")).select("x", "nx", "p.y", "p.ny")
        got = table(_verify(chosen, full, differences=True).withColumn("round", F.lit(r)), "compared")
        if got.isEmpty():
            break
        compared = got if compared is None else compared.union(got)
        labels = table(_labels(_edges(compared, percent)), "labels")
    if compared is None:
        return index.select("key", F.col("key").alias("root")).limit(0)
    known = compared.where("delta IS NOT NULL").groupBy("x").agg(F.max_by(F.struct("y", "nx", "ny", "both", "delta"), F.struct(-F.col("round"), "both")).alias("k")).select(F.col("x").alias("key"), "k.*")
    known = table(known, "differences")
    plain = _plain(index).join(known.select("key", F.col("y").alias("pivot")).hint("merge"), "key", "left")
    lists = plain.unionByName(_difference_lists(known, percent))
    open_ = table(_undecided(_rooted(lists, labels), full, percent, (F.col("x.root") != F.col("y.root"))), "undecided")
    done = compared.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    exact = _edges(_verify(open_.join(done.hint("shuffle_hash"), ["x", "y"], "left_anti"), full), percent)
    return connected(_edges(compared, percent).union(exact)).withColumnRenamed("node", "key")


def _difference_lists(known: DataFrame, percent: int) -> DataFrame:
    """Entries of the differences to a pivot (key, y: its pivot, nx, ny, both, delta).

    Two sets of one pivot share at least need(nx, ny) - (both_x + both_y - ny) differences if linked.
    Over all partners that is at least need(nx, ny) - both_x with the pivot's own size, so a set that
    has no such number of differences in common with any other has no entries.
    """
    rows = known.select("key", "y", "nx", "ny", "both", F.explode("delta").alias("token"))
    often = rows.groupBy("y", "token").agg(F.count("*").alias("df")).where("df > 1")
    rows = rows.join(often.hint("merge"), ["y", "token"])
    by = Window.partitionBy("key")
    rows = rows.withColumns({"pos": F.row_number().over(by.orderBy("df", "token")).cast("long") - 1, "m": F.count("*").over(by)})
    least = F.greatest(F.lit(1), _need(F.col("nx"), F.col("ny"), percent) - F.col("both"))
    rows = rows.where((F.col("m") >= least) & (F.col("pos") <= F.col("m") - least))
    return rows.select(F.struct("token", F.col("y").alias("of"), F.col("ny").alias("np")).alias("list"), "key", F.col("nx").alias("n"), "pos", (F.col("m") - 1 - F.col("pos")).alias("rest"), F.col("both").alias("have"), "df", F.lit(None).cast(known.schema["key"].dataType).alias("pivot"))


def _index(docs: DataFrame, reps: DataFrame, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sets that may have links, and their index entries."""
    wanted = reps.join(candidates(reps, percent).distinct().hint("shuffle_hash"), "key", "left_semi").select("key", "s1")
    full = table(_full(docs, text, width, table(wanted, "candidates")), "sets")
    return full, table(entries(full, percent), "entries")


def _labels(links: DataFrame) -> DataFrame:
    """(key, root) of linked keys: the smallest neighbour, then twice that one's root. Equal roots mean one component."""
    both = links.select("a", "b").union(links.select("b", "a"))
    now = both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("root"))
    for _ in range(2):
        up = now.select(F.col("key").alias("root"), F.col("root").alias("above"))
        now = now.join(up.hint("shuffle_hash"), "root", "left").select("key", F.coalesce("above", "root").alias("root"))
    return now


def _rooted(index: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries with their set's root; free: without a link so far."""
    return index.join(labels.hint("shuffle_hash"), "key", "left").withColumns({"free": F.col("root").isNull(), "root": F.coalesce("root", "key")})


def _edges(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(_linked(F.col("both"), F.col("nx"), F.col("ny"), percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _undecided(index: DataFrame, full: DataFrame, percent: int, differ: Column) -> DataFrame:
    """Pairs (x, nx, y, ny) of a list that differ and may be linked; those of one pivot only where they are in a list of differences to it.

    Blocks are paired, not entries. The block pairs of a long list are dealt over tasks: one side has a
    part by hash, the other goes to all parts.
    """
    mixed = index.groupBy("list").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("list")
    here = index.join(mixed.hint("merge"), "list").join(full.select("key", "sketch").hint("merge"), "key")
    blocks = in_blocks(here, percent, "root", "sketch")
    parts = F.ceil(F.col("df") / (BLOCK_ENTRIES * TASK_BLOCKS))
    a = blocks.select("list", F.pmod(F.xxhash64("id"), parts).alias("part"), F.col("id").alias("ia"), F.col("b").alias("ba"), F.col("entries").alias("ea"))
    b = blocks.select("list", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("id").alias("ib"), F.col("b").alias("bb"), F.col("entries").alias("eb"))
    apart = F.coalesce(F.col("ia.pivot") != F.col("ib.pivot"), F.lit(True)) & F.coalesce(F.col("ia.home") != F.col("ib.home"), F.lit(True))
    pairs = a.join(b.hint("merge"), ["list", "part"]).where((F.col("ia") <= F.col("ib")) & apart & _reach("ba", "bb", percent, (_BLOCK, _BLOCK)))
    pairs = pairs.select("list", "ia", "ib", F.explode("ea").alias("x"), "eb").select("list", "ia", "ib", "x", F.explode("eb").alias("y"))
    nx, ny = F.col("x.n"), F.col("y.n")
    bits = sum((F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    once = F.col("x.key") != F.col("y.key")
    once &= (F.col("ia") != F.col("ib")) | (F.col("x.key") < F.col("y.key"))
    may = once & differ & _reach("x", "y", percent) & (bits <= nx + ny - 2 * _need(nx, ny, percent))
    swap = F.col("x.key") > F.col("y.key")
    first, second = F.when(swap, F.struct("y.key", "y.n")).otherwise(F.struct("x.key", "x.n")), F.when(swap, F.struct("x.key", "x.n")).otherwise(F.struct("y.key", "y.n"))
    return pairs.where(may).select(first.alias("f"), second.alias("s")).select(F.col("f.key").alias("x"), F.col("f.n").alias("nx"), F.col("s.key").alias("y"), F.col("s.n").alias("ny")).distinct()


def _classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All rows' sets; those that stand for the keys; the classes of equal sets with their representative; its first tokens."""
    own = table(sets(docs, "text", width, percent), "signatures")
    one = own.where("key IS NOT NULL AND n > 0").groupBy("key").agg(F.min(F.struct("n", "s1", "s2")).alias("c")).select("key", "c.*")
    classes = table(one.groupBy("n", "s1", "s2").agg(F.min("key").alias("key"), F.count("*").alias("members")), "classes")
    reps = own.join(classes.hint("shuffle_hash"), ["key", "n", "s1", "s2"], "left_semi").dropDuplicates(["key", "n", "s1", "s2"])
    return own, one, classes, table(reps.select("key", "n", "s1", "first"), "representatives")


def components(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 4, percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id) of every row of docs.

    Sets of width-word shingles link when 100 * intersection >= percent * union; component_id is the
    smallest key reachable. Null and wordless texts have no shingle and are linked with nothing. Rows of
    equal keys count as one document, whose text for the links is the one of the fewest shingles (ties:
    by their hashes). Rows without a key get their text's component and never give it its name, unless
    no row of that text has a key. Other columns are left out.
    """
    kind = docs.schema[key].dataType
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    own, one, classes, reps = _classes(docs, width, percent)
    labels = link_classes(docs, reps, "text", width, percent)
    of = table(classes.join(labels.hint("shuffle_hash"), "key", "left").select("n", "s1", "s2", F.coalesce("root", "key").alias("component"), "members"), "components")
    total = own.count()
    hot = of.where(F.col("members") >= max(1000, total // 1000)).select("n", "s1", "s2")
    chosen = join_hot(one, of.drop("members"), ["n", "s1", "s2"], hot, total).select("key", "component")
    keyed = own.where("key IS NOT NULL").select("key", "n").join(chosen.hint("shuffle_hash"), "key", "left")
    nameless = own.where("key IS NULL").join(of.drop("members").hint("merge"), ["n", "s1", "s2"], "left").select("key", "n", "component")
    return keyed.union(nameless).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").cast(kind).alias("component_id"))


def links(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, as pairs (x, y) of class representatives, x < y, and the membership (key, representative).

    The rules for nulls, empty texts and repeated keys are those of components; rows without a key are left out.
    """
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    _, one, classes, reps = _classes(docs, width, percent)
    full, index = _index(docs, reps, "text", width, percent)
    plain = _plain(index).withColumns({"pivot": F.lit(None).cast(index.schema["key"].dataType), "root": F.col("key")})
    got = _edges(_verify(table(_undecided(plain, full, percent, F.lit(True)), "undecided"), full), percent).select(F.col("a").alias("x"), F.col("b").alias("y"))
    total = docs.count()
    hot = classes.where(F.col("members") >= max(1000, total // 1000)).select("n", "s1", "s2")
    members = join_hot(one, classes.select("n", "s1", "s2", F.col("key").alias("representative")), ["n", "s1", "s2"], hot, total)
    return got, members.select(F.col("key").alias(key), "representative")
