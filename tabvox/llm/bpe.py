"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has exactly one encoding, and so one last token: the token t ending there
whose predecessor, the last token of the prefix before t, may stand next to it. Storing that token for
each prefix gives the ids by walking back, lets bytes be appended exactly, and after an edit only the
prefixes near it are worked out again. `Vocabulary` does this for many pieces at once with numpy;
`Prefixes` for one piece that grows and changes.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvox.llm import pretokens
from tabvox.llm.textbytes import Hasher, chunks, gather, hash_bytes, plus

LONGEST_TOGETHER = 40  # longer pieces go through Prefixes
_NEVER = np.int64(1 << 40)


def read_ranks(path: str) -> list[bytes]:
    """Bytes of each id from a file of `base64 rank` lines."""
    rows = [line.split() for line in open(path, "rb") if line.strip()]
    out = [b""] * (1 + max(int(r) for _, r in rows))
    for token, rank in rows:
        out[int(rank)] = base64.b64decode(token)
    return out


def _halves(tokens: list[bytes]) -> np.ndarray:
    """For each token the two tokens that its last merge joins; a single byte has itself twice."""
    rank = {t: i for i, t in enumerate(tokens)}
    out = np.zeros((len(tokens), 2), np.int64)
    for i, t in enumerate(tokens):
        parts = [t[j : j + 1] for j in range(len(t))]
        while len(parts) > 2:
            best = min((rank.get(parts[j] + parts[j + 1], len(tokens)), j) for j in range(len(parts) - 1))
            if best[0] >= i:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        out[i] = [rank[parts[0]], rank[parts[1]]] if len(parts) == 2 else [i, i]
    return out


class _Table:
    """A hash table of 64-bit keys for arrays of lookups."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)
        for k, v in zip(keys.tolist(), values.tolist(), strict=True):
            at = k >> (64 - bits)
            while self.values[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = k, v

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where absent."""
        at = (keys >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.values[at] >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            value, same = self.values[at], self.keys[at] == keys[open_]
            out[open_[same]] = value[same]
            go = ~same & (value >= 0)
            open_, at = open_[go], at[go]
        return out


def _spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """The tokens with what validity and lookup need. halves may be given, to save working them out."""

    def __init__(self, tokens: list[bytes], halves: np.ndarray | None = None):
        self.tokens = tokens
        self.halves = _halves(tokens) if halves is None else halves
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.longest = max(map(len, tokens))
        self.sizes = np.array([len(t) for t in tokens])
        self.by_hash = _Table(hash_bytes([t for t in tokens if t], folded=False), np.array([i for i, t in enumerate(tokens) if t]))
        merged = np.flatnonzero((self.halves[:, 0] != np.arange(len(tokens))) & (self.sizes > 1))
        self.pairs = _Table(_spread(self.halves[merged, 0], self.halves[merged, 1]), merged)
        self.seen_key, self.seen_value = np.zeros(1 << 20, np.uint64), np.zeros(1 << 20, bool)
        flat = b"".join(tokens)
        self.flat, self.begin = np.frombuffer(flat, np.uint8), np.concatenate([[0], np.cumsum(self.sizes)])
        text = [b" %d" % i for i in range(len(tokens))]
        self.digits = np.frombuffer(b"".join(x.ljust(8) for x in text), np.uint8).reshape(-1, 8)
        self.n_digits = np.array([len(x) for x in text])
        self.prefix_ids = {}

    def valid(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """May right follow left in an encoding: would no merge across their border come first?

        The border is followed down to its bytes, undoing the later of the two merges beside it
        each time; a merge that would join both sides before the part undone last was made rules
        the pair out.
        """
        ok = np.ones(len(left), bool)
        at, a, b = np.arange(len(left)), left.copy(), right.copy()
        limit = np.full(len(left), _NEVER)
        while len(at):
            joined = self.pairs(_spread(a, b))
            out = (joined >= 0) & (joined < limit)
            ok[at[out]] = False
            at, a, b, limit = at[~out], a[~out], b[~out], limit[~out]
            if not len(at):
                break
            whole_a, whole_b = self.sizes[a] == 1, self.sizes[b] == 1
            undo_a = ((a > b) | whole_b) & ~whole_a
            undo_b = ~undo_a & ~whole_b
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, self.halves[a, 1], a), np.where(undo_b, self.halves[b, 0], b)
            go = undo_a | undo_b
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return ok

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """valid, remembering pairs."""
        key = _spread(left, right) | np.uint64(1)
        at = (key >> np.uint64(44)).astype(np.int64)
        miss = np.flatnonzero(self.seen_key[at] != key)
        out = self.seen_value[at]
        if len(miss):
            value = self.valid(left[miss], right[miss])
            out[miss] = value
            self.seen_key[at[miss]], self.seen_value[at[miss]] = key[miss], value
        return out

    def encode(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit numbers."""
        size = end - start
        out: list[bytes] = [b""] * len(size)
        for i in np.flatnonzero(size > LONGEST_TOGETHER):
            out[i] = np.array(Prefixes(self).append(buf[start[i] : end[i]].tobytes()).ids(), np.uint32).tobytes()
        short = np.flatnonzero(size <= LONGEST_TOGETHER)
        if not len(short):
            return out
        short = short[np.argsort(-size[short], kind="stable")]
        size = size[short]
        data = gather(buf, start[short], size)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        h = Hasher(data, folded=False)
        last: list[np.ndarray] = [np.zeros(0, np.int64)]  # the last token of each piece's prefix of i bytes
        n_at = [len(size), *((size >= i).sum() for i in range(1, int(size[0]) + 1))]
        order = [2, 3, 1, 4, 5, 6, 7, 8]
        for i in range(1, int(size[0]) + 1):
            m = n_at[i]
            found = np.full(m, -1, np.int64)
            open_ = np.arange(m)
            for k in [*(x for x in order if x <= i), *range(9, min(i, self.longest) + 1)]:
                if not len(open_):
                    break
                token = self.by_hash(h(begin[open_] + (i - k), begin[open_] + i))
                some = np.flatnonzero(token >= 0)
                if k < i and len(some):
                    some = some[self.may_follow(last[i - k][open_[some]], token[some])]
                found[open_[some]] = token[some]
                keep = np.ones(len(open_), bool)
                keep[some] = False
                open_ = open_[keep]
            if len(open_):
                raise ValueError("a byte of the text is not in the vocabulary")
            last.append(found)
        # walk back from the end of all pieces at once
        table = np.concatenate(last)
        base = np.concatenate([[0], np.cumsum([len(x) for x in last])])
        at, item, steps = size.copy(), np.arange(len(size)), []
        while len(item):
            token = table[base[at] + item]
            steps.append((item, token))
            at = at - self.sizes[token]
            go = at > 0
            at, item = at[go], item[go]
        item, token = np.concatenate([x for x, _ in steps]), np.concatenate([x for _, x in steps])
        rank = np.repeat(np.arange(len(steps)), [len(x) for x, _ in steps])
        order_ = np.lexsort((-rank, item))
        raw, count = token[order_].astype(np.uint32).tobytes(), np.bincount(item, minlength=len(size))
        stop = 0
        for i, n in zip(short.tolist(), count.tolist(), strict=True):
            out[i] = raw[stop : stop + 4 * n]
            stop += 4 * n
        return out

    def decimals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids as decimal numbers, a space before each, and where each begins."""
        n = self.n_digits[ids]
        return self.digits[ids][np.arange(8) < n[:, None]], np.concatenate([[0], np.cumsum(n)])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids and where each id's begin."""
        n = self.sizes[ids]
        return gather(self.flat, self.begin[ids], n), np.concatenate([[0], np.cumsum(n)])


class Prefixes:
    """One piece of text: the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.data, self.last = vocabulary, bytearray(), [-1]

    def _valid(self, left: int, right: int) -> bool:
        known = self.v.prefix_ids
        if (left, right) not in known:
            if len(known) > 200_000:
                known.clear()
            known[left, right] = bool(self.v.valid(np.array([left]), np.array([right]))[0])
        return known[left, right]

    def _last(self, i: int) -> int:
        for k in range(1, min(i, self.v.longest) + 1):
            token = self.v.rank.get(bytes(self.data[i - k : i]))
            if token is not None and (k == i or self._valid(self.last[i - k], token)):
                return token
        raise ValueError("a byte of the text is not in the vocabulary")

    def append(self, more: bytes) -> Prefixes:
        """Add bytes at the end; earlier prefixes keep their tokens."""
        for b in more:
            self.data.append(b)
            self.last.append(self._last(len(self.data)))
        return self

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Replace bytes and return how many prefixes were worked out again.

        Past the edit the work stops once as many tokens in a row as the longest token has bytes
        are those of before: from there on nothing can differ.
        """
        tail, old = bytes(self.data[at + removed :]), self.last[at + removed + 1 :]
        del self.data[at:], self.last[at + 1 :]
        self.append(inserted)
        same = 0
        for j, b in enumerate(tail):
            self.append(bytes([b]))
            same = same + 1 if self.last[-1] == old[j] else 0
            if same >= self.v.longest:
                self.data += tail[j + 1 :]
                self.last += old[j + 1 :]
                return len(inserted) + j + 1
        return len(inserted) + len(tail)

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= len(self.v.tokens[self.last[i]])
        return out[::-1]


_WORKER: dict[int, tuple] = {}


def _worker(shared) -> tuple[Vocabulary, pretokens.Memory]:
    if shared.value[2] not in _WORKER:
        _WORKER.clear()
        vocabulary = Vocabulary(shared.value[0], shared.value[1])
        _WORKER[shared.value[2]] = vocabulary, pretokens.Memory(vocabulary.encode)
    return _WORKER[shared.value[2]]


def share_vocabulary(spark, path: str):
    """Broadcast the vocabulary of a rank file: its size is that of the file, whatever the texts."""
    tokens = read_ranks(path)
    return spark.sparkContext.broadcast((tokens, _halves(tokens), hashlib.sha256(b"\0".join(tokens)).hexdigest()))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ids (array of int) to docs, each text encoded by itself without special tokens; null: empty."""
    shared, docs = share_vocabulary(docs.sparkSession, path), docs.drop("ids")
    schema = plus(docs.schema, ("ids", "array<int>"))

    def run(batches):
        _, memory = _worker(shared)
        for part, buf, off in chunks(batches, text):
            ids, begin = _encode(memory, buf, off)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids.astype(np.int32)))], [*part.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add decoded (binary) to rows: the bytes of an array of ids; null: null."""
    shared, rows = share_vocabulary(rows.sparkSession, path), rows.drop("decoded")

    def run(batches):
        vocabulary, _ = _worker(shared)
        for part in batches:
            column = part.column(part.schema.get_field_index(ids))
            made = [None if x is None else vocabulary.decode(np.array(x, np.int64))[0].tobytes() for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], [*part.schema.names, "decoded"])

    return rows.mapInArrow(run, plus(rows.schema, ("decoded", "binary")))


def _encode(memory: pretokens.Memory, buf, off) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts and where each text's begin."""
    start, end, ranges = pretokens.split(buf, off)
    ids, begin, number = memory.ids(buf, start, end)
    size = np.diff(begin)[number]
    return gather(ids, begin[:-1][number], size), np.concatenate([[0], np.cumsum(size)])[ranges]


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Replace text by n_tokens, ids_sha256 and decoded_sha256 of encoding it and decoding the ids.

    The same as encode and decode, without moving the ids out of the task. Null texts count as
    empty; columns of docs by these names are replaced, all others stay.
    """
    made = ["n_tokens", "ids_sha256", "decoded_sha256"]
    shared, docs = share_vocabulary(docs.sparkSession, path), docs.drop(*made)
    rest = [c for c in docs.columns if c != text]
    schema = plus(docs.select(*[F.col(f"`{c}`") for c in rest]).schema, ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"))

    def run(batches):
        vocabulary, memory = _worker(shared)
        for part, buf, off in chunks(batches, text):
            ids, begin = _encode(memory, buf, off)
            sha = []
            for flat, at, skip in ((*vocabulary.decimals(ids), 1), (*vocabulary.decode(ids), 0)):
                flat, at = flat.tobytes(), at[begin].tolist()
                sha.append([hashlib.sha256(flat[min(a + skip, b) : b]).hexdigest() for a, b in zip(at, at[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in rest), pa.array(np.diff(begin)), *map(pa.array, sha)], [*rest, *made])

    return docs.mapInArrow(run, schema)
