"""Whole texts of an Arrow batch as one byte array: words, hashes and windows with numpy.

Spark partitions, shuffles and stores; these helpers only do the arithmetic inside a task.
A word is a run of bytes other than space and 0x09-0x0D; hashes fold A-Z to a-z unless asked
otherwise. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20  # bytes of text that one round of numpy works on
U = np.uint64

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


@functools.cache
def _letters(folded: bool) -> np.ndarray:
    """A random 64-bit number for each byte."""
    table = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
    return table[FOLD] if folded else table


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Hasher:
    """Hashes of any byte range of buf, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, buf: np.ndarray, folded: bool = True):
        up, self.down = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, U)
        np.cumsum(_letters(folded)[buf] * up[: len(buf)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(U))


def hash_bytes(items: list[bytes], folded: bool = True) -> np.ndarray:
    """The hash that Hasher gives for each of items."""
    buf = np.frombuffer(b"".join(items), np.uint8)
    ends = np.cumsum([len(x) for x in items], dtype=np.int64) if items else np.zeros(0, np.int64)
    return Hasher(buf, folded)(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if items else np.zeros(0, U)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and len + 1 offsets into them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(batches, column: str = "text", limit: int = CHUNK):
    """Yield (part of a batch, buf, off) with about limit bytes of text, or one longer text."""
    for batch in batches:
        buf, off = as_bytes(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < len(off) - 1:
            last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), buf[off[first] : off[last]], off[first : last + 1] - off[first]
            first = last


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text its range of words (len + 1 offsets)."""
    return spans(~_WHITE[buf], off)


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of inside, cut at the ends of texts."""
    n = len(inside)
    opens, closes = inside.copy(), inside.copy()
    if n:
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edge = off[(off > 0) & (off < n)]
        opens[edge] = inside[edge]
        closes[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1, np.searchsorted(start, off)


def unique(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    out = np.sort(values)
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    return out[keep]


def owner(ranges: np.ndarray) -> np.ndarray:
    """For each item the number of the range that it lies in."""
    return np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[starts[0]:starts[0]+counts[0]], values[starts[1]:...] and so on, in one array."""
    return values[ranges_of(starts, counts)]


def ranges_of(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] numbers), then those from starts[1], and so on."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def sums(values: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """Sum of each range of values; 0 for an empty one."""
    out = np.zeros(len(ranges) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(ranges))
    if len(full):
        out[full] = np.add.reduceat(values, ranges[full], dtype=out.dtype)
    return out


#: Case-folded letters, other ASCII bytes as spaces, bytes of longer characters as they are.
_PLAIN = np.where(np.arange(256) < 128, 32, np.arange(256)).astype(np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)


def letters_only(buf: np.ndarray) -> np.ndarray:
    """buf with ASCII and Latin-1 letters in lower case and all other ASCII as spaces."""
    out = _PLAIN[buf]
    upper = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
    out[upper] += 32
    return out


#: As _PLAIN, with digits kept.
_WORDS = _PLAIN.copy()
_WORDS[48:58] = np.arange(48, 58)


@functools.cache
def _lower_pairs() -> np.ndarray:
    """Of each character of two UTF-8 bytes the lower-case one, if that has two bytes too; by the ten bits above ASCII's seven."""
    lower = [chr(c).lower() for c in range(0x800)]
    return np.array([ord(x) if len(x) == 1 and 0x80 <= ord(x) < 0x800 else c for c, x in enumerate(lower)], np.uint16)


def letters_and_digits(buf: np.ndarray) -> np.ndarray:
    """buf with ASCII letters and those of two bytes (Latin, Greek, Cyrillic, Armenian ...) in lower case, digits, and all other ASCII as spaces."""
    out = _WORDS[buf]
    at = np.flatnonzero((buf[:-1] >= 0xC2) & (buf[:-1] < 0xE0))
    if len(at):
        code = _lower_pairs()[((buf[at] & 0x1F).astype(np.int64) << 6) | (buf[at + 1] & 0x3F)]
        out[at], out[at + 1] = 0xC0 | (code >> 6), 0x80 | (code & 0x3F)
    return out


# ---- Spark helpers ----


def shared_dir(spark) -> str:
    """The folder of spark.checkpoint.dir, or of SparkContext.setCheckpointDir.

    Where neither is set, a session in local mode (tests) gets a folder of its own; on a cluster
    executors couldn't share one, so that is an error.
    """
    context = spark.sparkContext
    conf = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not conf:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        conf = tempfile.mkdtemp(prefix="tabvox-")
        context.setCheckpointDir(conf)
    return conf


def release() -> None:
    """Give memory that this process has freed back to the system.

    Models are fitted in the driver from bounded samples, as many small arrays; what they leave would
    else stay with the allocators beside the JVM until the session ends.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None  # glibc has it
    if trim:
        trim(0)


def table(df, name: str):
    """Write df into the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    release()
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tabvox/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Up to so many rows, one task may take all rows of a key.
ONE_TASK = 1_000_000


def join_hot(rows, small, on: list[str], hot, total: int):
    """rows (total of them) LEFT JOIN small on columns on; small has one row a key.

    hot: keys that hold a thousandth of rows or more, so there are a thousand at most. If rows are too
    many for one task, hot keys' rows of small are broadcast and all others joined by shuffle, so no
    key's rows are gathered in one task.
    """
    from pyspark.sql import functions as F

    if total <= ONE_TASK:
        return rows.join(small.hint("shuffle_hash"), on, "left")
    tagged = rows.join(F.broadcast(hot.withColumn("hot_", F.lit(True))), on, "left")
    few = small.join(F.broadcast(hot), on, "left_semi")
    rare = tagged.where("hot_ IS NULL").drop("hot_").join(small.hint("shuffle_hash"), on, "left")
    return rare.unionByName(tagged.where("hot_").drop("hot_").join(F.broadcast(few), on, "left"))


def plus(schema, *columns: tuple[str, str]):
    """A copy of schema with columns of the given names and types added."""
    from pyspark.sql import types as T

    return T.StructType([*schema.fields, *T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in columns)).fields])


def fold(column, n: int):
    """crc32 of the column as text, modulo n; -1 for null."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % n, F.lit(-1))


def share(column, rate, seed: int = 11):
    """True for about rate of the rows, by a hash of column: the same rows each time."""
    from pyspark.sql import functions as F

    return (F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 20)) / F.lit(float(1 << 20))) < rate
