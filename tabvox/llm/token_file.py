"""Token ids in files of directly addressable codes.

An id is split into chunks of `bits` bits, lowest first. Level k holds chunk k of all ids that have
one, and a bitmap of which of them go on to level k + 1; a rank directory (set bits before each
64-byte line of the bitmap) tells where. So any token is read by itself: one byte of each level and a
rank, no block is decoded.

The file: a Parquet table in which each row is a segment of whole documents with its levels as binary
columns, in ascending order of the key over parts and segments. Spark writes and reads it, so it may
lie in any store that Spark reaches.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvox.llm import pretokens
from tabvox.llm.textbytes import chunks, gather, owner, plus, shared_dir

LINE = 512  # bits of a bitmap for each entry of its rank directory
SEGMENT = 1 << 19  # a segment closes after so many ids


def pack(ids: np.ndarray, bits: int = 8) -> list[tuple[bytes, bytes, bytes]]:
    """Levels of (chunks, bitmap of continuations, rank directory); bits up to 8."""
    out, rest = [], ids.astype(np.uint64)
    while len(rest):
        chunk = (rest & np.uint64((1 << bits) - 1)).astype(np.uint8)
        rest = rest >> np.uint64(bits)
        more = rest > 0
        bitmap = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), LINE), dtype=np.int64))])
        out.append((chunk.tobytes(), bitmap.tobytes(), ranks[:-1].astype("<u4").tobytes()))
        rest = rest[more]
    return out


_ONES = np.array([bin(x).count("1") for x in range(256)], np.int64)


class Codes:
    """Packed ids."""

    def __init__(self, levels, n: int, bits: int = 8):
        self.n, self.bits = n, bits
        self.levels = [(np.frombuffer(c, np.uint8), np.frombuffer(b, np.uint8), np.frombuffer(r, "<u4")) for c, b, r in levels]

    def at(self, positions: np.ndarray) -> np.ndarray:
        """The ids at positions: for each level one byte and one rank."""
        at = np.asarray(positions, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("position outside the codes")
        out, who = np.zeros(len(at), np.uint64), np.arange(len(at))
        for k, (chunk, bitmap, ranks) in enumerate(self.levels):
            if not len(at):
                break
            out[who] |= chunk[at].astype(np.uint64) << np.uint64(k * self.bits)
            go = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            at, who = at[go], who[go]
            line = at // LINE
            before = ranks[line].astype(np.int64)
            for j in range(LINE // 8):  # whole bytes of the line before the bit
                byte = line * (LINE // 8) + j
                inside = byte < (at >> 3)
                if not inside.any():
                    break
                before[inside] += _ONES[bitmap[byte[inside]]]
            at = before + _ONES[bitmap[at >> 3] & ((1 << (at & 7)) - 1)]
        return out.astype(np.int64)

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out, who = np.zeros(self.n, np.uint64), np.arange(self.n)
        for k, (chunk, bitmap, _) in enumerate(self.levels):
            out[who] |= chunk.astype(np.uint64) << np.uint64(k * self.bits)
            who = who[np.unpackbits(bitmap, count=len(chunk), bitorder="little").astype(bool)]
        return out.astype(np.int64)


_LEVELS = "array<struct<chunks:binary,bitmap:binary,ranks:binary>>"
_LEVEL_ARROW = pa.list_(pa.struct([("chunks", pa.binary()), ("bitmap", pa.binary()), ("ranks", pa.binary())]))
_WORKER: dict[str, tuple[pretokens.Memory, list[bytes]]] = {}


def library_memory(path: str) -> tuple[pretokens.Memory, list[bytes]]:
    """Ids of pieces by the tokenizers library, one for each Python worker, and its added tokens.

    The tokenizer splits by the pattern of pretokens before it merges, and a piece alone is split
    into itself, so a text's ids are those of its pieces. Not so in the texts of apart().
    """
    if path not in _WORKER:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = [x.content.encode() for x in tokenizer.get_added_tokens_decoder().values() if x.content]

        line = tokenizer.encode("\n", add_special_tokens=False).ids
        lines_apart = len(line) == 1 and tokenizer.encode("a\n b\n", add_special_tokens=False).ids == sum((tokenizer.encode(x, add_special_tokens=False).ids for x in ("a", "\n", " b", "\n")), [])

        def each(texts):
            return [np.array(x.ids, np.uint32).tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        def encode(buf, start, end):
            """The ids of each range of buf as bytes. Pieces without white space but for one blank before them go in one text, a line each, as the library splits at the ends of lines."""
            raw = buf.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            joined = [i for i, x in enumerate(texts) if len(x) < 64 and x.removeprefix(" ").split() == [x.removeprefix(" ")]] if lines_apart else []
            if len(joined) < 2:
                return each(texts)
            out = [b""] * len(texts)
            ids = np.array(tokenizer.encode_batch_fast(["\n".join([*(texts[i] for i in joined), ""])], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == line[0])
            own, at = ids.tobytes(), 0
            for i, stop in zip(joined, (cut * 4).tolist(), strict=True):
                out[i] = own[at:stop]
                at = stop + 4
            rest = sorted(set(range(len(texts))).difference(joined))
            for i, x in zip(rest, each([texts[i] for i in rest]), strict=True):
                out[i] = x
            return out

        _WORKER.clear()
        _WORKER[path] = pretokens.Memory(encode), added
    return _WORKER[path]


def apart(buf: np.ndarray, off: np.ndarray, added: list[bytes]) -> np.ndarray:
    """The texts that the library must split itself: those with an added token, or a character that pretokens can't class."""
    raw, out = buf.tobytes(), pretokens.unknown(buf, off).tolist()
    for token in added:
        at = raw.find(token)
        while at >= 0:
            i = int(np.searchsorted(off, at, "right")) - 1
            inside = at + len(token) <= off[i + 1]
            out += [i] if inside else []
            at = raw.find(token, int(off[i + 1]) if inside else at + 1)
    return np.unique(np.array(out, np.int64))


def write(docs: DataFrame, to: str, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id", bits: int = 8, parts: int | None = None) -> None:
    """Encode every whole text (null: empty) as the library does at its default settings, append end_id to each, and write the file.

    Documents go out in ascending order of key (nulls first; equal keys side by side): the ranges of
    key are the parts. tokenizer is the path of a tokenizer file on every machine.
    """
    kind = docs.schema[key].dataType
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    docs = docs.repartitionByRange(parts, "key") if parts else docs.repartitionByRange("key")
    docs = docs.sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
    schema = plus(T.StructType([]), ("part", "int"), ("seq", "int"), ("before", "long"), ("n", "long"), ("bits", "int"), ("levels", _LEVELS), ("starts", "array<long>"))
    schema = T.StructType([*schema.fields, T.StructField("keys", T.ArrayType(kind))])

    def run(batches):
        (memory, added), part, seq, before = library_memory(tokenizer), None, 0, 0
        held, keys, starts, n = [], [], [0], 0

        def row():
            flat = np.concatenate(held)
            levels = [{"chunks": c, "bitmap": b, "ranks": r} for c, b, r in pack(flat, bits)]
            key_column = pa.concat_arrays(keys)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before]), pa.array([n]), pa.array([bits], pa.int32()), pa.array([levels], _LEVEL_ARROW), pa.array([starts], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(key_column)], pa.int32()), key_column)],
                schema.names,
            )

        for batch, buf, off in chunks(batches):
            start, end, ranges = pretokens.split(buf, off)
            alone = apart(buf, off, added)
            if len(alone):
                keep = ~np.isin(owner(ranges), alone)
                start, end, ranges = start[keep], end[keep], np.concatenate([[0], np.cumsum(keep)])[ranges]
            ids, begin, number = memory.ids(buf, start, end)
            size = np.diff(begin)[number]
            at = np.concatenate([[0], np.cumsum(size)])[ranges]
            own = gather(ids, begin[:-1][number], size).astype(np.int64)
            if len(alone):
                made = [np.frombuffer(x, np.uint32) for x in memory.encode(buf, off[alone], off[alone + 1])]
                more = np.zeros(len(at), np.int64)
                more[alone + 1] = [len(x) for x in made]
                own = np.insert(own, np.repeat(at[alone], more[alone + 1]), np.concatenate(made))
                at = at + np.cumsum(more)
            own = np.insert(own, at[1:], end_id)
            part = batch.column("part")[0].as_py()
            held.append(own)
            keys.append(batch.column("key"))
            starts += (n + at[1:] + np.arange(1, len(at))).tolist()
            n += len(own)
            if n >= SEGMENT:
                yield row()
                held, keys, starts, seq, before, n = [], [], [0], seq + 1, before + n, 0
        if keys:
            yield row()

    docs.mapInArrow(run, schema).write.parquet(to)


def segments(spark, path: str) -> DataFrame:
    """The rows of a file with start, the ids before each segment: the sums of the parts before it are few and broadcast."""
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one number for each part
    before, sums_ = 0, []
    for part, n in totals:
        sums_.append((part, before))
        before += n
    base = spark.createDataFrame(sums_, "part int, base long")
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("before"))


def read(spark, path: str) -> DataFrame:
    """(key, start, ids) of every document."""
    rows = segments(spark, path).select("start", "n", "bits", "levels", "starts", "keys")
    kind = rows.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField("key", kind), *plus(T.StructType([]), ("start", "long"), ("ids", "array<int>")).fields])

    def run(batches):
        for keys, start, ids, begin in _documents(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array(start), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))], schema.names)

    return rows.mapInArrow(run, schema)


def read_digests(spark, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, as read from the file."""
    rows = segments(spark, path).select("start", "n", "bits", "levels", "starts", "keys")
    kind = rows.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField("key", kind), *plus(T.StructType([]), ("start", "long"), ("n_tokens", "long"), ("ids_crc32", "long")).fields])

    def run(batches):
        for keys, start, ids, begin in _documents(batches):
            raw, at = ids.astype("<u4").tobytes(), (begin * 4).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(start), pa.array(np.diff(begin)), pa.array(crc, pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def _documents(batches):
    """Keys, starts, ids and where each document's ids begin, of one segment after the other."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            get = lambda name: row.column(name)[0]  # noqa: E731, B023
            levels = [(x["chunks"], x["bitmap"], x["ranks"]) for x in get("levels").as_py()]
            begin = np.asarray(get("starts").values.to_numpy(), np.int64)
            yield get("keys").values, get("start").as_py() + begin[:-1], Codes(levels, get("n").as_py(), get("bits").as_py()).all(), begin


def tokens_at(spark, path: str, positions: DataFrame) -> DataFrame:
    """The ids at positions (column position, counted over the whole file): (position, id).

    Each position is joined with its segment by range over the sorted starts, whose number is that of
    the segments; only the segments asked for are read through, and in them only the tokens asked for.
    Positions outside the file or null give no row; repeated ones give one row each.
    """
    rows = segments(spark, path)
    where = rows.select("part", "seq", "start", (F.col("start") + F.col("n")).alias("stop"))
    step = F.lit(SEGMENT)
    cells = where.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("stop") - 1) / step))))
    asked = positions.select(F.col("position").cast("long")).withColumn("cell", F.floor(F.col("position") / step))
    found = asked.join(cells.hint("shuffle_hash"), "cell").where("position >= start AND position < stop").groupBy("part", "seq").agg(F.collect_list("position").alias("positions"))
    own = rows.join(found.hint("shuffle_hash"), ["part", "seq"]).select("start", "n", "bits", "levels", "positions")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = np.array(row["positions"], np.int64)
                ids = Codes([(x["chunks"], x["bitmap"], x["ranks"]) for x in row["levels"]], row["n"], row["bits"]).at(at - row["start"])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids)], ["position", "id"])

    return own.mapInArrow(run, "position long, id long")


def new_path(spark) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tabvox/tokens-{uuid.uuid4().hex}"
