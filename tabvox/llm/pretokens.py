"""Split whole texts into the pieces that byte-level BPE merges within, with numpy.

The pieces are the matches of the public pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
found from the classes of neighbouring characters instead of by a regular expression. Each distinct
piece of a chunk is encoded once.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from tabvox.llm.textbytes import Hasher

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# fixed values: characters with the Unicode property White_Space
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point, and whether Python's Unicode has no character there."""
    kinds, names = {"L": LETTER, "N": NUMBER}, [unicodedata.category(chr(i)) for i in range(0x110000)]
    out = np.fromiter((kinds.get(x[0], OTHER) for x in names), np.uint8, len(names))
    out[list(WHITE_SPACE)] = SPACE
    return out, np.fromiter((x == "Cn" for x in names), bool, len(names))


def unknown(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The texts with a character that Python's Unicode doesn't have: a library of later Unicode may class it as a letter or number."""
    at, cp = code_points(buf, np.flatnonzero(buf >= 0xC0))
    return np.unique(np.searchsorted(off, at[_classes()[1][cp]], "right") - 1)


def code_points(buf: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of UTF-8 bytes starts (or those that start at `at`), and its code point."""
    at = np.flatnonzero((buf & 0xC0) != 0x80) if at is None else at
    lead = buf[at].astype(np.int32)
    if len(at) == len(buf):
        return at, lead
    padded = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int32)
    out = lead.copy()
    for least, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        pick = np.flatnonzero((lead >= least) & (lead < {1: 0xE0, 2: 0xF0, 3: 0x100}[more]))
        value = lead[pick] & mask
        for j in range(1, more + 1):
            value = (value << 6) | (padded[at[pick] + j] & 0x3F)
        out[pick] = value
    return at, out


def split(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all pieces and for each text its range of pieces."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    at, cp = code_points(buf)
    kind = _classes()[0][cp]
    m = len(at)
    first = np.zeros(m + 3, bool)  # first character of a text; also just after the last one
    begin = np.searchsorted(at, off)
    first[begin] = True
    first[m:] = True
    run = first[:m].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = cp == 32
    after_blank = np.zeros(m, bool)
    after_blank[1:] = blank[:-1] & ~first[1:m]
    space = kind == SPACE
    # what follows one blank starts with it; white space splits off its last character when text follows
    opens = run & ~(after_blank & ~space)
    last = np.zeros(m, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:m]
    opens |= last
    # 's 't 'm 'd 're 've 'll where the apostrophe starts a piece
    mark = np.flatnonzero((cp == 39) & opens)
    c = np.concatenate([cp, np.zeros(3, np.int32)])
    one = mark[~first[mark + 1] & np.isin(c[mark + 1], (115, 116, 109, 100))]
    two = mark[~first[mark + 1] & ~first[mark + 2]]
    pair = c[two + 1] * 65536 + c[two + 2]
    two = two[np.isin(pair, (114 * 65536 + 101, 118 * 65536 + 101, 108 * 65536 + 108))]
    more = np.zeros(m + 4, bool)
    for where, size in ((one, 2), (two, 3)):
        opens[where + 1] = False
        more[where + size] = True
    opens |= more[:m]
    start = at[opens]
    ranges = np.searchsorted(start, off)
    end = np.append(start[1:], n)
    return start, end, ranges


def distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct pieces, one occurrence of each, and for each piece its number."""
    return np.unique(Hasher(buf, folded=False)(start, end), return_index=True, return_inverse=True)


class Memory:
    """Ids of pieces seen by this Python worker, by hash; emptied when full."""

    def __init__(self, encode, most: int = 300_000):
        self.encode, self.most, self.known = encode, most, {}

    def ids(self, buf, start, end) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct pieces in one array, where each begins (len + 1), and each piece's number."""
        name, at, inverse = distinct(buf, start, end)
        names = name.tolist()
        got = [self.known.get(x) for x in names]
        new = [i for i, x in enumerate(got) if x is None]
        if new:
            where = at[new]
            made = self.encode(buf, start[where], end[where])
            for i, x in zip(new, made, strict=True):
                got[i] = x
            if len(self.known) + len(new) > self.most:
                self.known.clear()
            self.known.update((names[i], got[i]) for i in new)
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        return np.frombuffer(b"".join(got), np.uint32), np.concatenate([[0], np.cumsum(size)]), inverse
