"""Quality rules: a decision list learned by sequential covering, applied as a Spark expression.

`statistics` counts per text; `learn` grows conjunctions of thresholds on the ratios of labelled rows
(FOIL gain), prunes them on rows kept apart, and keeps those that stay precise; `verdict` emits the
list, in order, as one CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvox.llm.textbytes import Hasher, chunks, mix, owner, plus, share, spans, sums, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_bangs", "n_pipes", "n_longest", "n_distinct")
WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _flags(of) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_SETS = {"n_symbols": _SYMBOL, "n_upper": _flags(range(65, 91)), "n_lower": _flags([*range(97, 123), *range(0xC3, 0xF5)]), "n_digits": _flags(range(48, 58)), "n_bangs": _flags(b"!"), "n_pipes": _flags(b"|")}


def count(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text."""
    n = len(off) - 1
    start, end, ranges = words(buf, off)
    h = Hasher(buf, folded=False)
    inside = np.zeros(len(buf) + 1, np.int64)
    first_bytes = (buf & 0xC0) != 0x80
    steps = np.zeros(len(buf) + 1, np.int8)
    np.add.at(steps, start, 1)
    np.add.at(steps, end, -1)
    in_word = np.cumsum(steps[:-1], dtype=np.int8) > 0
    np.cumsum(first_bytes & in_word, out=inside[1:])
    out = {"n_words": np.diff(ranges), "word_chars": np.diff(inside[off])}
    for name, flags in _SETS.items():
        inside[1:] = np.cumsum(flags[buf])
        out[name] = np.diff(inside[off])
    w = h(start, end)
    doc = owner(ranges)
    size = end - start
    out["n_longest"] = np.zeros(n, np.int64)
    full = np.flatnonzero(out["n_words"])
    if len(full):
        out["n_longest"][full] = np.maximum.reduceat(size, ranges[full])
    out["n_distinct"] = _distinct(doc, w, n)
    # lines with a word: found between line ends and ends of texts
    ls, le, lr = spans(buf != 10, off)
    has_word = np.zeros(len(ls), bool)
    at = np.searchsorted(ls, start, "right") - 1
    has_word[at] = True
    line_doc = owner(lr)[has_word]
    line = h(ls[has_word], le[has_word])
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(line_doc, line, n)
    # words in repeated windows
    covered = np.zeros(len(w) + 1, np.int64)
    k = len(w) - WINDOW + 1
    if k > 0:
        window = mix(doc[:k].astype(np.uint64) + np.uint64(1))
        for j in range(WINDOW):
            window = mix(window * np.uint64(0x9E3779B97F4A7C15) + w[j : j + k])
        same = doc[:k] == doc[WINDOW - 1 :]
        ordered = np.sort(window[same])
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            found = np.flatnonzero(same & (twice[np.minimum(np.searchsorted(twice, window), len(twice) - 1)] == window))
            np.add.at(covered, found, 1)
            np.add.at(covered, found + WINDOW, -1)
    out["n_repeat_words"] = sums((np.cumsum(covered[:-1]) > 0).astype(np.int64), ranges)
    return out


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Different values of h, by all 64 bits, within each text: two of a text's k lines or words clash with odds of k**2 / 2**65."""
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    d, v = doc[order], h[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return np.bincount(d[first], minlength=n)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace text by its counts (COUNTS, all long); null texts count as empty.

    Columns of docs by these names are replaced, all others stay.
    """
    docs = docs.drop(*COUNTS)
    rest = [c for c in docs.columns if c != text]
    schema = plus(docs.select(*[F.col(f"`{c}`") for c in rest]).schema, *((c, "long") for c in COUNTS))

    def run(batches):
        for part, buf, off in chunks(batches, text):
            got = count(buf, off)
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in rest), *(pa.array(got[c], pa.int64()) for c in COUNTS)], [*rest, *COUNTS])

    return docs.mapInArrow(run, schema)


def _per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def features() -> dict[str, Column]:
    """The ratios that rules test."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _per("word_chars", "n_words"),
        "symbols": _per("n_symbols", "word_chars"),
        "dup_lines": _per("n_dup_lines", "n_lines"),
        "repeats": _per("n_repeat_words", "n_words"),
        "upper": _per("n_upper", "word_chars"),
        "digits": _per("n_digits", "word_chars"),
        "bangs": _per("n_bangs", "n_words"),
        "pipes": _per("n_pipes", "n_words"),
        "longest": F.col("n_longest").cast("double"),
        "distinct": _per("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Rule:
    """Reject where all conditions (feature, ">=" or "<=", threshold) hold."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def column(self) -> Column:
        found = features()
        out = F.lit(True)
        for name, op, value in self.conditions:
            out = out & (found[name] >= value if op == ">=" else found[name] <= value)
        return out

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, value in self.conditions:
            out &= x[name] >= value if op == ">=" else x[name] <= value
        return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 24, precision: float = 0.9, at_least: int = 5, seed: int = 3) -> list[Rule]:
    """Sequential covering: rules that pick out bad rows, most useful first."""
    rng = np.random.default_rng(seed)
    grow = rng.random(len(bad)) < 0.67
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < max_rules:
        g, p = left & grow, left & ~grow
        if (bad & g).sum() < at_least:
            break
        conditions = _prune(_grow({k: v[g] for k, v in x.items()}, bad[g]), {k: v[p] for k, v in x.items()}, bad[p])
        if not conditions:
            break
        hit = Rule(conditions, 0, 0).holds(x) & left
        right = (bad & hit).sum() / max(1, hit.sum())
        if right < precision or (bad & hit).sum() < at_least:
            break
        rules.append(Rule(conditions, float(right), int(hit.sum())))
        left &= ~hit
    return rules


def _grow(x, bad, most: int = 4) -> tuple:
    """Add the condition of most FOIL gain until no good row is covered."""
    conditions, inside = (), np.ones(len(bad), bool)
    while (~bad & inside).any() and len(conditions) < most:
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        if not p0:
            break
        base, best, found = np.log2(p0 / (p0 + n0)), 1e-9, None
        for name, v in x.items():
            order = np.argsort(v[inside], kind="stable")
            value, y = v[inside][order], bad[inside][order]
            for op in (">=", "<="):
                vv, yy = (value[::-1], y[::-1]) if op == ">=" else (value, y)
                p, total = np.cumsum(yy), np.arange(1, len(yy) + 1)
                cut = np.append(vv[1:] != vv[:-1], False)
                gain = np.where(cut & (p > 0), p * (np.log2(np.maximum(p, 1e-9) / total) - base), -1)
                i = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[i] > best:
                    best, found = gain[i], (name, op, float((vv[i] + vv[i + 1]) / 2))
        if not found:
            break
        conditions += (found,)
        inside &= x[found[0]] >= found[2] if found[1] == ">=" else x[found[0]] <= found[2]
    return conditions


def _prune(conditions: tuple, x, bad) -> tuple:
    """The beginning of the conditions with the best (p - n) / (p + n) on rows kept apart; ties: the shortest."""
    if not len(bad):
        return conditions
    best, kept = -2.0, conditions
    for k in range(1, len(conditions) + 1):
        hit = Rule(conditions[:k], 0, 0).holds(x)
        p, n = (bad & hit).sum(), (~bad & hit).sum()
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best + 1e-9:
            best, kept = worth, conditions[:k]
    return kept


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", max_rows: int = 10_000, where: Column | None = None, **settings) -> list[Rule]:
    """Learn from the texts of docs that labels (key, label 1 good or 0 bad) marks.

    About max_rows of them, picked by a hash of key, are used: few enough to send their keys to every
    task. Null keys and labels are left out; of a key's several labels the smallest counts; equal rows
    count once. where, over the counts, keeps rows that other rules decide out of the learning.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"))
    n = known.count()
    if not n:
        return []
    picked = known.where(share(F.col("k"), min(1.0, max_rows / n), 17))
    own = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    got = statistics(own.join(F.broadcast(picked), "k"), "t")
    got = got if where is None else got.where(where)
    rows = got.select(F.col("k").cast("string"), "y", *[c.alias(f) for f, c in features().items()]).distinct().toArrow()
    rows = rows.sort_by([(c, "ascending") for c in rows.column_names])
    return learn({f: rows.column(f).to_numpy() for f in features()}, rows.column("y").to_numpy() == 0, **settings)


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects; the first rule that holds decides."""
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(False)) if out is None else out.when(r.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fired(rules: list[Rule]) -> Column:
    """Number of the rule that decides, from 1; 0 if none."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(r.column(), F.lit(i)) if out is None else out.when(r.column(), F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))
