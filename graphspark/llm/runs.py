"""Maximal runs of words that repeat with a period: Lyndon roots, extended by longest common prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import blocks

MIN_LENGTH, MIN_EXPONENT = 6, 4
BLOCK = 1_500_000
#: Steps that all positions take together before the rest is done one by one.
STEPS = 48
#: Entries of a block of the table of minima.
MINIMA = 16


def suffix_ranks(x: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks by prefix doubling over many texts end to end; suffixes of an earlier text are smaller.

    x: symbols, where each text ends with a 0 that occurs nowhere else in it; text: the number of each one's text. Only
    suffixes that are not told apart yet are sorted again."""
    n = len(x)
    key = text.astype(np.int64) * (int(x.max(initial=0)) + 1) + x
    sa = np.argsort(key, kind="stable").astype(np.int32)
    rank = np.empty(n, np.int32)
    slots, ordered, step = np.arange(n, dtype=np.int32), key[sa], 1
    members = sa
    while True:
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        begins = np.flatnonzero(new)
        rank[members] = slots[begins[np.cumsum(new) - 1]]
        open_ = ~(new & np.r_[new[1:], True])  # of a group of several
        slots, members = slots[open_], members[open_]
        if not len(members):
            return sa, rank
        key = rank[members].astype(np.int64) * n + rank[members + step]
        order = np.argsort(key, kind="stable")
        members, ordered = members[order], key[order]
        sa[slots] = members
        step *= 2


def common_prefixes(x: np.ndarray, text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of each suffix and the one before it in the array (0 across texts).

    Only those that do not follow from the position before are compared; their lengths add up to n log n."""
    n = len(x)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = np.where(text[sa[1:]] == text[sa[:-1]], sa[:-1], -1)
    y = np.where(x == 0, -1 - text, x)  # ends differ
    at = np.arange(n)
    own = (before <= 0) | (at == 0)
    own[1:] |= y[:-1] != y[before[1:] - 1]
    found = np.zeros(n, np.int32)
    a = np.flatnonzero(own & (before >= 0))
    b, h = before[a], np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    while len(left) > 64:
        left = left[y[a[left] + h[left]] == y[b[left] + h[left]]]
        h[left] += 1
    for k in left.tolist():
        i, j, size = int(a[k] + h[k]), int(b[k] + h[k]), 256
        while True:
            m = min(size, n - max(i, j))
            differ = np.flatnonzero(y[i : i + m] != y[j : j + m])
            if len(differ):
                h[k] = i + differ[0] - a[k]
                break
            i, j, size = i + m, j + m, size * 2
    found[a] = h
    from_ = np.maximum.accumulate(np.where(own, at, 0))
    return np.where(before >= 0, found[from_] - (at - from_), 0)[sa].astype(np.int32)


class Minima:
    """Minima of stretches of an array: a sparse table over blocks, and running minima within each block."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        rows = -(-self.n // MINIMA)
        grid = np.full(rows * MINIMA, np.iinfo(np.int32).max, np.int32)
        grid[: self.n] = values
        grid = grid.reshape(rows, MINIMA)
        self.values = grid.ravel()
        self.upto = np.minimum.accumulate(grid, axis=1).ravel()
        self.onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [grid.min(axis=1)]
        while 2 ** len(self.levels) <= rows:
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of values[first..last], both included."""
        out = np.minimum(self.onward[first], self.upto[last])
        a, b = first // MINIMA, last // MINIMA
        near = np.flatnonzero(a == b)
        if len(near):
            here, stop = first[near].copy(), last[near]
            least = self.values[here]
            for _ in range(MINIMA - 1):
                here = np.minimum(here + 1, stop)
                least = np.minimum(least, self.values[here])
            out[near] = least
        gap = b - a - 1
        for k, level in enumerate(self.levels):
            mine = np.flatnonzero((gap >= 2**k) & (gap < 2 ** (k + 1)))
            if len(mine):
                out[mine] = np.minimum(out[mine], np.minimum(level[a[mine] + 1], level[b[mine] - 2**k]))
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The next position of a smaller value; what is beyond the end is smaller than all."""
    n = len(values)
    padded = np.append(values, np.iinfo(values.dtype).min)
    to = np.arange(1, n + 1)
    left = np.arange(n)
    for _ in range(STEPS):
        left = left[padded[to[left]] > values[left]]
        if not len(left):
            return to
        to[left] = to[to[left]]  # all between are larger than what is stepped over
    for i in left[::-1].tolist():
        j, mine = int(to[i]), values[i]
        while padded[j] > mine:
            j = int(to[j])
        to[i] = j
    return to


def runs(x: np.ndarray, text: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all maximal runs of the texts in x, by start, then period.

    Each run ends before a symbol that is smaller, or larger, than the one a period before. In the order in which it is
    smaller, the longest Lyndon word at some position in the run's first period is one period long, and it ends where
    the next smaller suffix begins. These words are found under both orders, lengthened to the right by the common prefix of
    the two suffixes a period apart, and to the left by bisection over the same. ends: where each text's 0 stands."""
    none = np.zeros(0, np.int64)
    if len(x) <= len(ends):
        return none, none, none
    sa, rank = suffix_ranks(x, text)
    least = Minima(common_prefixes(x, text, sa))

    def common(i, j):
        a, b = rank[i].astype(np.int64), rank[j].astype(np.int64)
        return least.of(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)

    stop = ends[text]
    found = []
    for values in (rank, -rank):
        to = next_smaller(values)
        i = np.flatnonzero((x != 0) & (to < stop))
        p = to[i] - i
        fits = i + (min_exponent - 1) * p + 1 <= stop[i]  # a first root leaves so many periods behind it
        i, p = i[fits], p[fits]
        alike = x[i] == x[i + p]
        i, p = i[alike], p[alike]
        r = common(i, i + p)
        long = r >= (min_exponent - 2) * p + 1
        found.append((i[long], p[long], (i + p + r)[long]))
    i, p, e = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((i, p, e))  # roots of one run share period and end; the first of them stays
    i, p, e = i[order], p[order], e[order]
    first = np.r_[True, (p[1:] != p[:-1]) | (e[1:] != e[:-1])] if len(i) else np.zeros(0, bool)
    i, p, e = i[first], p[first], e[first]
    begin = np.r_[0, ends[:-1] + 1][text[i]]
    low, high = np.maximum(begin, i - p + 1), i.copy()
    while (todo := np.flatnonzero(low < high)).size:
        mid = (low[todo] + high[todo]) // 2
        whole = mid + p[todo] + common(mid, mid + p[todo]) >= e[todo]
        high[todo[whole]] = mid[whole]
        low[todo[~whole]] = mid[~whole] + 1
    kept = e - high >= np.maximum(min_length, min_exponent * p)
    s, e, p = high[kept], e[kept], p[kept]
    order = np.lexsort((p, s))
    return s[order], e[order], p[order]


def _find(id_cols: list[str], min_length: int, min_exponent: int):
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text", BLOCK):
                numbers: dict[bytes, int] = {}
                split = [(t or "").encode().split() for t in part.column("text").to_pylist()]  # bytes split at ASCII white space alone
                sizes = np.array([len(w) for w in split], np.int64)
                ends = np.cumsum(sizes + 1) - 1
                x = np.zeros(int(ends[-1]) + 1, np.int32)
                text = np.repeat(np.arange(len(split), dtype=np.int32), sizes + 1)
                inside = np.ones(len(x), bool)
                inside[ends] = False
                x[inside] = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for ws in split for w in ws), np.int32, int(sizes.sum()))
                s, e, p = runs(x, text, ends, min_length, min_exponent)
                gone = np.zeros(len(x) + 1, np.int32)
                np.add.at(gone, s + p, 1)
                np.add.at(gone, e, -1)
                kept = np.cumsum(gone[:-1]) == 0
                cut = np.searchsorted(s, np.r_[0, ends + 1])
                listed, left = [], []
                for k, ws in enumerate(split):
                    base = int(ends[k] - sizes[k])
                    own = slice(cut[k], cut[k + 1])
                    listed.append([{"start": a - base, "length": b - a, "period": c} for a, b, c in zip(s[own].tolist(), e[own].tolist(), p[own].tolist(), strict=True)])
                    left.append(b" ".join(ws if not listed[-1] else [ws[i] for i in np.flatnonzero(kept[base : base + len(ws)]).tolist()]).decode())
                names = [*id_cols, "n_words", "runs", "collapsed"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in id_cols), pa.array(sizes), pa.array(listed, pa.list_(kind)), pa.array(left, pa.string())], names=names)

    return run


def word_runs(docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """id_cols, n_words, runs (array of start, length, period, by start, then period), collapsed of each row.

    Words are what lies between spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns, numbered from 0. A run
    is a stretch whose smallest period is `period`, of min_length words and min_exponent periods (2 at least) or more,
    that cannot be lengthened. collapsed holds the words, joined by one space, but for those that a run holds after its first
    period. All of a text is read; a task works through blocks of texts of some 1.5 MB, and a longer text is a block of its
    own (some 100 bytes of memory a word).

    Null and empty texts have no words, no runs and an empty collapsed text. Rows are independent of each other, repeated
    and null ids are rows of their own, an empty table gives none, and other columns are ignored.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    rows = docs.select(*id_cols, F.col(text_col).alias("text")) if text_col not in id_cols else docs.select(*id_cols)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in id_cols)
    return rows.mapInArrow(_find(list(id_cols), min_length, min_exponent), f"{schema}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def greatest_exponent(column: str) -> Column:
    """Of an array of runs the one of the greatest length / period, compared exactly (of equal ones the first), or null."""
    none = F.get(F.col(column), F.lit(0))
    return F.aggregate(column, none, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
