"""Benchmark decontamination: CGK random-walk embeddings of item-sized windows, bit-sampling LSH, exact edit distances.

The window that an item is sought in is as long as the item; its embedding is a row of walks, one from each word of it,
instead of one walk over all of it. A walk that has lost its place after an edit finds it again at the next word, so that
an edit spoils the walks that run over it and no others. Bit samples of the walks are the keys of the tables; a window is
a candidate when samples of two of its words agree with the item's at nearly the same begin.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import lean
from ._text import U, blocks, mixed, text_bytes, words

#: A passage leaks when it is within this share of the item's bytes of the item, in edits.
MAX_EDITS = 0.2
#: Steps of the random walk, positions of it that a table samples, and tables: of items of many words, and of items of
#: fewer than MANY. At MAX_EDITS one byte in five is edited, so that few runs of more than eight bytes are left alone:
#: a walk is short, and an item is embedded from each of its words.
WALKS = ((11, 10, 3), (9, 8, 3))
MANY = 24
#: Probability that a step moves on.
MOVES = 0.85
#: Items of fewer words are compared with all of a text, by pieces of which one must be left alone.
FEW = 8
LANES = 16_384  # walks taken at once
#: Items, and bytes of items, compared at once; more are compared in blocks of about so many.
BLOCK_ITEMS, BLOCK_ITEM_BYTES = 20_000, 16_000_000
_SEED = 99


def _normal(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased and white space as spaces, byte by byte, so that positions stay."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[9, 10, 11, 12, 13]] = 32
    return table[data]


class Embedding:
    """The random walk of the CGK embedding: at step j it emits the byte under it and moves on if R[j, byte] says so."""

    def __init__(self, steps: int, sampled: int, tables: int):
        rng = np.random.default_rng(_SEED)
        self.steps = steps
        self.moves = (rng.random((steps, 256)) < MOVES).astype(np.int64)
        self.sampled = [np.sort(rng.choice(steps, sampled, replace=False)) for _ in range(tables)]
        values = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.by_step: dict[int, list[tuple[int, np.ndarray]]] = {}
        for t, at in enumerate(self.sampled):
            for j in at.tolist():
                self.by_step.setdefault(j, []).append((t, values * U(int(rng.integers(1, 2**62)) * 2 + 1)))

    def keys(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(tables, windows) hashes of the sampled positions; bytes beyond the end are 0."""
        padded = np.concatenate([data, np.zeros(self.steps + 1, np.uint8)])
        out = np.zeros((len(self.sampled), len(starts)), np.uint64)
        for lo in range(0, len(starts), LANES):
            at = starts[lo : lo + LANES].astype(np.int64)
            mine = out[:, lo : lo + LANES]
            for j in range(self.steps):
                c = padded[at]
                for t, value in self.by_step.get(j, ()):
                    mine[t] += value[c]
                at += self.moves[j][c]
        return mixed(out)


def best_match(item: bytes, region: bytes, most: int) -> tuple[int, int] | None:
    """(edits, end) of the substring of region nearest to item, the first of equal ones; None beyond `most` edits.

    Bit-parallel dynamic programming (one column of the edit matrix in a pair of integers)."""
    at = region.find(item)
    if at >= 0:
        return 0, at + len(item)
    m = len(item)
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, where = m, 0  # of the empty substring
    for j, c in enumerate(region):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, where = score, j + 1
    return (best, where) if best <= most else None


#: Longest items verified many at once; longer ones go through best_match one by one.
MANY_BYTES = 1024
#: Candidates verified at once, and those that are gathered before.
AT_ONCE, GATHERED = 4096, 16_384


def _masks(items: list[bytes], words_: int) -> np.ndarray:
    """(word, item, byte) bits of the positions at which an item has a byte; byte 256 is in none."""
    out = np.zeros((words_, len(items), 257), np.uint64)
    raw = np.frombuffer(b"".join(items), np.uint8)
    size = np.array([len(b) for b in items])
    pos = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
    np.bitwise_or.at(out, (pos // 64, np.repeat(np.arange(len(items)), size), raw), U(1) << (pos % 64).astype(np.uint64))
    return out


def best_matches(items: list[bytes], which: np.ndarray, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """best_match of items[which[i]] in data[lo[i]:hi[i]] for all i, without a bound: (edits, end) of each.

    All items take the same number of 64-bit words; the columns of all edit matrices advance together."""
    size = np.array([len(b) for b in items], np.int64)[which]
    span, n_words, one = hi - lo, -(-int(size.max()) // 64), U(1)
    masks = _masks(items, n_words).reshape(n_words, -1)
    pv = np.full((n_words, len(which)), ~U(0), np.uint64)
    mv = np.zeros((n_words, len(which)), np.uint64)
    shift = [U(63)] * (n_words - 1) + [((size - 1) % 64).astype(np.uint64)]
    score, best, where = size.copy(), size.copy(), np.zeros(len(which), np.int64)
    row, none = which * 257, np.zeros(len(which), np.uint64)
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    for j in range(int(span.max())):
        inside = j < span
        at = row + np.where(inside, padded[np.minimum(lo + j, len(data))], 256)
        up = down = none
        for w in range(n_words):
            eq, p, m = masks[w].take(at), pv[w], mv[w]
            xv = eq | m
            eq |= down
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = m | ~(xh | p), p & xh
            next_up, next_down = (ph >> shift[w]) & one, (mh >> shift[w]) & one
            ph, mh = (ph << one) | up, (mh << one) | down
            pv[w], mv[w] = mh | ~(xv | ph), ph & xv
            up, down = next_up, next_down
        score += up.astype(np.int64) - down.astype(np.int64)
        better = (score < best) & inside
        if better.any():
            best[better], where[better] = score[better], j + 1
    return best, where


def anywhere(item: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """best_match over all of a text: of most + 1 pieces of the item, one is left alone in what is within `most` edits."""
    if most >= len(item):
        return best_match(item, text, most)
    cut = [len(item) * i // (most + 1) for i in range(most + 2)]
    spots: set[int] = set()
    for a, z in zip(cut, cut[1:], strict=False):
        at = text.find(item[a:z])
        while at >= 0:
            spots.add(at - a)
            at = text.find(item[a:z], at + 1)
    best, reach = None, None
    for lo, hi in _runs(sorted(spots), len(item) + 2 * most):
        lo, hi = max(0, lo - most), min(len(text), hi + len(item) + most)
        got = best_match(item, text[lo:hi], most)
        if got and (best is None or got[0] < best):
            best, reach = got[0], lo + got[1]
    return None if best is None else (best, reach)


def _runs(spots: list[int], gap: int) -> list[tuple[int, int]]:
    """First and last of each run of sorted numbers that are at most `gap` apart."""
    out: list[tuple[int, int]] = []
    for s in spots:
        if out and s - out[-1][1] <= gap:
            out[-1] = (out[-1][0], s)
        else:
            out.append((s, s))
    return out


class Windows:
    """The sorted keys of the windows of some items: one at each word, in each table."""

    def __init__(self, walk: tuple[int, int, int], data: np.ndarray, start: np.ndarray, text: np.ndarray, offset: np.ndarray, most: np.ndarray):
        self.walk = Embedding(*walk)
        keys = self.walk.keys(data, start)
        self.most = most
        self.tables = []
        for k in keys:
            order = np.argsort(k, kind="stable")
            maybe = np.zeros(1 << 20, bool)
            maybe[(k >> U(44)).astype(np.int64)] = True
            self.tables.append((k[order], maybe, text[order], offset[order]))

    def candidates(self, data: np.ndarray, pos: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(text, item, first begin, last begin) of what has to be verified: two windows of the text agree with two of the
        item in some table, and place the item at begins that differ by half of its edits at most."""
        hits = []
        for (k, maybe, of, offset), mine in zip(self.tables, self.walk.keys(data, pos), strict=True):
            cand = np.flatnonzero(maybe[(mine >> U(44)).astype(np.int64)])
            lo, hi = np.searchsorted(k, mine[cand], "left"), np.searchsorted(k, mine[cand], "right")
            some = hi > lo
            cand, lo, many = cand[some], lo[some], (hi - lo)[some]
            c = np.repeat(cand, many)
            x = np.arange(len(c)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
            hits.append(np.stack([c, of[x], offset[x]], 1))
        window, item, offset = np.concatenate(hits).T
        if not len(window):
            return np.zeros((0, 4), np.int64)
        text = np.searchsorted(at, pos[window], "right") - 1
        begin = pos[window] - offset
        group = text * (int(item.max()) + 1) + item
        order = np.lexsort((window, begin, group))
        group, window, begin, item, text, offset = group[order], window[order], begin[order], item[order], text[order], offset[order]
        near = (group[1:] == group[:-1]) & (begin[1:] - begin[:-1] <= np.maximum(1, self.most[item[1:]] // 2))
        # runs of hits that are near each other, of at least two windows of the text and two of the item
        first = np.flatnonzero(np.r_[True, ~near])
        last = np.r_[first[1:], len(group)] - 1
        good = (np.minimum.reduceat(window, first) < np.maximum.reduceat(window, first)) & (np.minimum.reduceat(offset, first) < np.maximum.reduceat(offset, first))
        return np.stack([text[first], item[first], begin[first], begin[last]], 1)[good]


class Items:
    """A block of benchmark items: their texts, and the windows of those that have enough words."""

    def __init__(self, ids: list[int], texts: list[str]):
        column = pa.array(texts, pa.string())
        raw, at = text_bytes(column)
        data = _normal(raw)
        h, first, start, _ = words(column)
        many = np.diff(first)
        text = np.repeat(np.arange(len(ids)), many)
        self.ids = ids
        self.bytes = [data[at[i] : at[i + 1]].tobytes().rstrip(b" ") for i in range(len(ids))]
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.most = np.array([int(MAX_EDITS * len(b)) for b in self.bytes], np.int64)
        self.windows = []
        for walk, least, below in ((WALKS[0], MANY, None), (WALKS[1], FEW, MANY)):
            of = (many[text] >= least) & (many[text] < below if below else True)
            if of.any():
                self.windows.append(Windows(walk, data, start[of], text[of], (start - at[:-1][text])[of], self.most))
        self.rest = [i for i in range(len(ids)) if many[i] < FEW and self.bytes[i].strip()]


def _verified(items: Items, asked: np.ndarray, data: np.ndarray):
    """(doc, item, edits, end in the text) of the candidates that are within an item's bound, in their order.

    asked: rows (doc, item, first and past-the-last byte of the region in data, its first byte in the text)."""
    doc, i, lo, hi, at = asked.T
    size, most = items.size[i], items.most[i]
    edits, reach = np.full(len(i), 1 << 40), np.zeros(len(i), np.int64)
    long, span = -(-size // 64), hi - lo
    few = np.flatnonzero(size <= MANY_BYTES)
    few = few[np.lexsort((span[few], long[few]))]
    k = 0
    while k < len(few):  # what is verified together takes as many words, and about as many columns
        first = few[k]
        same = few[k : k + AT_ONCE]
        same = same[(long[same] == long[first]) & (span[same] <= 1.2 * span[first] + 64)]
        of, which = np.unique(i[same], return_inverse=True)
        edits[same], reach[same] = best_matches([items.bytes[x] for x in of], which, data, lo[same], hi[same])
        k += len(same)
    for k in np.flatnonzero(size > MANY_BYTES):
        got = best_match(items.bytes[i[k]], data[lo[k] : hi[k]].tobytes(), int(most[k]))
        if got:
            edits[k], reach[k] = got
    for k in np.flatnonzero(edits <= most):
        yield int(doc[k]), int(i[k]), int(edits[k]), int(at[k] + reach[k])


class Gathered:
    """Candidates of several texts, verified together; what is found is kept until it is taken."""

    def __init__(self, items: Items):
        self.items = items
        self._clear()

    def _clear(self) -> None:
        self.docs, self.rows, self.data, self.size, self.bytes = [], [], [], 0, 0
        self.found: dict[tuple[int, int], tuple[int, int]] = {}

    def add_texts(self, docs: list[int]) -> int:
        """Number of the first of these texts."""
        self.docs += docs
        return len(self.docs) - len(docs)

    def add(self, first: int, text: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, data: np.ndarray, at: np.ndarray) -> None:
        """Regions [lo, hi) of data, which holds texts that begin at `at`, to be searched for items."""
        span = hi - lo
        start = np.cumsum(span) - span
        pick = np.repeat(lo - start, span) + np.arange(int(span.sum()))
        self.rows.append(np.stack([first + text, item, self.bytes + start, self.bytes + start + span, lo - at[text]], 1))
        self.data.append(data[pick])
        self.size += len(text)
        self.bytes += len(pick)

    def keep(self, text: int, item: int, edits: int, end: int) -> None:
        if (text, item) not in self.found or edits < self.found[text, item][0]:
            self.found[text, item] = (edits, end)

    def take(self) -> pa.RecordBatch:
        if self.size:
            for row in _verified(self.items, np.concatenate(self.rows), np.concatenate(self.data)):
                self.keep(*row)
        found, items = sorted(self.found.items()), self.items
        columns = [
            pa.array([self.docs[d] for (d, _), _ in found], pa.int64()), pa.array([items.ids[i] for (_, i), _ in found], pa.int64()),
            pa.array([e for _, (e, _) in found], pa.int32()), pa.array([max(0, z - len(items.bytes[i])) for (_, i), (_, z) in found], pa.int64()),
            pa.array([z for _, (_, z) in found], pa.int64()),
        ]
        self._clear()
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "edits", "about_start", "end"])


def _find(shared):
    def run(batches):
        items: Items = shared.value
        gathered = Gathered(items)
        for batch in batches:
            for part in blocks(batch, "text"):
                raw, at = text_bytes(part.column("text"))
                data = _normal(raw)
                _, _, pos, _ = words(part.column("text"))
                first = gathered.add_texts(part.column("doc_id").to_pylist())
                for windows in items.windows if len(pos) else ():
                    d, i, begin, end = windows.candidates(data, pos, at).T
                    size = items.size[i]
                    gathered.add(first, d, i, np.maximum(at[d], begin - items.most[i]), np.minimum(at[d + 1], end + size + items.most[i]), data, at)
                for i in items.rest:
                    want = items.bytes[i]
                    for d in range(part.num_rows):
                        got = anywhere(want, data[at[d] : at[d + 1]].tobytes(), int(items.most[i]))
                        if got:
                            gathered.keep(first + d, i, *got)
                if gathered.size >= GATHERED or len(gathered.docs) >= GATHERED:
                    yield gathered.take()
        yield gathered.take()

    return run


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, edits, about_start, end): each benchmark item (item_id, text) that a document holds a passage
    near to, with the fewest edits found; positions are bytes of the UTF-8 text.

    Near is at most 20 % of the item's bytes in edits, A-Z counting as a-z and white space as spaces. The search is not
    exact: README has its measured recall against brute force; what it finds is verified over the whole item, so that
    no row is wrong. Items of fewer than FEW words are compared with every text in full and exactly, which takes time
    in proportion to their number. Items without bytes other than spaces, and null items, are found nowhere; null and
    empty documents hold nothing; a null id is kept. Repeated items are found each, repeated rows give repeated results.
    The items of a block are sent to the driver and broadcast; blocks are dealt by the hash of the id so that one has
    about `block` items and BLOCK_ITEM_BYTES bytes, and each reads all documents. An empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    many = max(1, -(-n // block), -(-size // BLOCK_ITEM_BYTES))
    out = None
    for k in range(many):
        part = known if many == 1 else known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k)
        got = part.orderBy("item_id", "text").toArrow()
        shared = spark.sparkContext.broadcast(Items(got.column("item_id").to_pylist(), got.column("text").to_pylist()))
        found = rows.mapInArrow(lean(_find(shared)), "doc_id long, item_id long, edits int, about_start long, end long")
        out = found if out is None else out.union(found)
    return out
