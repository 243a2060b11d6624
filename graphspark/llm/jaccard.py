"""Similarity join on word shingles by globally ordered sets and prefix trees, and the components of its links.

Stages: texts of one class (equal sets) share a signature; all shingles of all classes are counted, rare ones come first in
the global order; every class posts the prefix of its ordered set, which a linked class must meet; classes that meet are
verified in prefix trees over the whole ordered sets; links become components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.algorithms import components
from ._store import give_back, lean, partitions, saved
from ._text import U, blocks, mixed, shingles, words

WORDS = 5
PERCENT = 75
#: Shingles are counted by the first bits of their hash, 4 bytes a counter; the counts decide the speed, never the result.
COUNT_BITS = 20
#: Counters that a row carries.
COUNTERS_A_ROW = 1 << 16
#: A shingle with so many postings more than is usual is dealt to several buckets.
HOT = 1 << 16
#: Postings that a bucket is to hold, about; one bucket of a task is in memory at a time.
BUCKET_POSTINGS = 100_000
#: Meetings of up to so many classes give all their pairs; larger ones give links to one pivot, then what those leave open.
SMALL = 8
#: Shingles of the sets that are verified against one set at once, about.
CELL_SHINGLES = 200_000
#: Tables of up to so many rows of a few numbers are broadcast.
MOST_BROADCAST = 1_000_000
#: Postings, or signatures of texts that were seen, that a task gathers.
FLUSH, MOST_SEEN = 250_000, 500_000
_LOW = U((1 << 64 - COUNT_BITS) - 1)


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Least overlap that a set of n shingles has with a linked one."""
    return -((-PERCENT * n) // 100)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for part in blocks(batch, "text"):
        h, first, _, _ = words(part.column("text"))
        ids = part.column("doc_id").to_pylist()
        for i, doc in enumerate(ids):
            yield doc, np.unique(shingles(h[first[i] : first[i + 1]], size))


def _signature(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _sketch(s: np.ndarray) -> bytes:
    """How many shingles fall into each of about n / 2 buckets, four bits each; 15 stands for any number from 15."""
    size = max(2, 1 << max(0, (len(s) // 2).bit_length() - 1))
    n = np.minimum(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size), 15).astype(np.uint8)
    return (n[::2] | n[1::2] << 4).tobytes()


def _most_shared(a: bytes, b: bytes) -> int:
    """No less than the overlap of the sets of two sketches."""
    counts = []
    for raw in (a, b):
        x = np.frombuffer(raw, np.uint8)
        n = np.empty(2 * len(x), np.int64)
        n[::2], n[1::2] = x & 15, x >> 4
        n[n == 15] = 1 << 40
        counts.append(n)
    x, y = sorted(counts, key=len)
    return int(np.minimum(x, y.reshape(-1, len(x)).sum(0)).sum())


#: Lanes of the coarse sketch that joins compare, one byte each, eight in a number.
LANES = 64


def _lanes(s: np.ndarray) -> list[int] | None:
    """How many shingles fall into each lane; None of sets with more in one than a byte holds, which are compared with all."""
    n = np.bincount((s >> np.uint64(8) & np.uint64(LANES - 1)).astype(np.int64), minlength=LANES)
    return None if n.max() > 255 else n.astype(np.uint8).view(np.int64).tolist()


def _lanes_allow(a: str, b: str, na: str, nb: str):
    """Whether two sets may be linked: their overlap is no more than the smaller number of each lane, added up."""
    lane = lambda c, k: F.shiftrightunsigned(F.col(c)[k // 8], 8 * (k % 8)).bitwiseAND(F.lit(255))
    most = sum((F.least(lane(a, k), lane(b, k)) for k in range(1, LANES)), F.least(lane(a, 0), lane(b, 0)))
    enough = most * (100 + PERCENT) >= PERCENT * (F.col(na) + F.col(nb))
    return F.col(a).isNull() | F.col(b).isNull() | enough


class Seen:
    """Which classes a task has met: copies are combined before the shuffle. Forgetting costs time only."""

    def __init__(self):
        self.known: set[int] = set()

    def first(self, sig: int) -> bool:
        if sig in self.known:
            return False
        if len(self.known) >= MOST_SEEN:
            self.known.clear()
        self.known.add(sig)
        return True


def _profile(size: int):
    """Rows (doc_id, n, sig, sketch, lanes, content) of the texts; then rows of n = -1 with the counters of a task's classes in
    sketch."""

    def rows(got, content):
        columns = [*[pa.array([g[k] for g in got], pa.int64()) for k in range(3)], pa.array([g[3] for g in got], pa.binary()), pa.array([g[4] for g in got], pa.list_(pa.int64())), content]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "sig", "sketch", "lanes", "content"])

    def run(batches):
        count, seen = np.zeros(1 << COUNT_BITS, np.uint32), Seen()
        for batch in batches:
            got = []
            for doc, s in _sets(batch, size):
                sig = _signature(s)
                got.append((doc, len(s), sig, _sketch(s), _lanes(s)))
                if seen.first(sig):
                    np.add.at(count, (s >> U(64 - COUNT_BITS)).astype(np.int64), 1)
            yield rows(got, batch.column("content"))
        for k in range(0, len(count), COUNTERS_A_ROW):
            if count[k : k + COUNTERS_A_ROW].any():
                yield rows([(None, -1, k, count[k : k + COUNTERS_A_ROW].tobytes(), None)], pa.nulls(1, pa.int64()))

    return run


def _added(batches):
    """Rows (sig, sketch) of counters, sorted by sig: their sums."""
    key, total = None, None
    names = ["sig", "sketch"]
    row = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=names)
    for batch in batches:
        for k, raw in zip(batch.column("sig"), batch.column("sketch"), strict=True):
            if k.as_py() != key:
                if key is not None:
                    yield row()
                key, total = k.as_py(), np.zeros(COUNTERS_A_ROW, np.uint64)
            total += np.frombuffer(raw.as_py(), np.uint32)
    if key is not None:
        yield row()


class Order:
    """The global order: shingles by the count of their counter, then by hash. A shingle's place in it is its hash with
    the counter's number replaced by the counter's rank, which loses nothing."""

    def __init__(self, count: np.ndarray, hot: int = HOT):
        by_count = np.argsort(count, kind="stable")
        self.rank = np.empty(len(count), np.uint32)
        self.rank[by_count] = np.arange(len(count), dtype=np.uint32)
        ordered = count[by_count]
        spare = ordered - np.minimum(ordered, 2 * ordered[len(ordered) // 2])  # beyond what many rare shingles add up to
        self.first_hot = int(np.searchsorted(spare, hot, "right"))
        self.salts = (spare[self.first_hot :] + np.uint64(hot - 1)) // np.uint64(hot)

    def places(self, s: np.ndarray) -> np.ndarray:
        """The set in the global order."""
        rank = self.rank[(s >> U(64 - COUNT_BITS)).astype(np.int64)].astype(np.uint64)
        return np.sort((rank << U(64 - COUNT_BITS)) | (s & _LOW))


def _order(counters: DataFrame, hot: int) -> Order:
    """The counters of all tasks, added up where they are; the driver gets one number a counter."""
    spark = counters.sparkSession
    dealt = counters.select("sig", "sketch").repartition(min(partitions(spark), (1 << COUNT_BITS) // COUNTERS_A_ROW), "sig").sortWithinPartitions("sig")
    count = np.zeros(1 << COUNT_BITS, np.uint64)
    for r in dealt.mapInArrow(lean(_added), "sig long, sketch binary").collect():
        count[r["sig"] : r["sig"] + COUNTERS_A_ROW] = np.frombuffer(r["sketch"], np.uint64)
    return Order(count, hot)


def _possible(batches):
    """Of rows (a, b, na, nb, sa, sb) the pairs (a, b, nb) whose sketches allow a link."""
    for batch in batches:
        a, b, na, nb, sa, sb = (batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "sa", "sb"))
        keep = [i for i in range(len(a)) if (100 + PERCENT) * _most_shared(sa[i], sb[i]) >= PERCENT * (na[i] + nb[i])]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], pa.int64()) for x in (a, b, nb)], names=["a", "b", "nb"])


def _dealt(buckets: int, order: Order, tokens: np.ndarray, owners: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, packed 32-bit names of shingles, packed owners). Two shingles of one name only meet in vain.

    The postings of a hot shingle go to buckets from `buckets` on, by the hash of their owner too."""
    low = tokens & _LOW
    name = (mixed(low) >> U(32)).astype(np.uint32)
    bucket = (low % U(buckets)).astype(np.int64)
    rank = (tokens >> U(64 - COUNT_BITS)).astype(np.int64)
    hot = np.flatnonzero(rank >= order.first_hot)
    if len(hot):
        salt = mixed(owners[hot, 0].astype(np.uint64)) % order.salts[rank[hot] - order.first_hot]
        bucket[hot] = buckets + (mixed(low[hot] + salt) % U(buckets)).astype(np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    name, owners, bucket = name[by_bucket], owners[by_bucket], bucket[by_bucket]
    full, cut = np.unique(bucket, return_index=True)
    cut = np.r_[cut, len(bucket)]
    yield pa.RecordBatch.from_arrays([
        pa.array(full, pa.int64()), pa.array([name[cut[k] : cut[k + 1]].tobytes() for k in range(len(full))], pa.binary()),
        pa.array([owners[cut[k] : cut[k + 1]].tobytes() for k in range(len(full))], pa.binary()),
    ], names=["bucket", "name", "owner"])


def _prefixes(size: int, buckets: int, shared):
    """Postings of the prefix of each class that a task meets: the first shingles of its ordered set."""

    def run(batches):
        order, seen = shared.value, Seen()
        tokens, owners, many = [], [], 0
        for batch in batches:
            for _, s in _sets(batch, size):
                n, sig = len(s), _signature(s)
                if not n or not seen.first(sig):
                    continue
                long = int(n - needed(n) + 1)
                tokens.append(order.places(s)[:long])
                left = n - np.arange(long, dtype=np.int64)
                owners.append(np.stack([np.full(long, sig, np.int64), (n << 32) | left], 1))
                many += long
                if many >= FLUSH:
                    yield from _dealt(buckets, order, np.concatenate(tokens), np.concatenate(owners))
                    tokens, owners, many = [], [], 0
        if many:
            yield from _dealt(buckets, order, np.concatenate(tokens), np.concatenate(owners))

    return run


def _allowed(n: np.ndarray, top: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets may be linked that share no shingle before this one: top is the largest size of a partner for which
    what is left of a set from here on suffices."""
    return (n[j] <= top[i]) & (n[i] <= top[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))


def _groups(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(token)])


def _met(b: int, buckets: int, parts: list) -> Iterator[pa.RecordBatch]:
    """The meetings of one bucket."""
    name = np.concatenate([np.frombuffer(r, np.uint32) for r, _ in parts])
    own = np.concatenate([np.frombuffer(o, np.int64).reshape(-1, 2) for _, o in parts])
    hot = b >= buckets
    if not hot:
        order = np.argsort(name, kind="stable")
        _, size = _groups(name[order])
        own, name = own[order[np.repeat(size > 1, size)]], name[order][np.repeat(size > 1, size)]
    order = np.lexsort((own[:, 0], name))
    name, sig, both = name[order], own[order, 0], own[order, 1]
    new = np.r_[True, (name[1:] != name[:-1]) | (sig[1:] != sig[:-1])] if len(name) else np.zeros(0, bool)
    name, sig, both = name[new], sig[new], both[new]
    n = both >> 32
    top = (100 + PERCENT) * (both & 0xFFFFFFFF) // PERCENT - n
    for _ in range(0 if hot else 2):  # who finds nobody small enough, or nobody who could take one so large, has no part in it
        if not len(name):
            break
        first, size = _groups(name)
        least, most = np.minimum.reduceat(n, first), np.maximum.reduceat(top, first)
        part = (np.repeat(least, size) <= top) & (np.repeat(most, size) >= n) & np.repeat(size > 1, size)
        name, sig, n, top = name[part], sig[part], n[part], top[part]
    if not len(name):
        return
    first, size = _groups(name)
    out = []
    for m in range(2, 0 if hot else SMALL + 1):
        at = first[size == m]
        for i in range(m):
            for j in range(i + 1, m):
                fit = _allowed(n, top, at + i, at + j)
                out.append(np.stack([sig[at + i][fit], sig[at + j][fit]], 1))
    big = size > (0 if hot else SMALL)
    names = ["a", "b", "meeting", "n", "top"]
    if big.any():
        core = np.where(top >= n, np.arange(len(n)), len(n))
        pivot = np.minimum.reduceat(core, first)
        pivot = np.where(pivot == len(n), first, pivot)
        at = np.flatnonzero(np.repeat(big, size))
        # the parts of a hot meeting have one number, those of other buckets each their own
        meeting = np.repeat(name[first].astype(np.int64) * 1_000_003 + (0 if hot else b + 1), size)[at]
        of = np.repeat(pivot, size)[at]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sig[of], sig[at], meeting, n[at], top[at])], names=names)
        fit = _allowed(n, top, of, at) & (of != at)
        out.append(np.stack([sig[of][fit], sig[at][fit]], 1))
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    if len(pairs):
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        none = pa.nulls(len(pairs), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none, none], names=names)


def _meetings(buckets: int):
    """Sets that share a shingle of their prefixes, from rows sorted by bucket: one bucket is in memory at a time. Of a
    small meeting all pairs (a, b) that may be linked; of a large one a row (pivot, member, meeting, n, top) for each
    member, the pivot too."""

    def run(batches):
        key, parts = None, []
        for batch in batches:
            for b, name, own in zip(*(batch.column(c) for c in ("bucket", "name", "owner")), strict=True):
                if b.as_py() != key:
                    if parts:
                        yield from _met(key, buckets, parts)
                    key, parts = b.as_py(), []
                parts.append((name.as_py(), own.as_py()))
        if parts:
            yield from _met(key, buckets, parts)

    return run


class PrefixTree:
    """Ordered sets in a path-compressed trie: what sorted neighbours share at their beginning is stored once."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.edges: list[np.ndarray] = []  # the shingles on the way into a node
        self.parent: list[int] = []
        self.least: list[int] = []  # size of the smallest and largest set below
        self.most: list[int] = []
        self.leaf: list[list[int]] = []
        self.depth: list[int] = []
        ordered = [sets[i] for i in self.order]
        self._grow(ordered, 0, len(ordered), 0, -1)

    def _grow(self, sets: list[np.ndarray], lo: int, hi: int, depth: int, parent: int) -> None:
        todo = [(lo, hi, depth, parent)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            a, z = sets[lo], sets[hi - 1]
            k = min(len(a), len(z))
            differs = np.flatnonzero(a[depth:k] != z[depth:k])
            end = depth + int(differs[0]) if len(differs) else k
            node = len(self.edges)
            sizes = [len(x) for x in sets[lo:hi]]
            self.edges.append(a[depth:end])
            self.parent.append(parent)
            self.depth.append(end)
            self.least.append(min(sizes))
            self.most.append(max(sizes))
            here = lo
            while here < hi and len(sets[here]) == end:
                here += 1
            self.leaf.append([self.order[i] for i in range(lo, here)])
            while here < hi:
                stop = here + 1
                while stop < hi and sets[stop][end] == sets[here][end]:
                    stop += 1
                todo.append((here, stop, end, node))
                here = stop

    def linked(self, probe: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
        """(set, overlap) of all sets with 100 * overlap >= percent * union."""
        out, n = [], len(probe)
        met = [0] * len(self.edges)
        dead = [False] * len(self.edges)
        for k, edge in enumerate(self.edges):  # parents come before their children
            up, left = self.parent[k], n
            if up >= 0 and dead[up]:
                dead[k] = True
                continue
            had = met[up] if up >= 0 else 0
            if len(edge):
                at = np.searchsorted(probe, edge)
                had += int(np.count_nonzero(probe[np.minimum(at, n - 1)] == edge))
                left = n - int(at[-1])
            met[k] = had
            # overlaps below are at most `had` and what is left of the longest set, or of the probe
            by_set = 100 * self.most[k] >= percent * n + (100 + percent) * (self.depth[k] - had)
            by_probe = (100 + percent) * (had + left) >= percent * (n + self.least[k])
            if not (by_set and by_probe):
                dead[k] = True
                continue
            for i in self.leaf[k]:
                if had * 100 >= percent * (n + self.depth[k] - had):
                    out.append((i, had))
        return out


def _as_sets(size: int, shared):
    """(sig, shingles): the whole ordered set of each text, 8 bytes a shingle."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                h, first, _, _ = words(part.column("text"))
                sets = [np.unique(shingles(h[first[i] : first[i + 1]], size)) for i in range(part.num_rows)]
                packed = [shared.value.places(x).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array([_signature(x) for x in sets], pa.int64()), pa.array(packed, pa.binary())], names=["sig", "shingles"])

    return run


def _verify(batches):
    """Rows (a, cell, b, shingles) sorted by cell; the first of each cell is a itself. Gives the linked pairs."""
    key, probe, ids, sets = None, None, [], []

    def close():
        if not sets:
            return [], []
        found = PrefixTree(sets).linked(probe)
        return [key[0]] * len(found), [ids[i] for i, _ in found]

    for batch in batches:
        a_out, b_out = [], []
        small = (batch.column(c).to_pylist() for c in ("a", "cell", "b"))
        for a, cell, b, raw in zip(*small, batch.column("shingles"), strict=True):
            s = np.frombuffer(raw.as_py(), np.uint64)
            if (a, cell) != key:
                x, y = close()
                a_out += x
                b_out += y
                key, probe, ids, sets = (a, cell), None, [], []
            if b is None:
                probe = s
            else:
                ids.append(b)
                sets.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
    x, y = close()
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def _links(pairs: DataFrame, classes: DataFrame, rows: DataFrame, size: int, order) -> DataFrame:
    """The pairs (a, b) that are linked. Only texts of classes in pairs (a, b, nb) are read again; a cell holds a and
    those of its partners that have about CELL_SHINGLES shingles together."""
    spark = pairs.sparkSession
    ends = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    n_pairs = pairs.count()
    if n_pairs <= MOST_BROADCAST // 2:
        ends = F.broadcast(ends)
    involved = saved(classes.select("sig", F.col("first_id").alias("doc_id")).join(ends, "sig"), "involved")
    sets = saved(rows.join(_small(involved.select("doc_id").distinct()), "doc_id").select("text").mapInArrow(lean(_as_sets(size, order)), "sig long, shingles binary"), "sets")
    crowd = pairs.groupBy("a").agg(F.sum("nb").alias("m")).where(F.col("m") > CELL_SHINGLES)
    cell = F.expr(f"pmod(xxhash64(b), greatest(1, ceil(coalesce(m, 1) / {CELL_SHINGLES})))").cast("int")
    dealt = saved(pairs.join(crowd, "a", "left").withColumn("cell", cell).select("a", "cell", "b"), "dealt", n_pairs)
    cells = dealt.select("a", "cell").distinct()
    if n_pairs <= MOST_BROADCAST:  # there are no more cells than that
        dealt, cells = F.broadcast(dealt), F.broadcast(cells)
    side_b = sets.withColumnRenamed("sig", "b").join(dealt, "b").select("a", "cell", "b", "shingles")
    side_a = sets.withColumnRenamed("sig", "a").join(cells, "a").select("a", "cell", F.lit(None).cast("long").alias("b"), "shingles")
    met = side_b.unionByName(side_a).repartition(partitions(spark), "a", "cell").sortWithinPartitions("a", "cell", F.col("b").asc_nulls_first())
    return met.mapInArrow(lean(_verify), "a long, b long")


def _small(rows: DataFrame) -> DataFrame:
    """To be broadcast where its size is known to be bounded, otherwise joined by shuffle."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


#: A level of sampling keeps one class of so many (a power of two).
STEP_BITS = 6


def _level(c: str):
    """0 for most classes, 1 for one of 2^STEP_BITS, 2 for one of as many of these, and so on."""
    zeros = F.length(F.regexp_extract(F.reverse(F.lpad(F.bin(F.xxhash64(c)), 64, "0")), "^(0*)", 1))
    return F.floor(zeros / STEP_BITS).cast("int")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that links reach, itself included), content
    (xxhash64 of the text, which tells rows of one id apart).

    Texts are split at ASCII white space, A-Z lower-cased; the set of a text is its distinct runs of five words (of all
    words where there are fewer). Two documents link when 100 * |A & B| >= 75 * |A | B|. Exact but for collisions of
    64-bit hashes of shingles and of sets.

    Nothing is capped: meetings of many classes are first linked to one pivot. Members that this leaves outside the
    pivot's component are paired with some of the others in the largest of their meetings, then with 64 times as many, then
    with all of it; what is still outside is at last paired with all members of all its meetings outside its own component.
    Only pairs whose coarse sketches allow a link leave that join. Pairs inside a component need no verification and get none, so that links are not counted.
    Copies are combined before each shuffle. Null and empty texts, and texts of white space alone, have no shingles, link
    with nothing and are components of their own, also when repeated. Equal sets always link. Each row of a repeated id
    is a document by itself, with the component of its own text. Of a null id too, with the component_id of the others in
    its component, or null. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = rows.withColumn("content", F.xxhash64("text"))
    everything = saved(marked.mapInArrow(lean(_profile(size)), "doc_id long, n long, sig long, sketch binary, lanes array<long>, content long"), "profile")
    profile = everything.where("n >= 0")
    order = spark.sparkContext.broadcast(_order(everything.where("n < 0"), hot))

    # equal sets have equal sizes and sketches
    nobody = (1 << 63) - 1
    by_id = F.coalesce("doc_id", F.lit(nobody))
    classes = profile.where("n > 0").groupBy("sig").agg(F.min(by_id).alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.any_value("sketch").alias("sketch"), F.any_value("lanes").alias("lanes"))
    classes = saved(classes, "classes")
    posted = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)).first()[0] or 0
    buckets = max(partitions(spark), -(-posted // BUCKET_POSTINGS))
    postings = rows.mapInArrow(lean(_prefixes(size, buckets, order)), "bucket long, name binary, owner binary")
    dealt = postings.repartitionById(partitions(spark), F.pmod("bucket", F.lit(partitions(spark))).cast("int")).sortWithinPartitions("bucket")
    met = saved(dealt.mapInArrow(lean(_meetings(buckets)), "a long, b long, meeting long, n long, top long"), "meetings")
    named = rows.withColumn("doc_id", by_id)

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches allow a link; their sizes do, as they come from meetings."""
        left, right = (classes.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
        n = pairs.count()
        asked = F.broadcast(pairs) if n <= MOST_BROADCAST else pairs
        return saved(left.join(asked, "a").join(right, "b").mapInArrow(lean(_possible), "a long, b long, nb long"), "pairs", n)

    def linked(pairs: DataFrame) -> DataFrame:
        return _links(pairs, classes, named, size, order)

    def labels(new: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """(id, component) after new links (a, b), which join the components that there were before."""
        n = new.count()
        if before is None:
            found = components(new.select(F.col("a").alias("src"), F.col("b").alias("dst")))
            return saved(found.withColumnRenamed("node_id", "id"), "labels", 2 * n)
        if not n:
            return before
        of = lambda c: before.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
        between = new.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("src"), F.coalesce("of_b", "b").alias("dst"))
        found = components(saved(between, "between", n)).toDF("component", "joined")
        others = new.select(F.col("a").alias("id")).union(new.select("b")).distinct().join(before, "id", "left_anti")
        everyone = before.select("id", "component").union(others.select("id", F.col("id").alias("component")))
        now = everyone.join(found, "component", "left").select("id", F.coalesce("joined", "component").alias("component"))
        return saved(now, "labels", before.count() + 2 * n)

    n_met = met.count()
    large = met.where("meeting is not null")
    pivots = large.select("meeting", "a").distinct()
    first_pivot = pivots.groupBy("meeting").agg(F.min("a").alias("p"), F.count(F.lit(1)).alias("many")).where("many > 1").select("meeting", "p")
    parts = pivots.join(first_pivot, "meeting").where("a <> p").select(F.least("a", "p").alias("a"), F.greatest("a", "p").alias("b"))
    tried = saved(met.where("meeting is null").select("a", "b").union(parts).distinct(), "tried", n_met)
    label, depth = labels(saved(linked(possible(tried)), "links")), 0
    deepest = large.agg(F.max(_level("b"))).first()[0]
    while deepest is not None and depth <= deepest + 1:
        of = lambda c: label.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))  # noqa: B023, E731
        members = saved(large.select("meeting", F.col("b").alias("x"), "n", "top").join(of("x"), "x", "left").withColumn("of_x", F.coalesce("of_x", "x")), "members", n_met)
        main = large.groupBy("meeting").agg(F.min("a").alias("p"), F.max(_level("b")).alias("deep"), F.count(F.lit(1)).alias("many"))
        main = main.join(of("p"), "p", "left").select("meeting", "deep", "many", F.coalesce("of_p", "p").alias("of_p"))
        outside = members.join(main, "meeting").where("of_x <> of_p")
        open_ones = saved(outside.select("meeting", "deep", "many", F.col("x").alias("y"), F.col("of_x").alias("of_y"), F.col("n").alias("n_y"), F.col("top").alias("top_y")), "open", n_met)
        if not open_ones.take(1):
            break
        if depth <= deepest:  # what shares many meetings is compared in the largest of them; only the last level looks at all
            largest = F.max_by(F.struct("meeting", "deep", "of_y", "n_y", "top_y"), F.struct("many", "meeting")).alias("o")
            open_ones = saved(open_ones.groupBy("y").agg(largest).select("y", "o.*"), "largest", n_met)
        else:
            open_ones = open_ones.drop("many")
        lanes = lambda c: classes.select(F.col("sig").alias(c), F.col("lanes").alias(f"lanes_{c}"))
        chosen = members.join(open_ones.select("meeting", "deep").distinct(), "meeting").where(_level("x") >= F.col("deep") - depth).drop("deep").join(lanes("x"), "x")
        fits = f"y <> x and of_x <> of_y and n <= top_y and n_y <= top and 100 * least(n, n_y) >= {PERCENT} * greatest(n, n_y)"
        near = open_ones.drop("deep").join(lanes("y"), "y").join(chosen, "meeting").where(F.expr(fits) & _lanes_allow("lanes_x", "lanes_y", "n", "n_y"))
        pairs = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        asked = saved(pairs.join(tried, ["a", "b"], "left_anti"), "asked")
        more = possible(asked)
        depth += 1
        if more.take(1):
            label = labels(saved(linked(more), "links"), label)
        tried = tried.union(asked)

    labelled = label.withColumnRenamed("id", "sig").join(classes, "sig")
    smallest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    connected = labelled.join(smallest, "component").select("sig", "component_id")
    copied = classes.where("copies > 1").join(label, classes.sig == label.id, "left_anti").select("sig", F.col("first_id").alias("component_id"))
    by_sig = saved(connected.union(copied), "members")
    order.destroy()  # nothing that is read from here on needs it
    give_back()
    found = profile.join(by_sig, (profile.sig == by_sig.sig) & (profile.n > 0), "left")
    component = F.when(F.col("component_id") != nobody, F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(component, "doc_id").alias("component_id"), "content")
