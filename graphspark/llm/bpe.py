"""Byte-level BPE: boundaries by an associative scan over code-point classes, then cached pair merging."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import lean
from ._text import blocks

# Symbols of the automaton. Each looks at most two code points ahead, so that no transition has to be taken back.
L, N, O, A2, A3, SPACE_LAST, WHITE_LAST, WHITE, END = range(9)
# States: nothing open; a run of letters, numbers, others; a space that the next run takes in; a run of white space;
# one or two letters of a contraction to come.
S_NONE, S_L, S_N, S_O, S_GLUE, S_WHITE, S_1, S_2 = range(8)
#: \s of the pattern: the White_Space property.
WHITE_SPACE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SCAN = 256  # code points that one lane of the scan reads
#: Pieces that a task remembers.
CACHE = 400_000
BLOCK = 1_500_000


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a token begins before the symbol)."""
    if symbol == L:
        if state in (S_1, S_2):
            return (S_NONE if state == S_1 else S_1), False
        return S_L, state not in (S_L, S_GLUE)
    if symbol == N:
        return S_N, state not in (S_N, S_GLUE)
    if symbol == O:
        return S_O, state not in (S_O, S_GLUE)
    if symbol in (A2, A3):
        if state in (S_O, S_GLUE):
            return S_O, False
        return (S_1 if symbol == A2 else S_2), True
    if symbol == SPACE_LAST:
        return S_GLUE, True
    if symbol == WHITE_LAST:
        return S_NONE, True
    if symbol == WHITE:
        return S_WHITE, state != S_WHITE
    return S_NONE, True


@lru_cache(1)
def _automaton():
    """Transition functions as numbers: composition table, function of each symbol, result on each state, boundary table."""
    base = [tuple(_step(s, c)[0] for s in range(8)) for c in range(9)]
    number, todo = {tuple(range(8)): 0}, []
    for f in base:
        if f not in number:
            number[f] = len(number)
            todo.append(f)
    while todo:
        f = todo.pop()
        for g in base:
            fg = tuple(g[s] for s in f)
            if fg not in number:
                number[fg] = len(number)
                todo.append(fg)
    functions = sorted(number, key=number.get)
    n = len(functions)
    compose = np.array([[number[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    on = np.array(functions, np.uint8)
    begins = np.array([[_step(s, c)[1] for c in range(9)] for s in range(8)])
    return compose.ravel(), n, np.array([number[f] for f in base], np.uint16), on, begins


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, O, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = L
        elif k == "N":
            out[c] = N
    out[list(WHITE_SPACE)] = WHITE
    return out


def _prefix(f: np.ndarray, compose: np.ndarray, n: int) -> np.ndarray:
    """Inclusive scan of function numbers under composition."""
    size = len(f)
    if size <= SCAN:
        out = np.empty(size, np.uint16)
        acc = 0
        for i, x in enumerate(f.tolist()):
            acc = int(compose[acc * n + x])
            out[i] = acc
        return out
    lanes = -(-size // SCAN)
    padded = np.zeros(lanes * SCAN, np.uint16)  # function 0 is the identity
    padded[:size] = f
    grid = np.ascontiguousarray(padded.reshape(lanes, SCAN).T)
    acc = grid[0].astype(np.int64)
    for i in range(1, SCAN):
        acc = compose[acc * n + grid[i]].astype(np.int64)
        grid[i] = acc
    before = np.zeros(lanes, np.int64)
    before[1:] = _prefix(grid[-1].copy(), compose, n)[:-1]
    grid = compose[before[None, :] * n + grid]
    return grid.T.ravel()[:size]


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Index of the first code point of each token of texts that are each followed by the code point 0x110000 (their
    ends; a token of its own)."""
    compose, n, numbers, on, begins = _automaton()
    table = _classes()
    end = codes == 0x110000
    kind = table[np.where(end, 0, codes)]
    kind[end] = END
    white = kind == WHITE
    follows = np.zeros(len(codes), bool)  # a code point of no white space comes next
    follows[:-1] = ~white[1:] & ~end[1:]
    last = white & follows
    kind[last & (codes == 0x20)] = SPACE_LAST
    kind[last & (codes != 0x20)] = WHITE_LAST
    at = np.flatnonzero(codes == 0x27)
    if len(at):
        padded = np.r_[codes, 0, 0]
        one, two = padded[at + 1], padded[at + 2]
        kind[at[np.isin(one, [ord(c) for c in "stmd"])]] = A2
        three = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        kind[at[three]] = A3
    scanned = _prefix(numbers[kind], compose, n)
    state = np.zeros(len(codes), np.uint8)
    state[1:] = on[scanned[:-1], S_NONE]
    return np.flatnonzero(begins[state, kind])


class Vocabulary(dict):
    """Ranks of byte strings; as a mapping it gives the ids of a piece (as little-endian bytes), and remembers them."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.listed = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        found = np.array(self.merge(raw), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = found
        return found

    def merge(self, raw: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, the leftmost of equal ones, until none is in the vocabulary."""
        ranks = self.ranks
        if (whole := ranks.get(raw)) is not None:
            return [whole]
        n = len(raw)
        stop = list(range(1, n + 1))  # end of the part that begins here
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or stop[i] >= n or stop[stop[i]] != end or not alive[stop[i]]:
                continue
            j = stop[i]
            alive[j] = False
            stop[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(raw[i : stop[end]])) is not None:
                    heapq.heappush(heap, (r, i, stop[end]))
            if (h := before[i]) >= 0 and (r := ranks.get(raw[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : stop[i]]])
            i = stop[i]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.listed.__getitem__, ids.tolist()))


_KEPT: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _KEPT:
        _KEPT[path] = Vocabulary(path)
    return _KEPT[path]


def encode_texts(texts: list[str], vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of each text."""
    joined = np.concatenate([np.r_[np.frombuffer(t.encode("utf-32-le"), np.uint32), np.uint32(0x110000)] for t in texts]) if texts else np.zeros(0, np.uint32)
    starts = boundaries(joined)
    out, base, first = [], 0, 0
    ends = np.cumsum([len(t) + 1 for t in texts])
    cut = np.searchsorted(starts, ends)
    for t, end, stop in zip(texts, ends.tolist(), cut.tolist(), strict=True):
        at = (starts[first:stop] - base).tolist()  # the last is the end mark
        out.append(np.frombuffer(b"".join([vocab[t[a:b]] for a, b in zip(at, at[1:])]), "<u4"))  # noqa: B905
        base, first = end, stop
    return out


def _run(path: str | None, carry: list[str], ids_out: bool):
    def run(batches):
        from public_tokenizers import path as place

        vocab = vocabulary(path or place("byte_bpe_50k.tiktoken"))
        for batch in batches:
            for part in blocks(batch, "text", BLOCK):
                texts = part.column("text").to_pylist()
                ids = encode_texts(texts, vocab)
                cols = [part.column(c) for c in carry] + [pa.array([len(x) for x in ids], pa.int64())]
                names = [*carry, "n_tokens"]
                if ids_out:
                    offsets = [np.cumsum([0] + [len(vocab.listed[i]) for i in x[:-1].tolist()])[: len(x)] for x in ids]
                    cols += [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([x.astype(np.int32) for x in offsets], pa.list_(pa.int32()))]
                    names += ["ids", "offsets"]
                else:
                    cols += [pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(vocab.decode(x)).hexdigest() for x in ids])]
                    names += ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _apply(docs: DataFrame, path: str | None, carry: list[str], ids_out: bool, extra: str) -> DataFrame:
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).select(*dict.fromkeys([*carry, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in carry)
    return rows.mapInArrow(lean(_run(path, carry, ids_out)), f"{schema}, n_tokens long, {extra}")


def encode(docs: DataFrame, path: str | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry, n_tokens, ids, offsets (first byte of each token's bytes in the UTF-8 text) of every row, whole texts.

    path: a rank file, by default byte_bpe_50k.tiktoken of public_tokenizers. Null text counts as empty and has no
    ids. No special tokens. Rows are independent of each other, so repeated rows and ids are encoded each.
    """
    return _apply(docs, path, list(carry), True, "ids array<int>, offsets array<int>")


def digests(docs: DataFrame, path: str | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry, n_tokens, SHA-256 of the ids (32-bit little-endian) and of the bytes decoded from them; see encode()."""
    return _apply(docs, path, list(carry), False, "ids_sha256 string, decoded_sha256 string")


def _decode(path: str | None):
    def run(batches):
        from public_tokenizers import path as place

        vocab = vocabulary(path or place("byte_bpe_50k.tiktoken"))
        for batch in batches:
            for col in (batch,):
                raw = [vocab.decode(np.array(x or [], np.uint32)) for x in col.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([col.column("doc_id"), pa.array([r.decode("utf-8", "replace") for r in raw])], names=["doc_id", "text"])

    return run


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of (doc_id, ids); bytes that are no UTF-8 become replacement characters. Null ids give an empty text."""
    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(path), "doc_id long, text string")
