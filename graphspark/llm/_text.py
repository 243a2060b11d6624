"""Words and their hashes from Arrow string columns, as array operations over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BLOCK_BYTES = 1_000_000
#: Bytes whose words are hashed at once; a longer word is hashed by itself.
HASH_BYTES = 1 << 18

_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
for _c in range(65, 91):  # A-Z hash as a-z
    _BYTE[_c] = _BYTE[_c + 32]
_SEP = np.zeros(256, bool)
_SEP[list(SEPARATORS)] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, HASH_BYTES)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            more = min(done, size - done)
            have[done : done + more] = have[:more] * U(pow(base, done, 2**64))
            done += more
        if size == HASH_BYTES:  # those of a longer word are not kept
            _POWERS[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that all bits depend on all bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the offset of each text (one more than there are texts). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text; one longer text is a slice of its own."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z as a-z), the index of each text's first word (one more than there are texts),
    and the first and past-the-last byte of each word."""
    data, at = text_bytes(column)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SEP[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < n)]  # a text's end also ends its last word
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(stop, start[first] + HASH_BYTES, "right")))
        h[first:last] = _hashes(data, start[first:last], stop[first:last])
        first = last
    return h, np.searchsorted(start, at), start, stop


def _hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the words of one stretch of bytes; where it begins makes no difference."""
    zero, n = start[0], int(stop[-1] - start[0])
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data[zero : zero + n]] * _powers(_BASE, n), out=total[1:])
    return mixed((total[stop - zero] - total[start - zero]) * _powers(_INVERSE, n)[start - zero])


_STEP = [U(x | 1) for x in _rng.integers(1, 2**63, 16).tolist()]


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words of one text; with fewer words the whole run is one; none without words."""
    n = len(h)
    if not n:
        return h
    k = min(n, size)
    total = np.full(n - k + 1, U(k), np.uint64)
    for i in range(k):
        total += h[i : n - k + 1 + i] * _STEP[i]
    return mixed(total)
