"""Codes of vectors by part: integer codebooks of Lloyd's rounds, whose sums are maintained by what changes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import saved

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers beyond it count as it, so that no sum of squares leaves 64 bits.
MOST = 2**27
#: Sums of so many labels are broadcast; more are joined by shuffle.
MOST_LABELS = 1_000_000
#: Vectors compared with a codebook at once.
ROWS = 8192


def integers(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, label, q (floor of scale * component) of vectors that are whole: not null, not empty, all of it finite."""
    whole = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    exact = F.transform(F.col(vec_col), lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * scale))).cast("int"))
    return vectors.where((F.size(vec_col) > 0) & whole).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), exact.alias("q"))


def _matrix(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """(rows, parts, width); what a vector lacks to equal parts is filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    whole = flat.reshape(len(column), -1).astype(np.int64) if len(column) else np.zeros((0, parts * width), np.int64)
    out = np.zeros((len(column), parts * width), np.int64)
    out[:, : whole.shape[1]] = whole
    return out.reshape(len(column), parts, width)


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of book (the lowest of equal ones) to each point, and its squared distance; exact."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * points.shape[1] * most * most < 2**53 else np.int64  # floats hold these integers exactly
    near = (book.astype(kind) ** 2).sum(axis=1)[None, :] - 2 * (points.astype(kind) @ book.T.astype(kind))
    at = near.argmin(axis=1)
    return at, ((points - book[at]) ** 2).sum(axis=1)


def _assign(books: np.ndarray):
    """Tasks that add to each row its code by books and the code that it had, or at the end the code and its error."""
    parts, _, width = books.shape

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                q = _matrix(batch.column("q"), parts, width)
                code, error = np.zeros((len(q), parts), np.uint8 if books.shape[1] <= 256 else np.uint16), np.zeros(len(q), np.int64)
                for k in range(parts):
                    at, far = nearest(q[:, k], books[k])
                    code[:, k] = at
                    error += far
                cols = {c: batch.column(c) for c in ("vec_id", "label", "q")}
                cols |= {"had": batch.column("code"), "code": pa.array([c.tobytes() for c in code], pa.binary()), "error": pa.array(error)}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def _changes(parts: int, entries: int, width: int):
    """Tasks that sum what rows with another code than before add to their new entries and take from their old ones:
    rows (part, entry, place, value) where value is not zero; place `width` is the number of rows."""

    def run(batches):
        total, kind = np.zeros((parts, entries, width + 1), np.int64), np.uint8 if entries <= 256 else np.uint16
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                q = _matrix(batch.column("q"), parts, width)
                new = np.array([np.frombuffer(c, kind) for c in batch.column("code").to_pylist()]).reshape(len(q), parts)
                had = batch.column("had").to_pylist()
                fresh = np.array([h is None for h in had])
                old = np.array([np.frombuffer(h, kind) if h is not None else n for h, n in zip(had, new, strict=True)]).reshape(len(q), parts)
                for k in range(parts):
                    moved = fresh | (old[:, k] != new[:, k])
                    with_count = np.c_[q[moved, k], np.ones(int(moved.sum()), np.int64)]
                    np.add.at(total[k], new[moved, k], with_count)
                    left = moved & ~fresh
                    np.subtract.at(total[k], old[left, k], np.c_[q[left, k], np.ones(int(left.sum()), np.int64)])
        part, entry, place = np.nonzero(total)
        names = ["part", "entry", "place", "value"]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[part, entry, place])], names=names)

    return run


def first_books(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors of the smallest ids; of equal ids the smaller vector comes first."""
    rows = [r["q"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).select("q").collect()]
    width = -(-len(rows[0]) // parts)
    padded = np.zeros((len(rows), parts * width), np.int64)
    padded[:, : len(rows[0])] = rows
    return padded.reshape(len(rows), parts, width).transpose(1, 0, 2).copy()


def lloyd(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code binary, error) of each kept vector, and the final codebooks (parts, entries, width).

    Vectors become integers (floor of scale * component) and are cut into `parts` equal consecutive parts. Each round
    assigns every part to the nearest entry of its codebook and writes the assignment beside the vector. A task then
    sums the contributions of its changed parts only, plus for the new entry and minus for the old one; these sums
    (parts * entries * (width + 1) numbers a task at most) are all that is shuffled, and are added to the running sums, which
    are a table too. The driver gets as many numbers, whatever the table's size.

    Rows are dropped where the vector is null, empty, holds null or what is not finite, or has another length than the kept
    vector of the smallest id (of equal ids the shorter). A length that is no multiple of parts is filled with zeros.
    Integers beyond +-2^27 count as that. Null ids come last and repeated ids are rows of their own; with fewer rows than
    entries the codebooks have as many entries as there are rows. An empty table has no codebooks and no rows. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    whole = integers(vectors, id_col, vec_col, label_col, scale)
    first = whole.orderBy(F.asc_nulls_last("vec_id"), F.size("q")).limit(1).select(F.size("q").alias("n")).collect()
    dims = first[0]["n"] if first else 0
    state = saved(whole.where(F.size("q") == dims).withColumn("code", F.lit(None).cast("binary")), "lloyd-0")
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, q array<int>, had binary, code binary, error long"
    if not dims:
        return state.select("vec_id", "label", "code", F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    books = first_books(state, parts, entries)
    sums = None
    for k in range(rounds):
        state = saved(state.mapInArrow(_assign(books), schema), f"lloyd-{k + 1}")
        moved = state.where(~F.col("code").eqNullSafe(F.col("had"))).select("q", "had", "code")
        change = moved.mapInArrow(_changes(*books.shape), "part int, entry int, place int, value long")
        sums = saved((change if sums is None else sums.unionByName(change)).groupBy("part", "entry", "place").agg(F.sum("value").alias("value")), "lloyd-sums")
        books = replaced(books, sums)
    done = saved(state.mapInArrow(_assign(books), schema).select("vec_id", "label", "code", "error"), "lloyd-codes")
    return done, books


def replaced(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Each used entry becomes the floor of its parts' mean."""
    parts, entries, width = books.shape
    total = np.zeros((parts, entries, width + 1), np.int64)
    for r in sums.collect():  # parts * entries * (width + 1) at most
        total[r["part"], r["entry"], r["place"]] = r["value"]
    used = total[:, :, width] > 0
    out = books.copy()
    out[used] = total[used][:, :width] // total[used][:, width:]
    return out


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_digests(spark: SparkSession, done: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (sum over equal labels, nulls together), codebooks_sha256."""
    total = done.groupBy("label").agg(F.sum("error").alias("label_error"))
    total = saved(total.withColumnRenamed("label", "of_label"), "lloyd-labels")
    total = F.broadcast(total) if total.count() <= MOST_LABELS else total
    joined = done.join(total, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
