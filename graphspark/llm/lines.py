"""Cross-site boilerplate lines: HyperLogLog sketches of the sites of each line, exact counts near the threshold."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import lean, saved

MIN_SITES = 3
LOG_K = 10  # a sketch has 2**LOG_K registers
#: Relative error that the band around the threshold covers: three standard errors.
BAND = 3 * 1.04 / 2 ** (LOG_K / 2)
#: Lines of up to so many hashes (16 bytes each) are broadcast.
MOST_BROADCAST = 4_000_000
SEED = 42  # of xxhash64 in Spark SQL
#: Stands for a null id: such rows come after all others when the first document of a line is chosen.
NOBODY = (1 << 63) - 1


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, site, line hash) of each line that is not blank."""
    line = F.explode(F.split(F.coalesce("text", F.lit("")), "\n"))
    return docs.select("doc_id", F.xxhash64(F.coalesce("site", F.lit(""))).alias("site"), line.alias("line")).where(~F.col("line").rlike(r"\A[\x20\x09-\x0D]*\z")).select("doc_id", "site", F.xxhash64("line").alias("h"))


def _joined(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(small) if small.count() <= MOST_BROADCAST else small, "h", how)


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, n_sites, first_doc) of the lines on at least min_sites sites. docs: doc_id, site, text.

    First, lines on two sites at least (where min_sites asks for them) are found by plain aggregation of hashes; most lines end there. The rest get a
    sketch of their sites, merged by aggregation. Where a sketch's estimate is within three standard errors (or one) of
    the threshold, the sites are counted exactly. All aggregates are combined before the shuffle, so that a line that
    a third of the documents hold is a row per task.
    """
    if min_sites < 1:
        raise ValueError("min_sites is 1 at least")
    lines = _lines(docs)
    spans = lines.groupBy("h").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.count(F.lit(1)).alias("n"))
    several = F.col("lo") != F.col("hi") if min_sites > 1 else F.lit(True)
    wide = saved(spans.where(several & (F.col("n") >= min_sites)).select("h"), "wide")
    sketched = saved(_joined(lines, wide).groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"), F.min("doc_id").alias("first_doc")).select("h", "first_doc", F.hll_sketch_estimate("sketch").alias("n_sites")), "sketched")
    low, high = min(min_sites - 1, min_sites * (1 - BAND)), max(min_sites + 1, min_sites * (1 + BAND))
    near = sketched.where(F.col("n_sites").between(low, high))
    exact = _joined(lines, near.select("h")).groupBy("h", "site").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("exact"))
    counted = near.drop("n_sites").join(exact, "h").withColumnRenamed("exact", "n_sites").where(F.col("n_sites") >= min_sites)
    return sketched.where(F.col("n_sites") > high).select("h", "n_sites", "first_doc").unionByName(counted)


def _positions(hashes: list[int], doc: int, first_of: dict[int, int]) -> list[int]:
    """Positions of the lines that go: those in first_of, but for the first of each in the document that comes first."""
    gone, had = [], set()
    for i, h in enumerate(hashes):
        first = first_of.get(h)
        if first is None:
            continue
        if first == doc and h not in had:
            had.add(h)
            continue
        gone.append(i)
    return gone


def _line_hashes(split: list[list[str]]) -> np.ndarray:
    """xxhash64 of all lines, as Spark SQL has it."""
    n = sum(map(len, split))
    return np.fromiter((xxhash.xxh64_intdigest(line.encode(), seed=SEED) for x in split for line in x), np.uint64, n).view(np.int64)


def _without(batch: pa.RecordBatch, first_of) -> pa.RecordBatch:
    """The batch without the lines that go; first_of(row, its line hashes) gives the first document of those of them that
    are boilerplate."""
    split = [t.split("\n") for t in batch.column("text").to_pylist()]
    cut = np.cumsum([0] + [len(x) for x in split])
    hashes = _line_hashes(split)
    texts, removed = batch.column("text").to_pylist(), []
    for i, doc in enumerate(batch.column("key").to_pylist()):
        mine = hashes[cut[i] : cut[i + 1]]
        found = first_of(i, mine)
        gone = _positions(mine.tolist(), doc, found) if found else []
        if gone:
            out = set(gone)
            texts[i] = "\n".join([line for k, line in enumerate(split[i]) if k not in out])
        removed.append(gone)
    others = [c for c in batch.schema.names if c not in ("key", "text", "firsts")]
    columns = [*[batch.column(c) for c in others], pa.array(texts, pa.string()), pa.array(removed, pa.list_(pa.int32())), pa.array([len(x) for x in split], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=[*others, "text", "removed", "n_lines"])


def _remove_listed(found):
    def run(batches):
        keys, firsts = found.value

        def first_of(_, mine):
            at = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
            hit = np.flatnonzero(keys[at] == mine) if len(keys) else ()
            return {int(mine[j]): int(firsts[at[j]]) for j in hit}

        for batch in batches:
            yield _without(batch, first_of)

    return run


def _remove_joined(batches):
    for batch in batches:
        firsts = batch.column("firsts").to_pylist()
        yield _without(batch, lambda i, _, firsts=firsts: {f["h"]: f["first_doc"] for f in firsts[i] or ()})


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", carry: tuple[str, ...] = (), most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, carry, text, removed (positions from 0), n_lines of every row: without its boilerplate lines.

    A line (between line feeds, equal when its 64-bit hash is) is boilerplate when at least min_sites distinct sites have
    it; with 1, every line that is not blank. Its first occurrence, in the smallest doc_id that has it, stays; all others
    go. Blank lines stay. A document whose lines all go stays with an empty text. Null text counts as empty, null site is
    a site of its own name "". A text without boilerplate is not changed. Each row is read by itself: those of a repeated
    id keep the first occurrence each, and so do rows of null ids, which come after all ids, where no other row has the
    line. An empty table gives an empty result; columns that are not carried are ignored.

    The lines found are broadcast up to most_broadcast of them; beyond that, they are joined to the lines of each text
    and the texts by id and hash. Both ways give the same rows.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NOBODY))
    rows = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("doc_id"), *[c for c in carry if c != id_col], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sites = docs.select(key.alias("doc_id"), F.col(site_col).alias("site"), F.col(text_col).alias("text"))
    found = saved(boilerplate(sites, min_sites), "boilerplate")
    kept = [f for f in rows.schema.fields if f.name not in ("key", "text")]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "text string, removed array<int>, n_lines int"
    if found.count() <= most_broadcast:
        got = found.select("h", "first_doc").orderBy("h").toArrow()
        keys = got.column("h").to_numpy(), got.column("first_doc").to_numpy()
        return rows.mapInArrow(lean(_remove_listed(docs.sparkSession.sparkContext.broadcast(keys))), schema)
    content = F.xxhash64("text").alias("content")
    lines = rows.select("key", content, F.explode(F.split("text", "\n")).alias("line")).select("key", "content", F.xxhash64("line").alias("h"))
    firsts = lines.distinct().join(found.select("h", "first_doc"), "h").groupBy("key", "content").agg(F.collect_list(F.struct("h", "first_doc")).alias("firsts"))
    return rows.withColumn("content", content).join(firsts, ["key", "content"], "left").drop("content").mapInArrow(lean(_remove_joined), schema)
