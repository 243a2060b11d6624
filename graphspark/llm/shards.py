"""Sharding by a k-d tree whose cuts are weighted medians found by distributed histograms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import saved

#: A dimension's key: 15 bits of the coordinate, 32 of the content hash, 16 of the id hash. Equal texts are neighbours
#: in every dimension, and the id tells copies apart only where a cut has to pass through them.
COORDINATE_BITS, CONTENT_BITS, ID_BITS = 15, 32, 16
KEY_BITS = COORDINATE_BITS + CONTENT_BITS + ID_BITS
#: Bits of a key that one histogram resolves.
STEP_BITS = 11
#: A cut may leave its target by this part of a leaf.
TOLERANCE = 0.002
#: Rows that one bucket of the slot numbering is to hold, about.
SLOT_ROWS = 100_000
#: Tables of up to so many rows of a few numbers are broadcast.
MOST_BROADCAST = 1_000_000


@dataclass(frozen=True)
class Node:
    number: int
    shards: int
    first: int  # number of the node's first shard


def _scaled(c: Column, most: float) -> Column:
    top = (1 << COORDINATE_BITS) - 1
    return F.least(F.lit(top), F.greatest(F.lit(0), F.floor(c * top / most))).cast("long")


def text_dimensions(text: Column, lang: Column) -> dict[str, Column]:
    """Metadata in 0..1 that copies of a text share: length, language, share of bytes beyond ASCII."""
    n = F.length(text)
    return {
        "length": F.log2(1.0 + n) / 32.0,
        "lang": F.crc32(F.coalesce(lang, F.lit("")).cast("binary")) / float(1 << 32),
        "beyond_ascii": (F.octet_length(text) - n) / F.greatest(n, F.lit(1)) / 3.0,
    }


def kd_shards(rows: DataFrame, id_col: str, weight: str, content: str, dimensions: list[str], shards: int) -> DataFrame:
    """Add `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard) to narrow rows; each row stays a row.

    rows: id, weight (bytes), content (a 64-bit hash of what must stay together where possible), dimensions in 0..1, and
    other columns, which are kept. The tree is split until it has as many leaves as shards; with n leaves to come, a node
    is cut at the weighted quantile floor(n / 2) / n of its widest dimension (the spread of its values; the first of equal
    ones). Each cut is found by histograms of 2048 bins, one aggregation for all nodes of a level and each refinement; the
    driver gets a row a node, of which there are two a shard, and rows find their node's cut by a join, so that plans do not
    grow with the tree. Null dimensions count as 0, null weights as 0, a null id is an id. Rows that agree in all keys
    (same content, same 16-bit id hash) share a shard. Fewer rows than shards leave shards empty; an empty table gives an
    empty result.
    """
    spark = rows.sparkSession
    content_part = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.col(content)), 64 - CONTENT_BITS), ID_BITS)
    id_part = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 64 - ID_BITS)
    keys = [F.shiftleft(_scaled(F.coalesce(d, F.lit(0.0)), 1.0), CONTENT_BITS + ID_BITS) + content_part + id_part for d in dimensions]
    given = [c for c in rows.columns if c not in (content, *dimensions)]
    base = saved(rows.select(*given, F.coalesce(weight, F.lit(0)).cast("long").alias("__w"), F.array(*keys).alias("__k"), F.lit(0).alias("__node")), "kd")
    total = base.agg(F.sum("__w")).first()[0] or 0
    slack = max(1, int(total / max(shards, 1) * TOLERANCE))
    open_nodes, numbered, leaves = [Node(0, shards, 0)], 1, []
    while cutting := [n for n in open_nodes if n.shards > 1]:
        leaves += [n for n in open_nodes if n.shards == 1]
        at = base.join(_small(spark, [(n.number,) for n in cutting], "__node int"), "__node")
        ends = [f(F.shiftright(F.col("__k")[i], KEY_BITS - COORDINATE_BITS)).alias(f"{f.__name__}_{i}") for i in range(len(dimensions)) for f in (F.min, F.max)]
        spread = {r["__node"]: r for r in at.groupBy("__node").agg(F.sum("__w").alias("w"), *ends).collect()}
        widest, target = {}, {}
        for n in cutting:
            r = spread.get(n.number)
            widest[n.number] = 0 if r is None else max(range(len(dimensions)), key=lambda i: (r[f"max_{i}"] - r[f"min_{i}"], -i))  # noqa: B023
            target[n.number] = 0 if r is None else r["w"] * (n.shards // 2) // n.shards
        cut = _cuts(base, widest, target, slack)
        tree, open_nodes = [], []
        for n in cutting:
            left = Node(numbered, n.shards // 2, n.first)
            right = Node(numbered + 1, n.shards - n.shards // 2, n.first + n.shards // 2)
            numbered += 2
            tree.append((n.number, widest[n.number], cut.get(n.number, 0), left.number, right.number))
            open_nodes += [left, right]
        table = _small(spark, tree, "__node int, __dim int, __cut long, __left int, __right int")
        goes = F.when(F.col("__k")[F.col("__dim")] <= F.col("__cut"), F.col("__left")).otherwise(F.col("__right"))
        moved = base.join(table, "__node", "left").withColumn("__node", F.coalesce(goes, "__node"))
        base = saved(moved.select(base.columns), "kd")
    leaves += open_nodes
    numbers = _small(spark, [(n.number, n.first) for n in leaves], "__node int, shard int")
    return with_slots(base.join(numbers, "__node").select(*given, "shard"), id_col)


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table with a row or two a shard, broadcast where that is bounded."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= MOST_BROADCAST else table


def _cuts(base: DataFrame, widest: dict[int, int], target: dict[int, int], slack: int) -> dict[int, int]:
    """For each node the largest key that goes left, by refining the bin in which the target weight lies.

    The bins of a node, 2048 at most, are added up in one task; those of different nodes in different ones."""
    spark = base.sparkSession
    low = dict.fromkeys(widest, 0)  # keys below went left already
    below = dict.fromkeys(widest, 0)
    done: dict[int, int] = {}
    shift = KEY_BITS
    while len(done) < len(widest) and shift > 0:
        width, shift = shift, max(0, shift - STEP_BITS)
        todo = [n for n in widest if n not in done]
        asked = _small(spark, [(n, widest[n], low[n], target[n] - below[n]) for n in todo], "__node int, __dim int, __low long, __want long")
        key = F.col("__k")[F.col("__dim")]
        inside = base.join(asked, "__node").where(F.shiftright(key, width) == F.shiftright("__low", width)) if width < KEY_BITS else base.join(asked, "__node")
        bins = inside.groupBy("__node", "__want", F.shiftright(key, shift).alias("bin")).agg(F.sum("__w").alias("w"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        run = bins.withColumn("upto", F.sum("w").over(Window.partitionBy("__node").orderBy("bin"))).where(F.col("upto") >= F.col("__want"))
        first = run.groupBy("__node").agg(F.min_by(F.struct("bin", "w", "upto", "lo", "hi"), "bin").alias("x")).select("__node", "x.*")
        got = {r["__node"]: r for r in first.collect()}
        for n in todo:
            r = got.get(n)
            if r is None:
                done[n] = low[n] - 1
                continue
            begin, end = r["bin"] << shift, ((r["bin"] + 1) << shift) - 1
            over, under = r["upto"] - (target[n] - below[n]), (target[n] - below[n]) - (r["upto"] - r["w"])
            if min(over, under) <= slack or r["lo"] == r["hi"]:
                done[n] = end if over <= under else begin - 1
            else:
                below[n] += r["upto"] - r["w"]
                low[n] = begin
    return done


def with_slots(rows: DataFrame, id_col: str) -> DataFrame:
    """Number the rows of each shard from 0 without a gap; a shard is numbered in buckets of about SLOT_ROWS rows."""
    largest, many = rows.groupBy("shard").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, -(-largest // SLOT_ROWS))
    others = [F.col(c) for c in rows.columns if c != "shard"]
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*others), F.lit(buckets)))
    sizes = dealt.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inner = Window.partitionBy("shard", "__bucket").orderBy(id_col, *others)
    numbered = dealt.withColumn("__in", F.row_number().over(inner) - 1)
    slot = (F.col("__start") + F.col("__in")).cast("long").alias("slot")
    return numbered.join(F.broadcast(starts) if buckets * many <= MOST_BROADCAST else starts, ["shard", "__bucket"]).select(*others, "shard", slot)


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16), text_crc32 (unsigned), shard, slot of each document; shards are near equal in bytes.

    A null text has no bytes, and the CRC of the empty one. Equal texts stay in one shard unless a cut has to pass
    through them to keep the sizes. Each row of a repeated or null id is a row of the result with a slot of its own.
    An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    dims = text_dimensions(text, F.col(lang_col))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("content"), *[c.cast("double").alias(d) for d, c in dims.items()],
    )
    return kd_shards(narrow, "doc_id", "size", "content", list(dims), shards)
