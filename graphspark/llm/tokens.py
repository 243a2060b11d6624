"""Files of token ids: canonical Huffman codes of limited length, in blocks that are decoded by table from checkpoints.

A folder of token files holds two Parquet tables. `codes` has the length of the code of each id that occurs; the codes
themselves follow from the lengths (canonical: shorter codes come first, equal lengths by id). `blocks` has one folder a
shard; shards, and blocks within a shard, follow each other in the order of the documents:

    shard int, block int    place of the block
    first long              ids of the shard before this block
    doc_ids array<..>       its documents, whole ones
    doc_tokens array<long>  ids of each
    marks binary            bits of each stretch of STRETCH ids, unsigned 16-bit little-endian: the checkpoints
    bits binary             the codes, most significant bit first, filled with zeros to a whole byte
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import remove, shared_dir
from ._store import partitions
from ._text import blocks

#: Bits of the longest code; more where so many ids could not have codes of their own.
LIMIT = 16
STRETCH = 256
#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 18
TEXT_BLOCK = 6_000_000
#: Pieces of text whose ids a task remembers.
CACHE = 600_000
#: Bytes of new pieces that the library gets as one string.
JOINED = 4_000

# Classes of code points: letters, numbers, others, white space but the space, the space, a text's end.
_L, _N, _O, _W, _S, _END = range(6)
#: Code points that are white space to every version of the pattern's engine.
_WHITE = (0x09, 0x0A, 0x0D)
#: Code points that some engines take for white space.
_RARE = (0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0x180E, 0x200B, 0xFEFF)
#: Suffixes that the pattern takes as pieces behind an apostrophe.
_SUFFIXES = ("s", "t", "m", "d", "re", "ve", "ll")


_kind, _odd, _known = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool), np.zeros(0x1100, bool)


def classes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point, and whether it is odd: new, or classed anew, since Unicode 3.2, or rare white space."""
    kinds, old = {"L": _L, "N": _N}, unicodedata.ucd_3_2_0.category
    for page in np.flatnonzero((np.bincount(codes >> 8, minlength=len(_known)) > 0) & ~_known).tolist():
        for c in range(page << 8, (page + 1) << 8):
            now, then = unicodedata.category(chr(c)), old(chr(c))
            _kind[c] = _W if c in _WHITE else _S if c == 0x20 else kinds.get(now[0], _O)
            _odd[c] = c not in (*_WHITE, 0x20) and (c in _RARE or then == "Cn" or now[0] == "Z" or kinds.get(now[0]) != kinds.get(then[0]))
        _known[page] = True
    return _kind[codes], _odd[codes]


def piece_starts(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a piece of the pattern begins at each code point; every text is followed by one of the class _END."""
    before = np.r_[np.uint8(_END), kind[:-1]]
    after = np.r_[kind[1:], np.uint8(_END)]
    white = (kind == _W) | (kind == _S)
    begins = np.where(white, (before != _W) & (before != _S), (before != kind) & (before != _S))
    begins |= white & (after <= _O)  # the last of white space goes with what follows, or stands alone
    begins |= kind == _END
    at = np.flatnonzero((codes == 0x27) & begins & (kind == _O) & (after == _L))
    if len(at):
        padded = np.r_[codes, 0, 0]
        for suffix in _SUFFIXES:
            mine = at[np.all([padded[at + 1 + k] == ord(c) for k, c in enumerate(suffix)], axis=0)]
            begins[mine + 1] = False
            begins[mine + 1 + len(suffix)] = True
    return begins


class Pieces(dict):
    """Ids of pieces of text by the tokenizers library, as little-endian 32-bit integers; those seen are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocab = self.tokenizer.get_vocab()
        self.most = max(vocab.values())
        self.bytes_of = np.zeros(self.most + 1, np.int64)
        for word, i in vocab.items():
            self.bytes_of[i] = len(word)  # a character a byte

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[bytes]) -> None:
        """Ask the library for new pieces: many in one string where each begins with a space or follows a line feed, so
        that the pattern parts them again; a string whose ids do not part there is asked for piece by piece."""
        alone, glued, bare = [], [], []
        for p in pieces:
            (alone if p.isspace() else glued if p[0] == 0x20 else bare).append(p)
        for group, between in ((glued, b""), (bare, b"\n")):
            strings, held, size = [[]], [], 0
            for p in group:
                if size > JOINED:
                    strings.append([])
                    size = 0
                strings[-1].append(p)
                size += len(p)
            held = [s for s in strings if s]
            for members, ids in zip(held, self.library([(between.join(s) + between).decode() for s in held]), strict=True):
                at = np.cumsum([len(p) + len(between) for p in members])
                reach = np.r_[0, np.cumsum(self.bytes_of[ids])]
                stops = np.searchsorted(reach, at - len(between))
                starts = np.searchsorted(reach, np.r_[0, at[:-1]])
                if reach[-1] != at[-1] or not (np.array_equal(reach[stops], at - len(between)) and np.array_equal(reach[starts], np.r_[0, at[:-1]])):
                    alone += members
                    continue
                raw = ids.tobytes()
                self.update((p, raw[a:b]) for p, a, b in zip(members, (4 * starts).tolist(), (4 * stops).tolist(), strict=True))
        for p, ids in zip(alone, self.library([p.decode() for p in alone]), strict=True):
            self[p] = ids.tobytes()

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """Ids of each text, and end_id after them."""
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        size = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(size + 1) - 1
        kind, odd = classes(codes)
        strange = np.logical_or.reduceat(odd, np.r_[0, ends[:-1] + 1])
        if strange.any():
            whole = iter(self.library([t for t, s in zip(texts, strange, strict=True) if s]))
            plain = iter(self.encode([t for t, s in zip(texts, strange, strict=True) if not s], end_id) if not strange.all() else [])
            return [np.append(next(whole), np.uint32(end_id)) if s else next(plain) for s in strange]
        kind[ends] = _END
        data = "\n".join([*texts, ""]).encode()
        raw = np.frombuffer(data, np.uint8)
        begins = np.flatnonzero(piece_starts(codes, kind))
        at = np.flatnonzero((raw & 0xC0) != 0x80)[begins]
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.r_[at, len(raw)].astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        offsets = np.frombuffer(pieces.dictionary.buffers()[1], np.int32)[: len(pieces.dictionary) + 1].tolist()
        distinct = pieces.dictionary.buffers()[2].to_pybytes()
        listed = [distinct[a:b] for a, b in zip(offsets, offsets[1:])]  # noqa: B905
        if len(self) > CACHE // 2:  # what was not asked for since the last time is forgotten
            self.old = dict(self)
            self.clear()
        new = [p for p in listed if p not in self]
        self.update((p, self.old[p]) for p in new if p in self.old)
        self.learn([p for p in new if p not in self.old])
        found = [*(self[p] for p in listed), np.array([end_id], "<u4").tobytes()]
        which = pieces.indices.to_numpy().copy()
        last = np.flatnonzero(kind[begins] == _END)
        which[last] = len(listed)
        each = np.array([len(f) // 4 for f in found], np.int64)
        flat, start = np.frombuffer(b"".join(found), "<u4"), np.cumsum(each) - each
        n = each[which]
        until = np.cumsum(n)
        ids = flat[np.repeat(start[which] - until + n, n) + np.arange(until[-1])]
        return np.split(ids, until[last][:-1])


_KEPT: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _KEPT:
        _KEPT[path] = Pieces(path)
    return _KEPT[path]


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of the optimal prefix code with no code over limit (package-merge); 0 for what does not occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    level, leaves = weights, []
    for _ in range(limit - 1):
        half = len(level) // 2 * 2
        both = np.r_[weights, level[0:half:2] + level[1:half:2]]
        sorted_ = np.argsort(both, kind="stable")
        level = both[sorted_]
        leaves.append(sorted_ < n)
    take, bits = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(leaves):
        own = int(is_leaf[:take].sum())
        bits[:own] += 1
        take = 2 * (take - own)
    bits[:take] += 1
    out[order] = bits
    return out


class Code:
    """The canonical code of given lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.most = int(self.lengths.max(initial=1))
        symbols = np.flatnonzero(self.lengths)
        self.symbols = symbols[np.argsort(self.lengths[symbols], kind="stable")]
        width = 1 << (self.most - self.lengths[self.symbols])
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[self.symbols] = ((np.cumsum(width) - width) >> (self.most - self.lengths[self.symbols])).astype(np.uint64)
        self._width = width
        self._both = self.codes << np.uint64(5) | self.lengths.astype(np.uint64)

    def table(self) -> np.ndarray:
        """32 times the symbol, and the length, of what begins with each `most` bits."""
        if not hasattr(self, "_table"):
            self._table = np.zeros(1 << self.most, np.uint32)
            self._table[: int(self._width.sum())] = np.repeat(self.symbols * 32 + self.lengths[self.symbols], self._width)
        return self._table

    def pack(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(marks, bits)."""
        found = self._both[ids]  # 32 times the code, and its length
        n = (found & np.uint64(31)).astype(np.int64)
        until = np.cumsum(n)
        at = until - n
        total = int(until[-1]) if len(ids) else 0
        words = np.zeros(total // 32 + 2, np.uint64)
        window = (found >> np.uint64(5)) << (64 - n - (at & 31)).astype(np.uint64)
        word = at >> 5
        for part, shift in ((window >> np.uint64(32), 0), (window & np.uint64(0xFFFFFFFF), 1)):
            if len(ids):
                begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                words[word[begins] + shift] |= np.bitwise_or.reduceat(part, begins)
        marks = np.diff(np.r_[at[::STRETCH], total]) if len(ids) else np.zeros(0, np.int64)
        return marks.astype("<u2").tobytes(), words.astype(">u4").tobytes()[: -(-total // 8)]

    def unpack(self, marks: bytes, bits: bytes, n: int) -> np.ndarray:
        """The n ids of a block; all stretches are read together, each from its checkpoint, an id at a time."""
        if not n:
            return np.zeros(0, "<u4")
        table = self.table()
        sizes = np.frombuffer(marks, "<u2").astype(np.int64)
        at = np.cumsum(sizes) - sizes
        raw = np.frombuffer(bits + bytes(STRETCH * self.most // 8 + 8), np.uint8).astype(np.uint32)
        ahead = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        out = np.empty((STRETCH, len(at)), "<u4")
        mask, over = np.uint32((1 << self.most) - 1), 32 - self.most
        for k in range(min(STRETCH, n)):
            seen = (ahead[at >> 3] >> (over - (at & 7)).astype(np.uint32)) & mask
            both = table[seen]
            out[k] = both
            at += both & np.uint32(31)
        return (out.T.ravel() >> np.uint32(5))[:n]


def _path(path: str | None) -> str:
    if path:
        return path
    from public_tokenizers import path as place

    return place("byte_bpe_50k.json")


#: How often the ids of a shard occur: a row of its own, with the block -1.
_COUNTS = pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())]))


def _blocks(tokenizer: str | None, end_id: int, kind: pa.DataType):
    names = ["shard", "block", "first", "doc_ids", "doc_tokens", "ids", "counts"]

    def run(batches):
        pieces = pieces_of(_path(tokenizer))
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        docs, held, size = [], [], 0
        counts = np.zeros(max(pieces.most, end_id) + 1, np.int64)

        def row(number, ids, counted):
            listed = pa.array([docs], pa.list_(kind)), pa.array([[len(h) for h in held]], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), *listed, pa.array([ids], pa.binary()), pa.array([counted], _COUNTS)], names=names)

        def made():
            ids = np.concatenate(held).astype("<u4")
            np.add(counts, np.bincount(ids, minlength=len(counts)), out=counts)
            return row(block, ids.tobytes(), None)

        for batch in batches:
            for part in blocks(batch, "text", TEXT_BLOCK):
                for doc, ids in zip(part.column("doc_id").to_pylist(), pieces.encode(part.column("text").to_pylist(), end_id), strict=True):
                    docs.append(doc)
                    held.append(ids)
                    size += len(ids)
                    if size >= BLOCK_IDS:
                        yield made()
                        docs, held, block, first, size = [], [], block + 1, first + size, 0
        if docs:
            yield made()
            docs, held = [], []
        used = np.flatnonzero(counts)
        yield row(-1, None, [{"id": i, "n": n} for i, n in zip(used.tolist(), counts[used].tolist(), strict=True)])

    return run


def _packed(lengths: bytes):
    def run(batches):
        code = Code(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                marks, bits = code.pack(np.frombuffer(row.column("ids")[0].as_py(), "<u4"))
                kept = [c for c in row.schema.names if c != "ids"]
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in kept), pa.array([marks]), pa.array([bits])], names=[*kept, "marks", "bits"])

    return run


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 2, shards: int | None = None, limit: int = LIMIT) -> str:
    """Write the ids of docs (doc_id, text) as token files in the folder path, which is returned; by default a new folder in
    the one that all executors share.

    tokenizer: a file of the tokenizers library with byte-level pieces, by default byte_bpe_50k.json of public_tokenizers.
    Ids are those of the library without special tokens; strings of special tokens in a text are ordinary text. Each
    document's ids are followed by end_id. Documents stand in ascending order of doc_id (null ids last, equal ids in the order of the table): they are
    dealt by ranges to `shards` shards (by default as many as the session has shuffle partitions), so that rows of one
    id can stand in several. Each shard encodes its sorted texts once; counts of ids are summed over all tasks (as many rows as
    the vocabulary has ids), the driver makes the code of them, and each block is coded by itself.

    Null text counts as empty and has the end id alone. An empty table gives a folder without blocks. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    n = shards or partitions(spark)
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_last("doc_id"), F.asc("row")]
    width = docs.schema["doc_id"].dataType.simpleString()
    arrow = pa.string() if width == "string" else pa.int32() if width == "int" else pa.int64()
    if width not in ("string", "int"):
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
        width = "bigint"
    place = f"shard int, block int, first long, doc_ids array<{width}>, doc_tokens array<long>"
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    raw, schema = f"{path}/raw", f"{place}, ids binary, counts array<struct<id:int,n:long>>"
    sorted_.mapInArrow(_blocks(tokenizer, end_id, arrow), schema).write.option("compression", "zstd").parquet(raw)
    rows = spark.read.schema(schema).parquet(raw)
    counted = rows.where("block = -1").select(F.inline("counts")).groupBy("id").agg(F.sum("n").alias("n")).collect()
    plain = rows.where("block >= 0").drop("counts")
    counts = np.zeros(max((r["id"] for r in counted), default=-1) + 1, np.int64)
    for r in counted:  # one for each id of the vocabulary at most
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, limit)
    used = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(used, "id int, length int").coalesce(1).write.parquet(f"{path}/codes")
    packed = plain.mapInArrow(_packed(lengths.tobytes()), f"{place}, marks binary, bits binary")
    packed.sortWithinPartitions("shard", "block").write.partitionBy("shard").option("compression", "none").parquet(f"{path}/blocks")
    remove(spark, raw)
    return path


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, bytes, dict[int, int]]:
    """The blocks of token files, the lengths of their codes, and the number of ids before each shard (a row a shard)."""
    listed = spark.read.schema("id int, length int").parquet(f"{path}/codes").collect()
    lengths = np.zeros(max((r["id"] for r in listed), default=-1) + 1, np.uint8)
    for r in listed:
        lengths[r["id"]] = r["length"]
    if not listed:
        return spark.createDataFrame([], "shard int, block int, first long, doc_ids array<long>, doc_tokens array<long>, marks binary, bits binary"), b"", {}
    found = spark.read.parquet(f"{path}/blocks")
    total = found.select("shard", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before, so_far = {}, 0
    for r in sorted(total.collect()):  # a row a shard
        before[r["shard"]] = so_far
        so_far += r["n"]
    return found, lengths.tobytes(), before


def _unpacked(lengths: bytes, before: dict[int, int], digests: bool):
    def run(batches):
        code = Code(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                sizes = np.array(row["doc_tokens"], np.int64)
                ids = code.unpack(row["marks"], row["bits"], int(sizes.sum()))
                until = np.cumsum(sizes)
                start = before[row["shard"]] + row["first"] + until - sizes
                each = np.split(ids, until[:-1])
                doc_ids = batch.column("doc_ids").slice(k, 1).flatten()
                last = pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()) if digests else pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start), pa.array(sizes), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

    return run


def _read(spark: SparkSession, path: str, digests: bool) -> DataFrame:
    found, lengths, before = read_blocks(spark, path)
    kind = found.schema["doc_ids"].dataType.elementType.simpleString()
    last = "ids_crc32 long" if digests else "ids array<int>"
    rows = found.select("shard", "first", "doc_ids", "doc_tokens", "marks", "bits")
    return rows.mapInArrow(_unpacked(lengths, before, digests), f"doc_id {kind}, start long, n_tokens long, {last}")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of every document of token files."""
    return _read(spark, path, False)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, and the CRC-32 of each document's ids as little-endian unsigned 32-bit integers."""
    return _read(spark, path, True)
