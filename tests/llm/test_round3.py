"""Token files, runs of words and vector codes: against the library, brute force and round trips, and on odd tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from graphspark.llm import codes, queries, runs, tokens
from public_tokenizers import path as place
from pyspark.sql import functions as F
from tokenizers import Tokenizer

ODD = [
    (5, "one two"), (3, None), (None, "x's  y\n\n z"), (3, ""), (1, "ab " * 30_000), (None, None), (1, "ab " * 30_000), (7, " \t\n"), (2, "<|endoftext|> café 漢字  x 𝔘 ᲀ\x1c"),
]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").select("*", *[F.lit(c).alias(c) for c in ("shard", "start", "row", "ids", "n_words", "runs", "block")])


def library():
    found = Tokenizer.from_file(place("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def test_pieces_are_those_of_the_library():
    alphabet = ["a", "B", "s", "'", "'s", "'re", "'ll", "t", " ", "  ", "\n", "\t", "\r", "1", "23", "!", "..", "é", "漢", " ", "　", "ß", "\x00", "\x0b", "\x1c", "€", "½", "٣", "​", "😀", "ﬁ", "'S", "́", "ve", "�", "<|endoftext|>"]
    rng, pieces, own = random.Random(3), tokens.Pieces(place("byte_bpe_50k.json")), library()
    for _ in range(60):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(50)]
        want = [e.ids + [2] for e in own.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in pieces.encode(texts, 2)] == want


def test_pieces_are_asked_for_again_when_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    pieces, own = tokens.Pieces(place("byte_bpe_50k.json")), library()
    for texts in (["a b c d e"], ["e d x", "a b"], ["x y z a b c"]):
        assert [x.tolist() for x in pieces.encode(texts, 2)] == [e.ids + [2] for e in own.encode_batch(texts, add_special_tokens=False)]


def test_code_lengths_are_the_best_under_the_limit():
    """Against Huffman's tree where the limit does not bind, and all complete codes where it does."""
    import heapq

    rng = np.random.default_rng(1)
    for n in (2, 3, 10, 500):
        counts = rng.integers(1, 1000, n)
        heap = counts.tolist()
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert int((counts * tokens.code_lengths(counts, 18)).sum()) == cost

    def least(weights, limit):
        best = math.inf

        def go(k, room, cost):
            nonlocal best
            if k == len(weights):
                best = min(best, cost) if room >= 0 else best
                return
            for bits in range(1, limit + 1):
                if room >= 2 ** (limit - bits):
                    go(k + 1, room - 2 ** (limit - bits), cost + bits * weights[k])

        go(0, 2**limit, 0)
        return best

    for weights in ([1, 1, 2, 4, 8], [1, 2, 3, 50, 60, 70], [5, 5, 5, 5, 5]):
        got = tokens.code_lengths(np.array(weights), 3)
        assert got.max() <= 3 and int((got * weights).sum()) == least(weights, 3)
    assert tokens.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0] and tokens.code_lengths(np.ones(40, int), 2).max() == 6


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    for ids in (np.zeros(0, int), np.zeros(700, int), rng.zipf(1.3, 5000).clip(1, 40_000), np.arange(50_000)):
        code = tokens.Code(tokens.code_lengths(np.bincount(ids, minlength=50_000)))
        marks, bits = code.pack(ids)
        assert len(marks) == 2 * -(-len(ids) // tokens.STRETCH) and np.array_equal(code.unpack(marks, bits, len(ids)), ids)
        for k in range(0, len(ids), 10 * tokens.STRETCH):  # a stretch is read from its checkpoint alone
            n = k // tokens.STRETCH
            at = int(np.frombuffer(marks, "<u2")[:n].astype(int).sum())
            whole = np.unpackbits(np.frombuffer(bits, np.uint8))[at:]
            part = code.unpack(marks[2 * n : 2 * n + 2], np.packbits(whole).tobytes(), min(tokens.STRETCH, len(ids) - k))
            assert np.array_equal(part, ids[k : k + tokens.STRETCH])


def wanted_tokens(rows):
    own, start, out = library(), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = own.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_against_the_library(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op11_token_files(spark, small).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == wanted_tokens(docs)


@pytest.mark.parametrize("shards", [1, 3])
def test_token_files_of_odd_tables(spark, shards, monkeypatch, tmp_path):
    path = tokens.write_tokens(odd(spark).coalesce(1), str(tmp_path / "t"), shards=shards)
    assert sorted((tuple(r) for r in tokens.token_digests(spark, path).collect()), key=lambda r: r[1]) == wanted_tokens(ODD)
    read = {(r["start"], r["doc_id"]): r["ids"] for r in tokens.read_tokens(spark, path).collect()}
    own = library()
    assert read[(0, 1)] == own.encode(ODD[4][1], add_special_tokens=False).ids + [2]
    empty = tokens.write_tokens(odd(spark).limit(0), shards=shards)
    assert tokens.token_digests(spark, empty).count() == 0
    named = spark.createDataFrame([("b", "x"), ("a", "y z")], "doc_id string, text string")
    assert [(r["doc_id"], r["start"]) for r in tokens.token_digests(spark, tokens.write_tokens(named, shards=shards)).orderBy("start").collect()] == [("a", 0), ("b", 3)]


def brute_runs(w, min_length, min_exponent):
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            s, e = i, j + p
            if e - s >= max(min_length, min_exponent * p) and not any(all(w[k] == w[k + q] for k in range(s, e - q)) for q in range(1, p)):
                out.append((s, e - s, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 40), rng.randint(1, 3)
            w = [rng.randint(1, k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 4 + 1))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        least = rng.choice([(6, 4), (2, 2), (4, 3), (6, 2)])
        sizes = np.array([len(w) for w in texts])
        ends = np.cumsum(sizes + 1) - 1
        x, text = np.array([s for w in texts for s in [*w, 0]], np.int32), np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
        s, e, p = runs.runs(x, text, ends, *least)
        got = list(zip(s.tolist(), (e - s).tolist(), p.tolist(), strict=True))
        assert got == [(a + int(ends[k] - sizes[k]), b, c) for k, w in enumerate(texts) for a, b, c in brute_runs(w, *least)]


def test_next_smaller_of_a_comb():
    """Long chains are followed one by one after the common steps."""
    values = np.array([0, *range(5000, 0, -1), 7, 7, 3], np.int32)
    got = runs.next_smaller(values)
    want = [next((j for j in range(i + 1, len(values)) if values[j] < values[i]), len(values)) for i in (0, 1, 4999, 5001, 5002, 5003)]
    # equal values do not occur among ranks; of two equal ones the later counts as no smaller
    assert [int(got[i]) for i in (0, 1, 4999, 5003)] == [want[0], want[1], want[2], want[5]]


def test_word_runs_query_against_brute_force(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op12_word_runs(spark, small).collect()}
    assert set(got) == set(docs)
    seen = 0
    for doc, text in docs.items():
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc).encode())
        if h % 10 and n > 2500:
            continue  # brute force is quadratic; long texts without a planted tail are judged by the test above
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        numbers: dict[bytes, int] = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in words])
        found = []
        for p in range(1, n // 4 + 1):  # stretches where words p apart are the same
            same = np.flatnonzero(np.diff(np.r_[0, (ids[:-p] == ids[p:]).astype(int), 0]))
            found += [(int(s), int(e - s + p), p) for s, e in zip(same[::2], same[1::2], strict=True) if e - s + p >= max(6, 4 * p)]
        true = [r for r in found if not any(q < r[2] and r[2] % q == 0 and s <= r[0] and r[0] + r[1] <= s + ln for s, ln, q in found)]
        true.sort(key=lambda r: (r[0], r[2]))
        gone = {i for s, ln, p in true for i in range(s + p, s + ln)}
        row = got[doc]
        best = min(true, key=lambda r: (-r[1] / r[2], r[0], r[2])) if true else (None, None, None)
        seen += len(true)
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(true), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if true else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{ln},{p}\n" for s, ln, p in true).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    assert seen > 10


def test_runs_of_odd_tables(spark):
    got = sorted((repr(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.word_runs(odd(spark)).collect())
    want = []
    for doc, text in ODD:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want.append((repr(doc), 30_000, [(0, 30_000, 1)], "ab") if len(words) == 30_000 else (repr(doc), len(words), [], " ".join(words)))
    assert got == sorted(want)
    assert runs.word_runs(odd(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.word_runs(odd(spark), min_exponent=1)


VECTORS = "vec_id long, embedding array<float>, label int, code string, q int, error int, of_label int"


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * np.float64(np.float32(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[k * width : (k + 1) * width] for k in range(parts)] for _, v, _ in kept]
    books = [[list(c[k]) for c in cut[:entries]] for k in range(parts)]

    def near(k, point):
        return min((sum((a - b) ** 2 for a, b in zip(point, c, strict=True)), j) for j, c in enumerate(books[k]))

    for _ in range(rounds):
        for k in range(parts):
            groups: dict[int, list] = {}
            for c in cut:
                groups.setdefault(near(k, c[k])[1], []).append(c[k])
            for j, members in groups.items():
                books[k][j] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    out = []
    for (i, _, label), c in zip(kept, cut, strict=True):
        found = [near(k, c[k]) for k in range(parts)]
        out.append((i, label, tuple(f[1] for f in found), sum(f[0] for f in found)))
    return out, books


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i) // 2 if i % 7 == 0 else int(i), [float(np.float32(x)) for x in rng.normal(0, 1, 8).round(1)], int(i) % 3 or None) for i in range(300)]
    rows += [(None, [0.5] * 8, None), (-1, None, 1), (-2, [], 1), (-3, [float("nan")] * 8, 1), (-4, [1.0, None] * 4, 1), (-5, [float("inf")] * 8, 1)]
    rows += [(1000 + i, [0.25] * 8, 9) for i in range(300)]  # a vector that many rows repeat
    df = spark.createDataFrame([(i, v, label, "c", 1, 1, 1) for i, v, label in rows], VECTORS)
    for parts, entries, rounds in ((4, 5, 2), (2, 16, 3), (8, 64, 0), (4, 1000, 1)):
        done, books = codes.lloyd(df, parts=parts, entries=entries, rounds=rounds)
        want, book = brute_codes(rows, parts, min(entries, 601), rounds)
        kind = np.uint8 if books.shape[1] <= 256 else np.uint16
        got = sorted((repr(r["vec_id"]), repr(r["label"]), tuple(np.frombuffer(bytes(r["code"]), kind).tolist()), r["error"]) for r in done.collect())
        assert got == sorted((repr(i), repr(label), c, e) for i, label, c, e in want)
        assert books.tolist() == book
        digest = {repr(r["vec_id"]) + r["code"]: r["label_error"] for r in codes.code_digests(spark, done, books).collect()}
        for i, label, c, _ in want:
            assert digest[repr(i) + np.array(c, kind).tobytes().hex()] == sum(e for _, other, _, e in want if other == label)


def test_codes_of_odd_tables(spark):
    def made(rows):
        return spark.createDataFrame([(i, v, label, "c", 1, 1, 1) for i, v, label in rows], VECTORS)

    done, books = codes.lloyd(made([]))
    assert done.count() == 0 and codes.code_digests(spark, done, books).count() == 0 and books.shape == (16, 0, 0)
    done, books = codes.lloyd(made([(1, None, 1), (2, [None], 1)]))
    assert done.count() == 0
    done, books = codes.lloyd(made([(1, [1.0, 2.0, 3.0], 1), (2, [1.0] * 4, 1), (3, [1e30, -1e30, 0.0], 2)]), parts=2)  # filled, another length, clamped
    got = {r["vec_id"]: (bytes(r["code"]), r["error"]) for r in done.collect()}
    assert got == {1: (b"\x00\x00", 0), 3: (b"\x01\x01", 0)} and books[0].tolist() == [[256, 512], [codes.MOST, -codes.MOST]] and books[1].tolist() == [[768, 0], [0, 0]]


def test_nearest_is_exact_for_large_integers():
    book = np.array([[2**27, 0], [2**27 - 1, 0]])
    at, far = codes.nearest(np.array([[-(2**27), 1], [2**27, 2]]), book)
    assert at.tolist() == [1, 0] and far.tolist() == [(2**28 - 1) ** 2 + 1, 4]
