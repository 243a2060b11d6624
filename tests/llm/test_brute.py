"""What SQL cannot express: against the definition itself, on small texts."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from graphspark.llm import bpe, chat, jaccard, leaks, pii, queries, shards, urls
from graphspark.operators.algorithms import components


def texts_of(path):
    t = pq.read_table(f"{path}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t.column("doc_id").to_pylist(), (x or "" for x in t.column("text").to_pylist()), strict=True))


# ---- byte-level BPE ----
@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.vocabulary(str(path))


TEXT = st.text(st.one_of(st.sampled_from(" \n\t'sdmtrevl.,!1234abcXYZ\u00e9\u4f60\u0301\u00a0\u3000\u2028\u200b"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_encoding_equals_the_library(reference, texts):
    enc, vocab = reference
    got = bpe.encode_texts(texts, vocab)
    assert [x.tolist() for x in got] == [enc.encode_ordinary(t) for t in texts]
    assert [vocab.decode(x).decode() for x in got] == texts


def test_long_texts_encode_as_the_library(reference):
    enc, vocab = reference
    for t in ("it's " * 5000, "x" * 3000, " " * 2000 + "a", "\n \n" * 900 + "'ll 're", "1234567 " * 500):
        assert bpe.encode_texts([t], vocab)[0].tolist() == enc.encode_ordinary(t)


def test_whole_table_encodes_as_the_library(spark, small, reference):
    enc, _ = reference
    want = {d: np.array(enc.encode_ordinary(t), "<u4").tobytes() for d, t in texts_of(small).items()}
    for r in queries.op7_byte_bpe(spark, small).collect():
        assert r["ids_sha256"] == hashlib.sha256(want[r["doc_id"]]).hexdigest() and r["n_tokens"] * 4 == len(want[r["doc_id"]])


def test_decoding_and_offsets(spark):
    docs = spark.createDataFrame([(1, "it's 42\u4f60  ok\n"), (2, None), (3, "")], "doc_id long, text string")
    tokens = bpe.encode(docs)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(tokens).collect()} == {1: "it's 42\u4f60  ok\n", 2: "", 3: ""}
    for r in tokens.collect():
        assert len(r["offsets"]) == r["n_tokens"] and r["offsets"][:1] in ([], [0]) and r["offsets"] == sorted(r["offsets"])


# ---- chat ----
PIECES = st.text(st.sampled_from("<|>/s[]INST\\\n turnendsay"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_formatted_turns_read_back(turns):
    out = "".join(chat.format_turn(role, text)[0] for role, text in turns)
    assert chat.read_turns(out) == turns
    for control in ("</s>", "<s>", "[INST]", "[/INST]"):
        assert control not in out


def test_parts_become_placeholders():
    out, refs, (a, z) = chat.format_turn("user", ["<", {"type": "text", "text": "|turn|>"}, {"type": "image", "url": "u", "width": 29, "height": 28}, {"type": "audio", "id": "x", "seconds": 2}, {"type": "document", "path": "p", "pages": 3}, {"type": "odd", "k": 1}])
    assert refs == [("image", "u", 2), ("audio", "x", 50), ("document", "p", 1536)]
    assert out.count(chat.OPEN) == 1 and out[a:z].index("<|image:0|>") < out[a:z].index("<|audio:1|>") < out[a:z].index("<|document:2|>")
    assert chat.unescape(out[a:z]).startswith("<|turn|>")


def test_typed_turns(spark):
    rows = [(1, 0, "user", '[{"type": "text", "text": "see"}, {"type": "image", "url": "u"}]'), (1, 1, "assistant", '"ok"'), (None, 0, None, None)]
    got = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), typed=True).collect()
    assert sorted(r["attachment_tokens"] for r in got) == [0, 0, 256]
    assert chat.conversation_digests(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# ---- personal data ----
def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        double = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
        if 14 <= len(digits) <= 19 and (sum(double) + sum(digits[::-2])) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(a, z, k) for a, _, k, z in sorted(out)]


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("ab@.-+ ()0123456789%\u00e9\n"), max_size=60))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_the_table(small):
    for text in texts_of(small).values():
        assert pii.base_spans(text) == plain_spans(text)


def test_labels_spread_to_repeated_tokens():
    text = "call +44 20 7946 0958 today. Again, call 442079460958 today."
    weights = np.zeros((pii.FEATURES, pii.LABELS))
    tied = np.full((pii.LABELS, pii.LABELS), -3.0) + 6 * np.eye(pii.LABELS)
    base, every = pii.all_spans(text, pii.Field(weights, np.zeros((pii.LABELS, pii.LABELS)), tied))
    assert set(base) <= set(every) and (41, 53, "phone") in every


# ---- n-gram Jaccard join ----
def shingle_sets(texts):
    out = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        out[d] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return out


def brute_components(texts):
    sets, up = shingle_sets(texts), {}
    ids = sorted(texts)

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_join_equals_brute_force(spark, small):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op9_ngram_jaccard(spark, small).collect()}
    assert got == brute_components(texts_of(small))


@pytest.mark.parametrize("hot", [jaccard.HOT, 20])
def test_join_of_large_meetings(spark, hot):
    rng = random.Random(5)
    head = [f"h{i}" for i in range(12)]
    texts = {}
    for k in range(240):  # many sets that share a frequent head; chains of slowly changing tails
        tail = [f"t{k // 40}_{i}" for i in range(30)]
        for _ in range(rng.randint(0, 3)):
            tail[rng.randrange(30)] = f"x{rng.randrange(6)}"
        texts[k] = " ".join(head + tail)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame(spark, texts), hot=hot).collect()}
    assert got == brute_components(texts)


def test_copies_post_once_a_task():
    """The postings of a class do not grow with its copies: they meet before the shuffle."""

    class Shared:
        value = jaccard.Order(np.zeros(1 << jaccard.COUNT_BITS, np.uint64))

    def posted(copies):
        text = " ".join(f"w{i}" for i in range(200))
        batch = pa.RecordBatch.from_arrays([pa.array(range(copies), pa.int64()), pa.array([text] * copies)], names=["doc_id", "text"])
        return sum(len(x) // 16 for out in jaccard._prefixes(5, 8, Shared)([batch, batch]) for x in out.column("owner").to_pylist())

    assert posted(1) == posted(3000) == 196 - jaccard.needed(196) + 1


def test_order_loses_no_bit_and_counts_decide():
    rng = np.random.default_rng(3)
    count = rng.integers(0, 9, 1 << jaccard.COUNT_BITS).astype(np.uint64)
    count[5] = 10**6
    order = jaccard.Order(count, hot=1000)
    s = np.unique(np.r_[rng.integers(0, 2**63, 5000, dtype=np.uint64), np.uint64(5) << np.uint64(44)])
    placed = order.places(s)
    assert len(np.unique(placed)) == len(s) and placed[-1] >> np.uint64(44) == (1 << jaccard.COUNT_BITS) - 1
    seen = count[np.argsort(count, kind="stable")[(placed >> np.uint64(44)).astype(np.int64)]]
    assert (np.diff(seen.astype(np.int64)) >= 0).all() and order.first_hot == (1 << jaccard.COUNT_BITS) - 1 and order.salts.tolist() == [1000]


def test_prefix_tree_equals_brute_force():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(80)]
    tree = jaccard.PrefixTree(sets)
    for probe in sets:
        want = {(i, len(np.intersect1d(probe, s))) for i, s in enumerate(sets) if 100 * len(np.intersect1d(probe, s)) >= 75 * len(np.union1d(probe, s))}
        assert set(tree.linked(probe)) == want


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(5, 9), (9, 5), (7, 7)]
    got = {r["node_id"]: r["component"] for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), 5: 5, 9: 5, 7: 7}


# ---- benchmark decontamination ----
def edit_table(item, region):
    """Fewest edits between item and a substring of region, by the textbook recurrence."""
    row = np.zeros(len(region) + 1, np.int64)
    for i, c in enumerate(item):
        up = np.r_[i + 1, np.minimum(row[1:] + 1, row[:-1] + (np.frombuffer(region, np.uint8) != c))]
        row = np.minimum.accumulate(up - np.arange(len(up))) + np.arange(len(up))
    return int(row.min())


def test_best_match_is_the_edit_distance():
    rng = random.Random(3)
    for _ in range(200):
        item = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 70)))
        region = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90)))
        assert leaks.best_match(item, region, 10**6)[0] == edit_table(item, region)


def test_planted_passages_are_found(spark, small):
    bench = pq.read_table(f"{small}/benchmark.parquet")
    items = list(zip(bench.column("item_id").to_pylist(), bench.column("text").to_pylist(), strict=True))
    rng, docs, want = random.Random(11), {}, set()
    for k in range(120):
        fill = lambda: " ".join(f"{rng.choice('klmnop')}{rng.randrange(10**6)}" for _ in range(60))  # noqa: E731, B023
        item, text = rng.choice(items)
        w = text.split()
        if k % 3 == 1:  # a word in twenty changes, and all letters are capitals
            w = [f"{x}y" if rng.random() < 0.05 else x.upper() for x in w]
        docs[k] = f"{fill()} {' '.join(w)} {fill()}" if k % 3 < 2 else fill()
        if k % 3 < 2:
            want.add((k, item))
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & want) >= 0.98 * len(want)
    assert not {d for d, _ in got} & {k for k in docs if k % 3 == 2}


# ---- pipeline ----
def test_each_stage_against_brute_force(spark, small, duck, reference):
    enc, _ = reference
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    # quality: what is left are the documents of a score of at least 0.3 under the operator
    kept = corpus_pipeline.quality_stage(spark, docs, small)
    assert kept.columns == columns and 0 < kept.count() <= docs.count()
    # lines, by SQL on the stage's own input
    table = kept.toArrow()
    duck.register("documents_in", table)
    out = corpus_pipeline.line_stage(spark, kept, small).cache()
    sql = queries.ORACLE_SQL["op6_line_dedup"].replace("FROM documents)", "FROM documents_in)")
    want = {r[0]: r[1] for r in duck.sql(f"SELECT doc_id, text_sha256 FROM ({sql})").fetchall()}
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in out.collect()} == want and out.columns == columns
    # near duplicates
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    near = corpus_pipeline.near_duplicate_stage(spark, out, small).cache()
    assert {r["doc_id"] for r in near.collect()} == {d for d, (_, c) in brute_components(texts).items() if c == d} and near.columns == columns
    # leaks: all documents that hold an item as it stands go, no text changes
    left = corpus_pipeline.leak_stage(spark, near, small).cache()
    plain = lambda t: re.sub(r"[\x09-\x0D]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    items = [plain(t).rstrip(" ") for t in pq.read_table(f"{small}/benchmark.parquet").column("text").to_pylist()]
    rows = {r["doc_id"]: r["text"] for r in left.collect()}
    assert not [d for d, t in rows.items() if any(i in plain(t) for i in items)]
    assert left.columns == columns and all(texts[d] == t for d, t in rows.items())
    # tokens
    for r in corpus_pipeline.token_stage(spark, left, small).collect():
        assert r["n_tokens"] == len(enc.encode_ordinary(rows[r["doc_id"]]))


# ---- the cases that every operator has to stand ----
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, shard int, h long, sig long, n long, item_id long, site string, bucket int, removed string"


def odd_docs(spark):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    texts = [None, "", " \n\t ", "one", "the same five words here now", "the same five words here now", long, "mail a@b.co 4111 1111 1111 1111", "\x00\ufffd\U0001f600 '"]
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", None, 0.5, 1, 3, 7, 7, 7, 7, "x", 1, "r") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], rows[4]], EXTRA)


def no_docs(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.mark.parametrize("make", [odd_docs, no_docs])
def test_odd_tables(spark, make):
    from graphspark.llm import exact, lines, quality

    docs = make(spark)
    n = docs.count()
    labels = docs.select("doc_id", "label")
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one")], "item_id long, text string")
    assert shards.shard_documents(docs, 4).count() == n
    assert quality.score(docs, quality.fit(docs, labels), ["doc_id"]).count() == n
    assert exact.exact_dedup(docs).count() == n
    assert lines.remove_boilerplate(docs).count() == n
    assert lines.remove_boilerplate(docs, most_broadcast=-1).count() == n
    assert bpe.digests(docs).count() == n
    assert pii.find_personal_data(docs, pii.fit(docs)).count() == n
    found = jaccard.jaccard_components(docs)
    assert found.count() == n
    if n:
        assert {(r["doc_id"], r["component_id"]) for r in found.collect()} >= {(5, 4), (4, 4), (0, 0), (1, 1), (2, 2)}
    assert leaks.leaks(docs, items).count() == (1 if n else 0)
    assert leaks.leaks(docs, items.limit(0)).count() == 0


def test_both_ways_of_removing_lines(spark, small):
    from graphspark.llm import lines

    docs = spark.read.parquet(f"{small}/documents.parquet")
    digest = lambda df: sorted((r["doc_id"], r["text"], tuple(r["removed"]), r["n_lines"]) for r in df.collect())
    assert digest(lines.remove_boilerplate(docs)) == digest(lines.remove_boilerplate(docs, most_broadcast=-1))


def test_odd_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (4, "http://A.B/x?y"), (5, "http://"), (6, "x://a.b#/q")], "page_id long, url string")
    rules = spark.createDataFrame([("b", None, "block"), ("a.b", "/x", "allow")], "host string, path string, verdict string")
    keys = spark.createDataFrame([(None,), ("|",)], "key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.url_verdicts(pages, rules, keys).collect()}
    assert got[4] == ("a.b", "/x", "a.b/x", "allow") and got[6] == ("a.b", "", "b", "block")
    assert got[1] == got[2] == got[3] == ("", "", None, "block")  # the empty page is listed
    assert urls.url_verdicts(pages.limit(0), rules.limit(0), keys.limit(0)).count() == 0


def test_words_at_the_edges_of_texts():
    from graphspark.llm._text import words

    h, first, start, stop = words(pa.array(["a b", "b", None, "", "\tB a"]))
    assert first.tolist() == [0, 2, 3, 3, 3, 5] and h[0] == h[4] and h[1] == h[2] == h[3]
    assert stop.tolist() == [1, 3, 4, 6, 8]
