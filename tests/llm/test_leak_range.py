"""The leak search over the whole range of edits that counts as near, against brute force."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from graphspark.llm import leaks


def edited(raw: bytes, n: int, rng: random.Random) -> str:
    b = list(raw)
    for _ in range(n):
        i, c = rng.randrange(len(b)), rng.choice(b"abcdefghijklmnopqrstuvwxyz")
        b[i : i + rng.randrange(2)] = [c] if rng.random() < 2 / 3 else []
    return bytes(b).decode("utf8", "ignore")


def normal(text: str) -> bytes:
    return leaks._normal(np.frombuffer(text.encode(), np.uint8)).tobytes()


def found(spark, docs, items):
    rows = leaks.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]): r["edits"] for r in rows.collect()}


@pytest.mark.parametrize("share", [0.02, 0.05, 0.1, 0.15, 0.19])
def test_recall_over_the_whole_range(spark, small, share):
    rng, docs = random.Random(5), {}
    items = list(enumerate(pq.read_table(f"{small}/benchmark.parquet").column("text").to_pylist()))
    fill = lambda: " ".join(f"{rng.choice('klmnop')}{rng.randrange(10**6)}" for _ in range(20))
    for d in range(3 * len(items)):
        raw = items[d % len(items)][1].encode()
        docs[d] = f"{fill()} {edited(raw, int(share * len(raw)), rng)} {fill()}"
    want = set()
    for d, t in docs.items():
        item = normal(items[d % len(items)][1]).rstrip(b" ")
        if leaks.best_match(item, normal(t), int(leaks.MAX_EDITS * len(item))):
            want.add((d, d % len(items)))
    got = found(spark, docs, items)
    assert len(want) >= 0.9 * len(docs) and len(want & set(got)) >= 0.9 * len(want)


def test_short_items_are_found_near(spark):
    items = [(0, "Name the river"), (1, "abcdefghij"), (2, "你好世界再见朋友")]
    docs = {0: "please nam the rivver here", 1: "xx abcdefgxij yy", 2: "xx你好世界很见朋友yy", 3: "nothing of that"}
    assert found(spark, docs, items) == {(0, 0): 2, (1, 1): 1, (2, 2): 2}


def test_long_items_and_blocks_of_items(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((300, 300, 12, 12, 40, 40))]
    docs = {k: f"{' '.join(word() for _ in range(50))} {edited(t.encode(), len(t) // 20, rng)} end" for k, t in items}
    want = {(k, k) for k in docs}
    assert set(found(spark, docs, items)) == want
    rows = leaks.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=2)
    assert {(r["doc_id"], r["item_id"]) for r in rows.collect()} == want


def test_many_at_once_equal_one_by_one():
    rng = random.Random(9)
    text = bytes(rng.choice(b"abcd") for _ in range(5000))
    for sizes in ((1, 5, 63, 64), (65, 127, 128), (129, 150, 192)):
        items = [bytes(rng.choice(b"abcd") for _ in range(rng.choice(sizes))) for _ in range(20)]
        which = np.array([rng.randrange(20) for _ in range(100)])
        lo = np.array([rng.randrange(4800) for _ in which])
        hi = np.minimum(5000, lo + np.array([rng.randrange(0, 400) for _ in which]))
        edits, end = leaks.best_matches(items, which, np.frombuffer(text, np.uint8), lo, hi)
        for k in range(len(which)):
            assert (edits[k], end[k]) == leaks.best_match(items[which[k]], text[lo[k] : hi[k]], 10**6)


def test_search_by_pieces_equals_the_whole_search():
    rng = random.Random(6)
    for _ in range(300):
        item, text = (bytes(rng.choice(b"abc ") for _ in range(rng.randrange(1, n))) for n in (16, 120))
        most = len(item) // 5
        want, got = leaks.best_match(item, text, most), leaks.anywhere(item, text, most)
        assert (want and want[0]) == (got and got[0])
