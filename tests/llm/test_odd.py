"""Repeated rows, null ids, both ways of joining, hinge loss, parts that are not well formed."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from graphspark.llm import chat, lines, quality, shards

DOCS = "doc_id long, text string, lang string, source string"


def lined(spark, rows, **kw):
    out = lines.remove_boilerplate(spark.createDataFrame(rows, DOCS), **kw).collect()
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"], tuple(r["removed"]), r["n_lines"]) for r in out)


def test_both_ways_of_removing_lines_give_the_same_rows(spark):
    rows = [
        (1, "a\nX\nX", "en", "s1"), (1, "X\nb", "en", "s2"), (1, "X\nb", "en", "s2"), (2, "X\nc", "en", "s3"), (None, "X\nY", "en", "s4"), (None, "Y\nd", "en", "s5"),
        (None, "Y", "en", None), (3, None, "en", "s1"), (4, "\n \nX", "en", "s1"),
    ]
    want = sorted([
        (1, "a\nX", (2,), 3), (1, "X\nb", (), 2), (1, "X\nb", (), 2), (2, "c", (0,), 2), (-1, "Y", (0,), 2), (-1, "Y\nd", (), 2), (-1, "Y", (), 1), (3, "", (), 1), (4, "\n ", (2,), 3),
    ])
    assert lined(spark, rows) == want == lined(spark, rows, most_broadcast=-1)
    one = lined(spark, [(1, "a\nb\na", "en", "s"), (2, "a\nc", "en", "s")], min_sites=1)
    assert one == [(1, "a\nb", (2,), 3), (2, "c", (0,), 2)] == lined(spark, [(1, "a\nb\na", "en", "s"), (2, "a\nc", "en", "s")], min_sites=1, most_broadcast=-1)


def test_many_removed_lines_of_one_text(spark):
    text = "\n".join(f"line {i % 500}" for i in range(20_000))
    rows = [(i, text, "en", f"s{i}") for i in range(3)]
    for way in (10**6, -1):
        got = lined(spark, rows, most_broadcast=way)
        assert [len(r[2]) for r in got] == [19_500, 20_000, 20_000]


def test_each_row_has_a_shard_and_a_slot(spark):
    rows = [(1, "a", "en", "s")] * 3 + [(None, "b", "en", "s")] * 3 + [(2, None, None, None), (3, "c" * 5000, "en", "s")] + [(k, f"text {k % 7}", "en", "s") for k in range(4, 60)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit(9)).withColumn("slot", F.lit(9)).withColumn("weight", F.lit(1))
    for n in (1, 4, 40):
        got = shards.shard_documents(docs, n).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
        by_shard: dict[int, list] = {}
        for r in got:
            by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and set(by_shard) <= set(range(n))
    assert shards.shard_documents(docs.limit(0), 4).count() == 0


def test_cuts_are_weighted_medians_and_keep_equal_texts_together(spark):
    """Two shards of one dimension: the cut is where half of the weight lies, to a thousandth of a leaf or one row."""
    rows = [(i, 1 + i % 50, hash(i // 3) & 0xFFFFFFFF, (i // 3) / 1000.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, w long, c long, x double")
    got = {r["id"]: r["shard"] for r in shards.kd_shards(df, "id", "w", "c", ["x"], 2).collect()}
    total = sum(r[1] for r in rows)
    left = sum(r[1] for r in rows if got[r[0]] == 0)
    assert abs(left - total / 2) <= total / 2 * 0.002 + 50
    last = max(i for i in got if got[i] == 0)
    assert all(got[i] == 0 for i in range(last - 3)) and all(got[i] == 1 for i in range(last + 1, 3000))
    copies = spark.createDataFrame([(i, 10, i // 10, 0.5) for i in range(2000)], "id long, w long, c long, x double")
    shard_of: dict[int, set] = {}
    for r in shards.kd_shards(copies, "id", "w", "c", ["x"], 8).collect():
        shard_of.setdefault(r["id"] // 10, set()).add(r["shard"])
    assert sum(len(s) > 1 for s in shard_of.values()) <= 7


def test_dual_descent_solves_the_hinge_problem():
    """Against subgradient steps on the primal problem with many more steps."""
    rng = np.random.default_rng(4)
    n, d = 60, 12
    rows = [np.sort(rng.choice(d, rng.integers(1, 7), replace=False)) for _ in range(n)]
    y = np.where(np.array([(0 in r) ^ (rng.random() < 0.2) for r in rows]), 1.0, -1.0)
    scale, cost = rng.normal(size=d), rng.uniform(0.5, 2.0, n)
    x = np.zeros((n, d + 1))
    for i, r in enumerate(rows):
        x[i, r] = scale[r]
        x[i, d] = 1

    def loss(w):
        return 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()

    w, b = quality._descend(rows, y, scale, cost, epochs=2000, enough=1e-9)
    got = loss(np.r_[w, b])
    v, best = np.zeros(d + 1), np.inf
    for t in range(1, 60_000):
        inside = y * (x @ v) < 1
        v = v - (v - ((cost * y * inside) @ x)) / t
        best = min(best, loss(v))
    assert got <= best * 1.0005 + 1e-6


def test_log_count_ratios_are_those_of_the_counts():
    found = [np.array([1, 2], np.int32), np.array([1], np.int32), np.array([2, 3], np.int32), np.array([3], np.int32)]
    w, _ = quality._fit(found, np.array([1.0, 1.0, -1.0, -1.0]), np.ones(4, bool))
    assert w[1] > 0 > w[3] and abs(w[2]) < 1e-9 and not w[[0, 4, 5]].any()


def test_parts_that_are_not_well_formed(spark):
    texts = [
        "{bad", '[{"type": "image", "width": "w", "height": 3}]', '[{"type": "audio", "seconds": "1e999"}, {"type": "audio", "seconds": -1}]', "[1, null, [2], {}]", "null", "17",
        '[{"type": "document", "pages": "x", "url": 5}]', '[{"type": ["image"]}]', '"\\ud800"', '{"type": "text", "text": "one"}', "[" * 5000,
    ]
    rows = [(1, i, "user", t) for i, t in enumerate(texts)] + [(1, 99, "assistant", None)]
    got = {r["turn"]: r for r in chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), typed=True).collect()}
    inside = {k: chat.unescape(r["formatted"][r["content_start"] : r["content_end"]]) for k, r in got.items()}
    assert len(got) == len(rows) and inside[0] == "{bad" and inside[4] == "null" and inside[5] == "17" and inside[8] == "�" and inside[9] == "one" and inside[10] == "[" * 5000
    assert [got[1]["attachment_tokens"], got[2]["attachment_tokens"], got[6]["attachment_tokens"]] == [256, 0, 512] and inside[99] == ""
    assert got[6]["attachments"][0]["ref"] == "5"


def test_many_attachments_take_linear_time():
    parts = [{"type": "image", "url": f"u{i}"} for i in range(50_000)]
    out, refs, _ = chat.format_turn("user", parts)
    assert len(refs) == 50_000 and out.endswith("<|image:49999|><|end|>\n")


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp

    words = lambda k: " ".join(f"w{k}_{i}" for i in range(40))
    item = " ".join(f"bench{i} mark" for i in range(20))
    rows = [
        (1, words(1), "en", "a", 5), (2, words(1) + " more", "en", "a", 5), (3, words(3), "en", "a", 5), (3, words(1), "en", "b", 5), (3, words(3), "en", "a", 5),
        (None, words(4), "en", "a", None), (None, words(1), None, None, None), (5, None, "en", "a", 0), (6, "", "en", "a", 0), (6, "", "en", "a", 0),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumn("row_id", F.lit(1)).withColumn("content", F.lit(1)).withColumn("score", F.lit(1))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "")[:4]) for r in df.collect())
    left = cp.near_duplicate_stage(spark, docs, str(tmp_path))
    assert key(left) == [(-1, "w4_0"), (1, "w1_0"), (3, "w3_0"), (3, "w3_0"), (5, ""), (6, ""), (6, "")] and tuple(left.columns) == cp.COLUMNS
    leaky = docs.union(spark.createDataFrame([(3, f"x {item} y", "en", "a", 1), (None, item, "en", "a", 1)], schema).selectExpr("*", "1", "1", "1"))
    assert key(cp.leak_stage(spark, leaky, str(tmp_path))) == key(docs)
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name not in ("n-gram Jaccard join",):
            assert stage(spark, docs, str(tmp_path)).count() == len(rows)
