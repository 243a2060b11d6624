"""The operators' queries against their SQL on the small tables, and the shape of all of them."""

import pytest

from graphspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(name, spark, duck, small, same):
    same(queries.QUERIES[name](spark, small), duck.sql(queries.ORACLE_SQL[name]))


def test_shards_are_near_equal_and_gapless(spark, duck, small):
    rows = queries.op1_kd_shards(spark, small).collect()
    want = {r[0]: r[1] for r in duck.sql("SELECT doc_id, strlen(coalesce(text, '')) + 16 FROM documents").fetchall()}
    assert {r["doc_id"]: r["size"] for r in rows} == want and len(rows) == len(want)
    by_shard: dict[int, list] = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r)
    assert set(by_shard) <= set(range(queries.SHARDS))
    for group in by_shard.values():
        assert sorted(r["slot"] for r in group) == list(range(len(group)))
    mean, largest = sum(want.values()) / queries.SHARDS, max(want.values())
    for group in by_shard.values():
        assert sum(r["size"] for r in group) <= 1.1 * mean + largest


def test_held_out_quality(spark, duck):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op2_nb_svm_quality(spark, sf).collect()}
    truth = duck.sql(f"SELECT doc_id, quality FROM read_parquet('{sf}/labels.parquet')").fetchall()
    held = [(got[d]["score"], q) for d, q in truth if d in got and got[d]["held_out"]]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
