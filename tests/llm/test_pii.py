"""Personal data: time in proportion to the text, labels carried over any distance, marginals against enumeration."""

import itertools
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from graphspark.llm import pii, queries

from .test_brute import plain_spans


@pytest.mark.parametrize("unit", ["_@", "1", ".", "+", "1.1.1.", "a@b.", "+1 ", "1-", "11 ", "@", "1.1.1.1 ", "x", "a@b.co 1 "])
def test_a_megabyte_takes_seconds(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.process_time()
    spans = pii.base_spans(text)
    toks = pii.tokens(text, spans)
    pii.skip_edges(text, toks)
    assert time.process_time() - began < 20
    short = unit * 60
    assert pii.base_spans(short) == plain_spans(short)


def test_marginals_are_those_of_enumeration_on_trees():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = int(rng.integers(1, 6))
        node = rng.normal(size=(n, pii.LABELS))
        edges = [(int(rng.integers(0, i)), i, rng.normal(size=(pii.LABELS, pii.LABELS))) for i in range(1, n)]
        want = np.zeros((n, pii.LABELS))
        for y in itertools.product(range(pii.LABELS), repeat=n):
            p = np.exp(sum(node[i, y[i]] for i in range(n)) + sum(w[y[a], y[b]] for a, b, w in edges))
            for i in range(n):
                want[i, y[i]] += p
        want /= want.sum(1, keepdims=True)
        assert np.abs(pii.marginals(node, edges) - want).max() < 0.01


def test_labels_cross_any_number_of_edges():
    edges = [(i, i + 1) for i in range(0, 500, 2)] + [(i + 1, i + 2) for i in range(498, -2, -2)]
    assert pii.connected(600, edges, [0]) == set(range(501))
    text = "call +44 20 7946 0958 now. " + "x 5 y. " * 40 + "then 442079460958 and " * 60
    tied = np.full((pii.LABELS, pii.LABELS), -3.0) + 6 * np.eye(pii.LABELS)
    field = pii.Field(np.zeros((pii.FEATURES, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), tied)
    base, every = pii.all_spans(text, field)
    assert len(base) == 1 and sum(k == "phone" for _, _, k in every) == 61


def test_query_against_the_patterns(spark, small):
    import hashlib

    t = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"])
    want = {d: plain_spans(x or "") for d, x in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True)}
    rows = queries.op8_skip_chain_pii(spark, small).collect()
    assert len(rows) == len(want)
    for r in rows:
        base = want[r["doc_id"]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(pii.render(base).encode()).hexdigest()
        assert set(pii.render(base).split(",")) <= set(r["spans"].split(",")) and (base or not r["spans"])
