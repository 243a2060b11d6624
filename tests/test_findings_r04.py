"""What the findings of round 4 were about."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphspark import store
from graphspark.operators import paths
from graphspark.operators.graph import PropertyGraph
from graphspark.plans.pattern import Edge, Node, Pattern
from tests.test_traversal import queue


def wide(spark, seed, back):
    """Starts 0-11, each with a node of its own (20-31), in front of gates (40-44), in front of a random graph (60-79); `back`
    random links from that graph to starts and their nodes."""
    rng, pairs = random.Random(seed), set()
    for s in range(12):
        pairs |= {(s, 20 + s), (20 + s, 40 + s % 2), (20 + s, 43), (s, 42 + s % 3)}
    pairs |= {(g, n) for g in range(40, 45) for n in rng.sample(range(60, 80), 5)}
    pairs |= {(a, b) for a in range(60, 80) for b in rng.sample(range(60, 80), 2) if a != b}
    pairs |= {(rng.randrange(60, 80), rng.choice([*range(12), *range(20, 32)])) for _ in range(back)}
    links = defaultdict(dict)
    for a, b in pairs:
        links[a][b] = 1.0
    ids = sorted({n for pair in pairs for n in pair})
    graph = PropertyGraph(spark.createDataFrame([(i,) for i in ids], "node_id long"), spark.createDataFrame([(a, b, "Link", 100) for a, b in sorted(pairs)], "src long, dst long, edge_type string, prob int"))
    return graph, links, ids


def flows_of(links, starts, ends, most):
    flow = Counter()
    for way, n in queue(links, starts, [ends], [(1, most)], "shortest").items():
        for pair in zip(way, way[1:], strict=False):
            flow[pair] += n
    return dict(flow)


def got(result):
    return {(r["src"], r["dst"]): r["flow"] for r in result.edges.collect()}


@pytest.mark.parametrize("seed, back", [(1, 0), (4, 12)])
def test_starts_that_go_on_alike_are_counted_as_one(spark, monkeypatch, seed, back):
    """A class of starts has one set of rows; a start that the class would enter, or whose own nodes it enters, is counted alone."""
    monkeypatch.setattr(paths, "FEW_STARTS", 1, raising=False)
    written, keep = [], store.cut
    monkeypatch.setattr(paths, "cut", lambda df, name="step", **more: written.append((name, out := keep(df, name, **more))) or out)
    graph, links, ids = wide(spark, seed, back)
    ends = {i for i in ids if i % 3 != 2 and i >= 40}
    pattern = Pattern((Node(F.col("node_id") < 12), Edge((), "out", 1, 6), Node(F.col("node_id").isin(*ends))), traversal="shortest")
    assert got(paths.match(graph, pattern)) == flows_of(links, list(range(12)), ends, 6)
    if back:
        assert any(name == "apart" and df.take(1) for name, df in written)
    else:
        starts = [df.select("start").distinct().count() for name, df in written if name == "taken"]
        assert starts[0] == 12 and 0 < starts[2] <= 6, starts


def test_nodes_that_all_starts_see_alike_are_one(spark, monkeypatch):
    """Many machines behind a group, each with an account, are a row of a start, not one each."""
    monkeypatch.setattr(paths, "MANY_LINKS", 8, raising=False)
    written, keep = [], store.cut
    monkeypatch.setattr(paths, "cut", lambda df, name="step", **more: written.append((name, out := keep(df, name, **more))) or out)
    rng = random.Random(1)
    pairs = {(s, 100 + rng.randrange(3)) for s in range(10)} | {(s, rng.randrange(10)) for s in range(10) for _ in range(2)}
    pairs |= {(100, m) for m in range(200, 230)} | {(101, m) for m in range(215, 245)} | {(102, 100), (102, 101)}
    pairs |= {(m, m + (100 if m % 2 else -50)) for m in range(200, 245)}  # accounts, of larger and of smaller ids
    pairs |= {(m + (100 if m % 2 else -50), 400 + m % 2) for m in range(200, 245)} | {(400, 100), (401, 9), (100, 305), (100, 150)}
    pairs = {(a, b) for a, b in pairs if a != b}
    links = defaultdict(dict)
    for a, b in pairs:
        links[a][b] = 1.0
    ids = sorted({n for pair in pairs for n in pair})
    graph = PropertyGraph(spark.createDataFrame([(i,) for i in ids], "node_id long"), spark.createDataFrame([(a, b, "Link", 100) for a, b in sorted(pairs)], "src long, dst long, edge_type string, prob int"))
    pattern = Pattern((Node(F.col("node_id") < 10, "start"), Edge((), "out", 1, 6), Node(label="end")), traversal="shortest")
    result = paths.match(graph, pattern)
    want = flows_of(links, list(range(10)), set(ids), 6)
    assert got(result) == want
    assert {r["node_id"] for r in result.nodes.where("reference = 'end'").collect()} == {b for _, b in want}
    rows = max(df.groupBy("start").count().agg(F.max("count")).first()[0] for name, df in written if name in ("counted", "reached"))
    assert rows < 45  # 45 machines with as many accounts
