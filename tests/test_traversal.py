"""Paths taken up one at a time, node limits and what the backward pass drops, against a queue in plain Python."""

import heapq
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphspark.operators import paths
from graphspark.operators.graph import PropertyGraph
from graphspark.plans.pattern import Edge, Node, Pattern

ORDER = {
    "shortest": lambda chances, way: (len(way), way[-1], way),
    "likely": lambda chances, way: (-chances[-1], len(way), way[-1], way),
    "longest": lambda chances, way: (-len(way), way[-1], way),
    "unlikely": lambda chances, way: (chances[-1], -len(way), way[-1], way),
}


def queue(links, starts, targets, positions, order, mode="ACYCLIC", limit=None, through=None):
    """Ways completed from each start. links: node -> {next: chance}; positions: (least, most) hops; targets: of each."""
    out = []
    for start in starts:
        held, todo = set(), []

        def push(way, chances, seg, hop):
            heapq.heappush(todo, (ORDER[order](chances, way), seg != len(positions), way, chances, seg, hop))

        push((start,), (1.0,), 0, 0)
        while todo and not (limit and len(held) >= limit):
            _, _, way, chances, seg, hop = heapq.heappop(todo)
            if seg == len(positions):
                held |= set(way)
                out.append(way)
                continue
            least, most = positions[seg]
            if least == 0 and hop == 0 and way[-1] in targets[seg]:
                push(way, chances, seg + 1, 0)
            for v, p in links.get(way[-1], {}).items():
                if v in way or (mode == "ACYCLIC" and v in held):
                    continue
                more = (*way, v), (*chances, chances[-1] * p)
                if hop + 1 >= least and v in targets[seg]:
                    push(*more, seg + 1, 0)
                if hop + 1 < most and (through is None or v in through):
                    push(*more, seg, hop + 1)
    return Counter(out)


def blocks(spark, seed, n_blocks=10, size=7):
    """Random graphs side by side; node 100 * b + i."""
    rng, rows = random.Random(seed), []
    for b in range(n_blocks):
        for i in range(size):
            rows += [(100 * b + i, 100 * b + j, "Link", rng.choice([100, 90, 50, 50, 30])) for j in rng.sample(range(size), rng.randint(0, 3)) if j != i]
    links: dict = {}
    for a, b, _, p in rows:
        links.setdefault(a, {})[b] = p / 100.0
    ids = [100 * b + i for b in range(n_blocks) for i in range(size)]
    nodes = spark.createDataFrame([(i,) for i in ids], "node_id long")
    return PropertyGraph(nodes, spark.createDataFrame(rows, "src long, dst long, edge_type string, prob int")), links, ids


def ways(graph, pattern):
    return Counter(tuple(r["visited"]) for r in paths.find_paths(graph, pattern).select("visited").collect())


def start():
    return Node(F.col("node_id") % 100 < 2)


def end():
    return Node(F.col("node_id") % 100 > 3)


@pytest.mark.parametrize("order", sorted(ORDER))
def test_order_of_one_position(spark, order):
    graph, links, ids = blocks(spark, 1)
    starts, ends = [i for i in ids if i % 100 < 2], {i for i in ids if i % 100 > 3}
    pattern = Pattern((start(), Edge(("Link",), max_hops=5), end()), traversal=order)
    assert ways(graph, pattern) == queue(links, starts, [ends], [(1, 5)], order)


@pytest.mark.parametrize("order", sorted(ORDER))
def test_node_limit(spark, order):
    graph, links, ids = blocks(spark, 2)
    starts, ends = [i for i in ids if i % 100 < 2], {i for i in ids if i % 100 > 3}
    for limit in (1, 4):
        pattern = Pattern((start(), Edge(("Link",), max_hops=4), end()), traversal=order, node_limit=limit)
        assert ways(graph, pattern) == queue(links, starts, [ends], [(1, 4)], order, limit=limit)
    pattern = Pattern((start(), Edge(("Link",), max_hops=3), Node()), mode="SIMPLE", traversal=order, node_limit=5)
    assert ways(graph, pattern) == queue(links, starts, [set(ids)], [(1, 3)], order, mode="SIMPLE", limit=5)


@pytest.mark.parametrize("order", ["shortest", "likely"])
def test_order_of_two_positions(spark, order):
    graph, links, ids = blocks(spark, 3)
    starts, mid, ends = [i for i in ids if i % 100 < 2], {i for i in ids if i % 2 == 0}, {i for i in ids if i % 100 > 3}
    inner = F.col("node_id") % 3 != 0
    pattern = Pattern((start(), Edge(("Link",), max_hops=2, through=inner), Node(F.col("node_id") % 2 == 0), Edge(("Link",), min_hops=2, max_hops=3, through=inner), end()), traversal=order)
    assert ways(graph, pattern) == queue(links, starts, [mid, ends], [(1, 2), (2, 3)], order, through={i for i in ids if i % 3})


@pytest.mark.parametrize("mode", ["ACYCLIC", "SIMPLE", "TRAIL"])
def test_what_cannot_end_is_not_lengthened(spark, mode, monkeypatch):
    """The same paths with and without the backward pass, and fewer rows with it."""
    graph, _, ids = blocks(spark, 4)
    inner = F.col("node_id") % 4 != 1
    six = Node(F.col("node_id") % 100 == 6)
    parts = (start(), Edge(("Link",), min_hops=2, max_hops=4, through=inner), Node(F.col("node_id") % 2 == 0), Edge(("Link",), min_hops=0, max_hops=2), six)
    got = ways(graph, Pattern(parts, mode=mode))
    monkeypatch.setattr(paths, "needs", lambda g, p, *_: [None] * len(p.edges))
    assert got == ways(graph, Pattern(parts, mode=mode)) and got


def test_needs_are_distances_to_the_end(spark):
    """A chain 0 -> 1 -> ... -> 9 with a dead end at each node: only the chain's nodes can end, each in so many hops."""
    rows = [(i, i + 1, "Link", 100) for i in range(9)] + [(i, 50 + i, "Link", 100) for i in range(9)]
    nodes = spark.createDataFrame([(i,) for i in [*range(10), *range(50, 59)]], "node_id long")
    graph = PropertyGraph(nodes, spark.createDataFrame(rows, "src long, dst long, edge_type string, prob int"))
    pattern = Pattern((Node(), Edge(("Link",), max_hops=4), Node(F.col("node_id") == 9)))
    sets = [paths.node_set(graph, n) for n in pattern.nodes]
    (need,) = paths.needs(graph, pattern, sets, [paths.steps(graph, pattern.edges[0])])
    assert {(r["v"], r["d"]) for r in need.collect()} == {(9 - d, d) for d in range(5)}
    assert ways(graph, pattern) == Counter({tuple(range(i, 10)): 1 for i in range(5, 9)})


def test_an_order_needs_paths():
    a = (Node(), Edge(), Node())
    for wrong in ({"traversal": "best"}, {"traversal": "shortest", "mode": "WALK"}, {"node_limit": 3}, {"traversal": "likely", "node_limit": 0}):
        with pytest.raises(ValueError):
            Pattern(a, **wrong)


def test_layered_paths_are_counted_not_listed(spark, monkeypatch):
    """Paths with a least accumulated probability over three kinds of nodes: the same with and without listing them."""
    rng = random.Random(6)
    rows = [(100 * k + i, 100 * k + 100 + j, "AB"[k], rng.choice([100, 50, 30])) for k in range(2) for i in range(8) for j in rng.sample(range(8), 4)]
    graph = PropertyGraph(spark.createDataFrame([(100 * k + i,) for k in range(3) for i in range(8)], "node_id long"), spark.createDataFrame(rows, "src long, dst long, edge_type string, prob int"))
    parts = (Node(F.col("node_id") < 100), Edge(("A",)), Node(), Edge(("B",)), Node())
    found = lambda **more: {(r["src"], r["dst"]): (tuple(r["edge_types"]), r["flow"]) for r in paths.match(graph, Pattern(parts, min_accumulated=0.3, **more)).edges.collect()}
    listed = found()
    monkeypatch.setattr(paths, "find_paths", None)
    assert found(layered=True) == listed and listed
    with pytest.raises(ValueError):
        Pattern((Node(), Edge(max_hops=2), Node()), layered=True)


def flows_of(counter):
    flow = Counter()
    for way, n in counter.items():
        for step in zip(way, way[1:], strict=False):
            flow[step] += n
    return dict(flow)


@pytest.mark.parametrize("ends", [0, 3, 5])
def test_shortest_paths_are_counted_not_listed(spark, monkeypatch, ends):
    """Flows and counts of "shortest" from rows a (start, hops, node); only starts with a tie are listed."""
    graph, links, ids = blocks(spark, 7 + ends, n_blocks=30)
    starts, targets = [i for i in ids if i % 100 < 2], {i for i in ids if i % 100 >= ends}
    pattern = Pattern((start(), Edge(("Link",), max_hops=5), Node(F.col("node_id") % 100 >= ends)), traversal="shortest")
    listed, plain = [], paths.best_first
    monkeypatch.setattr(paths, "best_first", lambda g, p: listed.append(paths.node_set(g, p.nodes[0]).count()) or plain(g, p))
    want = queue(links, starts, [targets], [(1, 5)], "shortest")
    assert {(r["src"], r["dst"]): r["flow"] for r in paths.match(graph, pattern).edges.collect()} == flows_of(want)
    counts = {r["start"]: (r["paths"], r["nodes"], r["hops"]) for r in paths.path_counts(graph, pattern).collect()}
    mine = lambda s: {way: n for way, n in want.items() if way[0] == s}
    assert counts == {s: (sum(mine(s).values()), len({v for way in mine(s) for v in way}), sum(n * (len(way) - 1) for way, n in mine(s).items())) for s in starts if mine(s)}
    assert all(n < len(starts) / 2 for n in listed) and (ends or not listed)
