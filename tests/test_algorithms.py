"""Algorithms without SQL for their results, against plain Python on small tables."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphspark import catalogue
from graphspark.operators import algorithms as algo
from graphspark.sources.tables import bought_links, ring_links


def edges_of(df):
    return [(r["src"], r["dst"]) for r in df.select("src", "dst").collect()]


def reachable(near, a):
    seen, todo = {a}, [a]
    while todo:
        for b in near[todo.pop()]:
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_components_of_the_bought_graph(spark, small):
    links = edges_of(bought_links(spark, small))
    near = defaultdict(list)
    for a, b in links:
        near[a].append(b)
    nodes = {x for e in links for x in e}
    to = {a: reachable(near, a) for a in nodes}
    want = {a: min(b for b in to[a] if a in to[b]) for a in nodes}
    got = {r["node_id"]: r["scc"] for r in catalogue.QUERIES["scc_bought"](spark, small).collect()}
    assert got == want and len(got) == len(nodes)


def test_walks_over_the_bought_graph(spark, small):
    links = edges_of(bought_links(spark, small))
    near = defaultdict(list)
    for a, b in links:
        near[a].append(b)
    customers = {a for a in range(3 * 10**12, 3 * 10**12 + 150)}
    flow = Counter()
    for a in customers:
        for b in near[a]:
            for c in near[b]:
                flow.update([(a, b), (b, c)])
                for e in near[c]:
                    flow.update([(a, b), (b, c), (c, e)])
    got = {(r["src"], r["dst"]): r["flow"] for r in catalogue.QUERIES["walk_bought"](spark, small).collect()}
    assert got == dict(flow)


def test_communities(spark, small):
    both = set()
    for a, b in edges_of(ring_links(spark, small)):
        both |= {(a, b), (b, a)}
    label = {a: a for a, _ in both}
    for _ in range(5):
        votes = defaultdict(Counter)
        for a, b in both:
            votes[a][label[b]] += 1
        label = {a: min(v, key=lambda c, v=v: (-v[c], c)) for a, v in votes.items()}
    assert {r["node_id"]: r["community"] for r in catalogue.QUERIES["communities"](spark, small).collect()} == label


def test_level_rule_on_rings(spark, small):
    """Paths that enter a node of a shorter completed path of the same start are dropped."""
    near = defaultdict(list)
    for a, b in edges_of(ring_links(spark, small)):
        near[a].append(b)
    flow = Counter()
    for s in sorted(a for a in near if a % 25 == 0):
        held, frontier = None, [(s,)]
        done = []
        for _ in range(4):
            grown = [(*p, b) for p in frontier for b in near[p[-1]] if b not in p and (held is None or b not in held)]
            done += grown
            held = {x for p in done for x in p}
            frontier = grown
        for p in done:
            flow.update(zip(p, p[1:], strict=False))
    got = {(r["src"], r["dst"]): r["flow"] for r in catalogue.QUERIES["acyclic_level"](spark, small).collect()}
    assert got == dict(flow)


def test_a_cycle_has_no_levels(spark):
    e = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    n = spark.createDataFrame([(1,), (2,)], "node_id long")
    with pytest.raises(algo.NotAcyclic):
        algo.topological_levels(e, n)


def test_hash_predicate_takes_its_share(spark, small):
    n = catalogue.QUERIES["f_hash100"](spark, small).count()
    assert 0.25 * 1650 < n < 0.35 * 1650


def brute_components(links, nodes):
    near = defaultdict(list)
    for a, b in links:
        near[a].append(b)
    to = {a: reachable(near, a) for a in nodes}
    return {a: min(b for b in to[a] if a in to[b]) for a in nodes}


def test_components_of_random_graphs(spark):
    """Sparse and dense graphs side by side, with chains, cycles, chains between nodes of one component, and loops."""
    import random

    rng, links = random.Random(5), []
    for block in range(30):
        n, base = rng.randint(2, 14), 1000 * block
        links += [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))]
        for k in range(rng.randint(0, 3)):  # a chain between any two nodes
            inner = [base + 100 * (k + 1) + i for i in range(rng.randint(1, 8))]
            way = [base + rng.randrange(n), *inner, base + rng.randrange(n)]
            links += list(zip(way, way[1:], strict=False))
    links += [(90_000 + i, 90_000 + (i + 1) % 9) for i in range(9)] + [(95_000, 95_000)]
    nodes = {x for e in links for x in e}
    df = spark.createDataFrame(links, "src long, dst long")
    got = {r["node_id"]: r["scc"] for r in algo.strongly_connected(df, spark.createDataFrame([(95_000,), (96_000,)], "node_id long")).collect()}
    want = brute_components([e for e in links if e[0] != e[1]], nodes | {96_000})
    assert got == want and len(set(want.values())) < len(want) - 20


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain and a cycle of 10,000 nodes, and a chain that comes back to a cycle."""
    n, rounds = 10_000, []
    monkeypatch.setattr(algo, "cut", lambda df, *a, f=algo.cut: (rounds.append(1), f(df, *a))[1])
    chain = spark.range(n - 1).select("id", (F.col("id") + 1).alias("next"))
    cycle = spark.range(n).select((F.col("id") + 20_000).alias("id"), ((F.col("id") + 1) % n + 20_000).alias("next"))
    ear = spark.createDataFrame([(20_005, 40_000), (40_000, 40_001), (40_001, 40_002), (40_002, 29_000), (9_999, 20_000)], "id long, next long")
    df = chain.union(cycle).union(ear).toDF("src", "dst")
    got = algo.strongly_connected(df)
    assert got.groupBy("scc").count().where("count > 1").collect() == [(20_000, n + 3)] and got.count() == 2 * n + 3
    assert len(rounds) < 60
    rounds.clear()
    assert algo.strongly_connected(chain.toDF("src", "dst")).where("node_id <> scc").count() == 0 and len(rounds) < 40


def test_an_empty_graph_has_no_components(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert algo.strongly_connected(none).count() == 0
    assert [tuple(r) for r in algo.strongly_connected(none, spark.createDataFrame([(3,)], "node_id long")).collect()] == [(3, 3)]


def test_states_are_carried_along(spark):
    """A walk that may take a red link once only, over a cycle."""
    links = spark.createDataFrame([(1, 2, "red"), (2, 3, "blue"), (3, 1, "blue"), (3, 4, "red"), (2, 2, "red")], "src long, dst long, colour string")
    seeds = spark.createDataFrame([(1, 0)], "node_id long, state int")
    step = lambda state: F.when(F.col("colour") == "blue", state).when(state == 0, F.lit(1))
    got = {tuple(r) for r in algo.reach_states(links, seeds, step).select("seed", "node_id", "state", "hops").collect()}
    assert got == {(1, 1, 0, 0), (1, 2, 1, 1), (1, 3, 1, 2), (1, 1, 1, 3)}
    assert algo.reach_states(links, seeds, step, 1).count() == 2 and algo.reach_states(links, seeds.limit(0), step).count() == 0
