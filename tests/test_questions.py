"""Ready-made questions and ordered paths over the tables' directory, against a queue in plain Python."""

from collections import Counter, defaultdict

import pytest

from graphspark import catalogue, questions
from graphspark.functions import predicates as p
from graphspark.operators import paths
from graphspark.operators.graph import PropertyGraph
from tests.test_traversal import queue


@pytest.fixture(scope="module")
def estate(spark, small):
    graph = questions.estate(spark, small)
    best: dict = defaultdict(int)
    for r in graph.edges.select("src", "dst", "prob").collect():
        best[r["src"], r["dst"]] = max(best[r["src"], r["dst"]], r["prob"])
    links = {"out": defaultdict(dict), "in": defaultdict(dict)}
    for (a, b), prob in best.items():
        if prob >= 1 and a != b:
            links["out"][a][b] = links["in"][b][a] = prob / 100.0
    return graph, links


def ids(graph, where):
    return {r["node_id"] for r in graph.nodes.where(where).select("node_id").collect()}


@pytest.mark.parametrize("name, direction", [("no_preauth_reach", "out"), ("reach_administrators", "in"), ("run_dcsync", "in"), ("controllers", "in")])
def test_answers(spark, small, estate, name, direction):
    graph, links = estate
    asked, pattern = questions.QUESTIONS[name](graph)
    starts, ends = ids(asked, pattern.nodes[0].where), ids(asked, pattern.nodes[1].where) if pattern.nodes[1].where is not None else ids(graph, p.any_of(p.node_id(">=", 0)))
    flow = Counter()
    for way, n in queue(links[direction], sorted(starts), [ends], [(1, 6)], "shortest").items():
        for a, b in zip(way, way[1:], strict=False):
            flow[(a, b) if direction == "out" else (b, a)] += n
    got = {(r["src"], r["dst"]): r["flow"] for r in catalogue.QUERIES[f"ask_{name}"](spark, small).collect()}
    assert got == dict(flow) and got


@pytest.mark.parametrize("name, order, limit", [("paths_shortest", "shortest", None), ("paths_likely", "likely", None), ("paths_node_limit", "shortest", 5)])
def test_ordered_paths(spark, small, estate, name, order, limit):
    graph, links = estate
    pattern = questions._ordered(order, limit)
    starts, ends = ids(graph, pattern.nodes[0].where), ids(graph, questions.person_or_group())
    want: dict = defaultdict(lambda: [0, set(), 0])
    for way, n in queue(links["out"], sorted(starts), [ends], [(1, 4)], order, limit=limit).items():
        row = want[way[0]]
        row[0] += n
        row[1] |= set(way)
        row[2] += n * (len(way) - 1)
    got = {r["start"]: (r["paths"], r["nodes"], r["hops"]) for r in catalogue.QUERIES[name](spark, small).collect()}
    assert got == {k: (n, len(nodes), hops) for k, (n, nodes, hops) in want.items()} and got


def test_all_questions_can_be_asked(spark, estate):
    graph, _ = estate
    assert len(questions.QUESTIONS) == 25
    asked = [ask(graph) for ask in questions.QUESTIONS.values()] + [questions.old_passwords(graph, "2024-01-01"), questions.many_groups(graph), questions.some_machines(graph, 3)]
    for on, pattern in asked:
        assert isinstance(on, PropertyGraph) and paths.node_set(on, pattern.nodes[0]).count() >= 0
    assert paths.match(*asked[-1]).nodes.count() == 3 and paths.match(*asked[-2]).nodes.count() == 0
