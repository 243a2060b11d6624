"""What the findings of round 3 were about."""

from collections import defaultdict

import pytest

from graphspark import questions, store
from graphspark.functions import predicates as p
from graphspark.operators import algorithms as algo
from graphspark.operators import graph as g
from graphspark.operators import paths
from graphspark.plans.pattern import Edge, Pattern
from graphspark.sources import directory as dr
from graphspark.sources import tables
from tests.test_traversal import blocks, end, queue, start


def test_attributes_are_made_by_many_tasks(spark, small):
    """However few files a table has: two tasks a core for accounts, machines and lists."""
    many = 2 * spark.sparkContext.defaultParallelism
    assert dr.directory(spark, small).rdd.getNumPartitions() >= 2 * many


def test_service_accounts_are_active(spark, small):
    graph = questions.estate(spark, small)
    found = graph.nodes.where(p.of_type("User") & p.present("serviceprincipalname") & questions.tag("account_active"))
    assert found.count() == spark.read.parquet(f"{small}/nation.parquet").count()


def test_many_pairs_are_dealt_to_more_tasks(spark):
    """A task tells apart so many pairs and no more, however many there are; the result is that of plain distinct rows."""
    edges = spark.range(1000).selectExpr("id % 100 as src", "id % 50 as dst")
    rows = 40 * g.PAIRS_A_TASK
    dealt = g.distinct_pairs(edges, rows)
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(dealt.collect()) == sorted(edges.distinct().collect())
    assert sorted(g.degrees(edges, "dst", rows).collect()) == sorted(g.degrees(edges, "dst").collect())


def test_many_lines_give_the_same_edges(spark, small):
    few, many = tables.edges(spark, small), tables.edges(spark, small, rows=g.MANY_PAIRS + 1)
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()
    assert few.count() <= tables.edge_rows(spark, small)


def tasks_of(spark, group: str, run) -> int:
    """How many tasks the jobs of run() have."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(i.numTasks for i in map(tracker.getStageInfo, stages) if i)


def test_components_of_few_links_take_few_tasks(spark):
    """The more partitions a shuffle has, the more tasks the driver keeps book of, unless what is small is gathered by few."""
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.range(40).selectExpr("id as src", "id + 1 as dst")
        found = []
        n = tasks_of(spark, "few-links", lambda: found.append(algo.components(links)))
        assert {r["component"] for r in found[0].collect()} == {0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was[1])
    assert n < 2000


def test_graphs_beside_each_other_take_one_round(spark, monkeypatch):
    """Six graphs without an edge between them: each has a pivot in the first round, and parts of it in no other's."""
    rounds, two_ways = [], algo._two_ways
    monkeypatch.setattr(algo, "_two_ways", lambda links, pivots: rounds.append(pivots.count()) or two_ways(links, pivots))
    edges = spark.range(60).selectExpr("id - id % 10 as base", "id % 10 as i", "explode(array(1, 3, 4)) as hop").selectExpr("base + i as src", "base + (i + hop) % 10 as dst")
    got = {r["node_id"]: r["scc"] for r in algo.strongly_connected(edges).collect()}
    assert got == {i: i - i % 10 for i in range(60)}
    assert rounds == [6]


@pytest.mark.parametrize("seed, most", [(3, 5), (7, 4), (11, 6)])
def test_likely_paths_are_counted_without_their_pairs(spark, monkeypatch, seed, most):
    """Neither pairs nor keys of all prefixes are carried along, and only paths that may be refused are decided in rounds."""
    monkeypatch.setattr(paths, "best_first", None)
    graph, links, ids = blocks(spark, seed, 14, 8)
    found = queue(links, [i for i in ids if i % 100 < 2], [{i for i in ids if i % 100 > 3}], [(1, most)], "likely")
    want: dict = defaultdict(lambda: [0, set(), 0])
    for way, n in found.items():
        row = want[way[0]]
        row[0], row[1], row[2] = row[0] + n, row[1] | set(way), row[2] + n * (len(way) - 1)
    pattern = Pattern((start(), Edge(("Link",), max_hops=most), end()), traversal="likely")
    got = {r["start"]: (r["paths"], r["nodes"], r["hops"]) for r in paths.path_counts(graph, pattern).collect()}
    assert got == {k: (n, len(nodes), hops) for k, (n, nodes, hops) in want.items()} and got


def test_values_of_many_nodes_are_not_broadcast(spark, monkeypatch):
    """What a join would broadcast passes through the driver: beyond so many rows both sides are dealt by the key."""
    monkeypatch.setattr(store, "MOST_SENT", 20, raising=False)
    edges = spark.range(100).selectExpr("id as src", "id - id % 10 + least(id % 10 + 1, 9) as dst").where("src <> dst")
    values = spark.range(100).selectExpr("id as node_id", "1L as value")
    made = algo.propagate_value(edges, values, "transitive")
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r["node_id"]: r["power"] for r in made.collect()} == {i: 10 - i % 10 for i in range(100)}
