"""The graph as two DataFrames, and what needs no traversal: counts, degrees, lookups, pairs, set algebra of edges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame  # node_id, type, attrs, parent_id, tags
    edges: DataFrame  # src, dst, edge_type, prob

    def pairs(self, *types: str) -> DataFrame:
        """(src, dst, sets): the edges between two nodes as an array of (edge_type, prob), sorted."""
        e = self.edges.where(F.col("edge_type").isin(*types)) if types else self.edges
        return pairs_of(e)


def pairs_of(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.array_sort(F.collect_set(F.struct("edge_type", "prob"))).alias("sets"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


#: Pairs that one task tells apart, about, where there are many; a table of them takes some 100 bytes a pair.
PAIRS_A_TASK, MANY_PAIRS = 500_000, 2_000_000


def distinct_pairs(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(src, dst), each once. Where edges are known to be many rows, they are dealt by both ends to as many tasks as these
    need before any task gathers them, so that what a task holds does not grow with them."""
    pairs = edges.select("src", "dst")
    if rows is None or rows <= MANY_PAIRS:
        return pairs.distinct()
    return pairs.repartition(max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PAIRS_A_TASK)), "src", "dst").distinct()


def totals(graph: PropertyGraph, rows: int | None = None) -> DataFrame:
    """Number of nodes and of pairs with an edge. rows: how many edges there are at most, if known."""
    n = graph.nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("what"), "n")
    return n.union(distinct_pairs(graph.edges.where("src <> dst"), rows).agg(F.count(F.lit(1))).select(F.lit("pairs"), "*"))


def degrees(edges: DataFrame, end: str = "src", rows: int | None = None) -> DataFrame:
    """(node_id, n): number of distinct nodes at the other end. rows: how many edges there are at most, if known."""
    return distinct_pairs(edges, rows).groupBy(F.col(end).alias("node_id")).agg(F.count(F.lit(1)).alias("n"))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def directed(pairs: DataFrame, direction: str, carry: tuple[str, ...] = ("sets",)) -> DataFrame:
    """(u, v, src, dst, carry): what a step from u to v may use. direction: out, in or any."""
    out = pairs.select(F.col("src").alias("u"), F.col("dst").alias("v"), "src", "dst", *carry)
    back = pairs.select(F.col("dst").alias("u"), F.col("src").alias("v"), "src", "dst", *carry)
    return {"out": lambda: out, "in": lambda: back, "any": lambda: back.union(out)}[direction]()


def adjacency(nodes: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """(node_id, next): sorted array of distinct successors (or predecessors), empty for nodes without any."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    near = edges.groupBy(F.col(a).alias("node_id")).agg(F.array_sort(F.collect_set(b)).alias("next"))
    return nodes.select("node_id").join(near, "node_id", "left").withColumn("next", F.coalesce("next", F.array().cast("array<bigint>")))


def starts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without incoming edges."""
    return nodes.select("node_id").join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti")


def ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("node_id").join(edges.select(F.col("src").alias("node_id")), "node_id", "left_anti")


def islands(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    return ends(nodes, edges).join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti")


def without_leaves(edges: DataFrame) -> DataFrame:
    """Edges left when nodes with one neighbour are dropped, once."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    keep = both.groupBy(F.col("src").alias("x")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x")
    return edges.join(keep.withColumnRenamed("x", "src"), "src", "left_semi").join(keep.withColumnRenamed("x", "dst"), "dst", "left_semi")


def having_edge(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] = (), direction: str = "out", target: DataFrame | None = None, negate: bool = False) -> DataFrame:
    """Nodes with an edge of the types (any by default) to a node of target: a semi-join (anti-join when negated)."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    e = edges.where(F.col("edge_type").isin(*types)) if types else edges
    if target is not None:
        e = e.join(target.select(F.col("node_id").alias(b)), b, "left_semi")
    return nodes.join(e.select(F.col(a).alias("node_id")), "node_id", "left_anti" if negate else "left_semi")


def mark_edge(nodes: DataFrame, edges: DataFrame, name: str, types: tuple[str, ...] = (), direction: str = "out", target: DataFrame | None = None) -> DataFrame:
    """Add a Boolean column that is true where having_edge() would keep the node, for use under OR and NOT."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    e = edges.where(F.col("edge_type").isin(*types)) if types else edges
    if target is not None:
        e = e.join(target.select(F.col("node_id").alias(b)), b, "left_semi")
    marks = e.select(F.col(a).alias("node_id")).distinct().withColumn(name, F.lit(True))
    return nodes.join(marks, "node_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def ordered(nodes: DataFrame, by: Column, descending: bool = False, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Sort by a Column (missing first, last when descending; ties by id), then skip and limit; negative numbers count
    from the tail."""
    keys = [by.desc_nulls_last() if descending else by.asc_nulls_first(), F.col("node_id").asc()]
    tail = [by.asc_nulls_first() if descending else by.desc_nulls_last(), F.col("node_id").desc()]
    if skip < 0:
        return nodes.join(nodes.orderBy(*tail).limit(-skip).select("node_id"), "node_id", "left_anti")
    if limit is not None and limit < 0:
        return nodes.orderBy(*tail).limit(-limit)
    out = nodes.orderBy(*keys)
    out = out.offset(skip) if skip else out
    return out.limit(limit) if limit is not None else out


def find_one(nodes: DataFrame, wanted: DataFrame, attr: str) -> DataFrame:
    """wanted (key) joined with the node whose attribute has that text (ignoring case); keys with several nodes find none."""
    index = nodes.select("node_id", F.explode(F.col("attrs")[attr.lower()]).alias("v")).select("node_id", F.lower("v.s").alias("low")).distinct()
    single = index.groupBy("low").agg(F.min("node_id").alias("node_id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return wanted.withColumn("low", F.lower("key")).join(single, "low").drop("low")


def find_two(nodes: DataFrame, wanted: DataFrame, attr: str, other: str) -> DataFrame:
    """wanted (key, other_key) joined with the node that has both texts (ignoring case); pairs with several nodes find none."""
    texts = lambda a: F.array_distinct(F.transform(F.col("attrs")[a.lower()], lambda v: F.lower(v["s"])))
    index = nodes.select("node_id", F.explode(texts(attr)).alias("low"), texts(other).alias("seconds")).select("node_id", "low", F.explode("seconds").alias("low2"))
    single = index.groupBy("low", "low2").agg(F.min("node_id").alias("node_id"), F.count_distinct("node_id").alias("n")).where("n = 1").drop("n")
    return wanted.withColumn("low", F.lower("key")).withColumn("low2", F.lower("other_key")).join(single, ["low", "low2"]).drop("low", "low2")


def without_same_id(edges: DataFrame, nodes: DataFrame, attr: str = "objectsid", self_id: str = "S-1-5-10") -> DataFrame:
    """Edges but for those between nodes of one security id, from SELF, and loops: what is stored unless it is forced."""
    ids = nodes.select("node_id", F.lower(F.col("attrs")[attr][0]["s"]).alias("sid"))
    both = edges.join(ids.toDF("src", "sid_a"), "src", "left").join(ids.toDF("dst", "sid_b"), "dst", "left")
    same = F.coalesce(F.col("sid_a") == F.col("sid_b"), F.lit(False)) | F.coalesce(F.col("sid_a") == self_id.lower(), F.lit(False))
    return both.where((F.col("src") != F.col("dst")) & ~same).select(*edges.columns)


def locate(nodes: DataFrame, wanted: DataFrame, attrs: tuple[str, ...] = ("distinguishedname", "objectsid", "objectguid", "downlevellogonname", "samaccountname", "name")) -> DataFrame:
    """wanted (key) with the smallest node of the first attribute, in their order, that has the text (ignoring case)."""
    index = None
    for i, a in enumerate(attrs):
        one = nodes.select("node_id", F.lit(i).alias("rank"), F.explode(F.col("attrs")[a]).alias("v")).select("node_id", "rank", F.lower("v.s").alias("low"))
        index = one if index is None else index.union(one)
    best = index.groupBy("low").agg(F.min(F.struct("rank", "node_id")).alias("x")).select("low", "x.node_id")
    return wanted.withColumn("low", F.lower("key")).join(best, "low").drop("low")


def find_all(nodes: DataFrame, wanted: DataFrame, attr: str) -> DataFrame:
    index = nodes.select("node_id", F.explode(F.col("attrs")[attr.lower()]).alias("v")).select("node_id", F.lower("v.s").alias("low")).distinct()
    return wanted.withColumn("low", F.lower("key")).join(index, "low").drop("low")


def intersect_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges (src, dst, edge_type) of a that b has too."""
    return a.select("src", "dst", "edge_type").distinct().join(b.select("src", "dst", "edge_type"), ["src", "dst", "edge_type"], "left_semi")


def without_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges (src, dst, edge_type) of a that b does not have."""
    return a.select("src", "dst", "edge_type").distinct().join(b.select("src", "dst", "edge_type"), ["src", "dst", "edge_type"], "left_anti")


def top_value(rows: DataFrame, by: str, what: str) -> DataFrame:
    """(by, top): the most frequent `what` of each `by`, the last in order of equal ones."""
    n = rows.groupBy(by, what).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(by).agg(F.max_by(what, F.struct("n", what)).alias("top"))


def hubs(edges: DataFrame, more_than: int) -> DataFrame:
    """(node_id, n) of nodes with more than so many edges, in and out."""
    both = edges.select(F.col("src").alias("node_id")).union(edges.select("dst"))
    return both.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def children(nodes: DataFrame, parent: int) -> DataFrame:
    """(node_id, has_children) below a node."""
    mine = nodes.where(F.col("parent_id") == parent).select("node_id")
    inner = nodes.select(F.col("parent_id").alias("node_id")).where("node_id is not null").distinct().withColumn("has_children", F.lit(True))
    return mine.join(inner, "node_id", "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))


def merge_results(*results: DataFrame) -> DataFrame:
    """Union of result edges (src, dst, edge_types, flow): flows add up, types are united."""
    rows = reduce(DataFrame.unionByName, results)
    return rows.groupBy("src", "dst").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("edge_types")))).alias("edge_types"), F.sum("flow").cast("bigint").alias("flow"))


def word_list(nodes: DataFrame, attrs: tuple[str, ...], split: bool = True) -> DataFrame:
    """Distinct words of attributes; split at what is neither letter, digit nor underscore."""
    texts = nodes.select(F.explode(F.flatten(F.array(*[F.coalesce(F.col("attrs")[a], F.expr("array()").cast("array<struct<k:string,s:string,i:bigint,f:double,t:timestamp,b:boolean>>")) for a in attrs]))).alias("v")).select(F.col("v.s").alias("word"))
    if split:
        texts = texts.select(F.explode(F.split("word", r"[^\w]+")).alias("word"))
    return texts.select(F.trim("word").alias("word")).where("word <> ''").distinct()
