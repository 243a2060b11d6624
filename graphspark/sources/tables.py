"""The star schema as a property graph: nodes (node_id, type, attrs, parent_id, tags) and edges (src, dst, edge_type, prob)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import attributes
from ..operators.graph import MANY_PAIRS, PAIRS_A_TASK, PropertyGraph

CODE = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "Event": 7, "Document": 8}
STEP = 10**12
#: Probability that an edge of a placed order leads on, by the order's status: fixed values.
PLACED = {"F": 100, "O": 50, "P": 10}


def node_key(kind: str, key: Column) -> Column:
    return F.lit(CODE[kind] * STEP) + key.cast("bigint")


#: type -> (table, key, parent as (type, key) or None, attributes as name -> (kind, column or expression))
NODES = {
    "Region": ("region", "r_regionkey", None, {"name": ("string", "r_name")}),
    "Nation": ("nation", "n_nationkey", ("Region", "n_regionkey"), {"name": ("string", "n_name")}),
    "Customer": ("customer", "c_custkey", ("Nation", "c_nationkey"), {"name": ("string", "c_name"), "acctbal": ("float", "c_acctbal"), "mktsegment": ("string", "c_mktsegment")}),
    "Supplier": ("supplier", "s_suppkey", ("Nation", "s_nationkey"), {"name": ("string", "s_name"), "acctbal": ("float", "s_acctbal")}),
    "Part": ("part", "p_partkey", None, {"name": ("string", "p_name"), "brand": ("string", "p_brand"), "parttype": ("string", "p_type"), "size": ("int", "p_size"), "retailprice": ("float", "p_retailprice"), "word": ("string[]", "split(p_name, ' ')"), "large": ("bool", "CASE WHEN p_size > 25 THEN true END")}),
    "Order": ("orders", "o_orderkey", ("Customer", "o_custkey"), {"status": ("string", "o_orderstatus"), "totalprice": ("float", "o_totalprice"), "orderdate": ("time", "o_orderdate"), "priority": ("string", "o_orderpriority")}),
    "Event": ("events", "event_id", ("Customer", "user_id"), {"eventtype": ("string", "event_type"), "ts": ("time", "ts"), "value": ("float", "value")}),
    "Document": ("documents", "doc_id", None, {"lang": ("string", "lang"), "source": ("string", "source"), "nchars": ("int", "n_chars")}),
}


EDGE_TYPES = ("InRegion", "InNation", "Placed", "Contains", "SuppliedBy", "Supplies", "Returned", "Did")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """Nodes of the types (all by default); a type reads its own table only."""
    parts = []
    for t in types or NODES:
        name, key, parent, attrs = NODES[t]
        columns = {a: (k, F.expr(c)) for a, (k, c) in attrs.items()}
        parent_id = node_key(parent[0], F.col(parent[1])) if parent else F.lit(None).cast("bigint")
        parts.append(table(spark, sf_dir, name).select(node_key(t, F.col(key)).alias("node_id"), F.lit(t).alias("type"), attributes(**columns).alias("attrs"), parent_id.alias("parent_id"), F.array().cast("array<string>").alias("tags")))
    return reduce(DataFrame.unionByName, parts)


def edge_rows(spark: SparkSession, sf_dir: str, *types: str) -> int:
    """How many edges of the types (all by default) there are at most, from the row counts of the files."""
    of = {"InRegion": ("nation",), "InNation": ("customer", "supplier"), "Placed": ("orders",), "Did": ("events",)}
    names = [name for t in types or EDGE_TYPES for name in of.get(t, ("lineitem",))]
    counts = {name: table(spark, sf_dir, name).count() for name in set(names)}
    return sum(counts[name] for name in names)


def edges(spark: SparkSession, sf_dir: str, *types: str, rows: int = 0) -> DataFrame:
    """Edges of the types (all by default), one row for each pair and type. rows: how many there are at most, if known; lines
    of an order are then told apart by as many tasks as they need, see graph.distinct_pairs()."""

    def read(name: str) -> DataFrame:
        lines = table(spark, sf_dir, name)
        if name != "lineitem" or rows <= MANY_PAIRS:
            return lines
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PAIRS_A_TASK))
        return lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag").repartition(n, "l_orderkey")

    edge = lambda df, a, ka, b, kb, t, prob: df.select(node_key(a, F.col(ka)).alias("src"), node_key(b, F.col(kb)).alias("dst"), F.lit(t).alias("edge_type"), prob.cast("int").alias("prob"))
    full = F.lit(100)
    placed = F.element_at(F.create_map(*[F.lit(x) for kv in PLACED.items() for x in kv]), F.col("o_orderstatus"))
    by_supplier = lambda lines: lines.repartition(-(-rows // PAIRS_A_TASK), "l_suppkey", "l_partkey") if rows > MANY_PAIRS else lines
    make = {
        "InRegion": lambda: edge(read("nation"), "Nation", "n_nationkey", "Region", "n_regionkey", "InRegion", full),
        "InNation": lambda: edge(read("customer"), "Customer", "c_custkey", "Nation", "c_nationkey", "InNation", full).union(edge(read("supplier"), "Supplier", "s_suppkey", "Nation", "s_nationkey", "InNation", full)),
        "Placed": lambda: edge(read("orders"), "Customer", "o_custkey", "Order", "o_orderkey", "Placed", placed),
        "Contains": lambda: edge(read("lineitem").select("l_orderkey", "l_partkey").distinct(), "Order", "l_orderkey", "Part", "l_partkey", "Contains", full),
        "SuppliedBy": lambda: edge(read("lineitem").select("l_orderkey", "l_suppkey").distinct(), "Order", "l_orderkey", "Supplier", "l_suppkey", "SuppliedBy", full),
        "Supplies": lambda: edge(table(spark, sf_dir, "lineitem").transform(by_supplier).groupBy("l_suppkey", "l_partkey").agg(F.max(F.when(F.col("l_returnflag") == "N", 100).otherwise(30)).alias("p")), "Supplier", "l_suppkey", "Part", "l_partkey", "Supplies", F.col("p")),
        "Returned": lambda: edge(read("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct(), "Order", "l_orderkey", "Part", "l_partkey", "Returned", F.lit(0)),
        "Did": lambda: edge(read("events"), "Customer", "user_id", "Event", "event_id", "Did", full),
    }
    return reduce(DataFrame.unionByName, [make[t]() for t in types or make])


def graph(spark: SparkSession, sf_dir: str, node_types: tuple[str, ...] = (), edge_types: tuple[str, ...] = ()) -> PropertyGraph:
    return PropertyGraph(nodes(spark, sf_dir, *node_types), edges(spark, sf_dir, *edge_types))


#: Nodes of a block of ring_links().
BLOCK = 25


def ring_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph on the customers, in blocks of 25: i to (i + 5) mod 25, and i to i + 1 for i below 4, of each block.
    Columns src, dst, edge_type, prob. There are as many customers as fill whole blocks."""
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("i"))
    at = F.col("i") % BLOCK
    link = lambda df, to: df.select(F.col("i").alias("src"), to.alias("dst"), F.lit("Link").alias("edge_type"), F.lit(100).alias("prob"))
    return link(n, F.col("i") - at + (at + 5) % BLOCK).union(link(n.where(at < 4), F.col("i") + 1))


def bought_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph that grows with the tables: customers to the parts they bought, parts to the customers who returned them."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    both = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    customer, part = node_key("Customer", F.col("o_custkey")), node_key("Part", F.col("l_partkey"))
    bought = both.select(customer.alias("src"), part.alias("dst"))
    returned = both.where("l_returnflag = 'R'").select(part.alias("src"), customer.alias("dst"))
    return bought.union(returned).distinct().select("src", "dst", F.lit("Bought").alias("edge_type"), F.lit(100).alias("prob"))
