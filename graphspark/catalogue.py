"""Registered queries of the property-graph engine and SQL that gives the same rows.

A query takes (spark, sf_dir) and reads whole tables. Its SQL runs on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names
from .functions import predicates as p
from .operators import algorithms as algo
from .operators import graph as g
from .functions.values import attributes
from .operators import merge, paths
from .plans.pattern import Edge, Node, Pattern
from .sources import sinks
from .sources.tables import STEP, bought_links, edge_rows, edges, graph, nodes, ring_links, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Edge types as SQL, for the queries that give the same rows.
K = STEP
EDGE_SQL = {
    "InRegion": f"SELECT 2*{K}+n_nationkey AS src, 1*{K}+n_regionkey AS dst, 'InRegion' AS edge_type, 100 AS prob FROM nation",
    "InNation": f"SELECT 3*{K}+c_custkey AS src, 2*{K}+c_nationkey AS dst, 'InNation' AS edge_type, 100 AS prob FROM customer UNION ALL SELECT 4*{K}+s_suppkey, 2*{K}+s_nationkey, 'InNation', 100 FROM supplier",
    "Placed": f"SELECT 3*{K}+o_custkey AS src, 6*{K}+o_orderkey AS dst, 'Placed' AS edge_type, CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 50 WHEN 'P' THEN 10 END AS prob FROM orders",
    "Contains": f"SELECT DISTINCT 6*{K}+l_orderkey AS src, 5*{K}+l_partkey AS dst, 'Contains' AS edge_type, 100 AS prob FROM lineitem",
    "SuppliedBy": f"SELECT DISTINCT 6*{K}+l_orderkey AS src, 4*{K}+l_suppkey AS dst, 'SuppliedBy' AS edge_type, 100 AS prob FROM lineitem",
    "Supplies": f"SELECT 4*{K}+l_suppkey AS src, 5*{K}+l_partkey AS dst, 'Supplies' AS edge_type, max(CASE WHEN l_returnflag='N' THEN 100 ELSE 30 END) AS prob FROM lineitem GROUP BY 1, 2",
    "Returned": f"SELECT DISTINCT 6*{K}+l_orderkey AS src, 5*{K}+l_partkey AS dst, 'Returned' AS edge_type, 0 AS prob FROM lineitem WHERE l_returnflag='R'",
    "Did": f"SELECT 3*{K}+user_id AS src, 7*{K}+event_id AS dst, 'Did' AS edge_type, 100 AS prob FROM events",
}
LINKS = (
    "SELECT c_custkey AS src, c_custkey - c_custkey % 25 + (c_custkey % 25 + 5) % 25 AS dst FROM customer "
    "UNION ALL SELECT c_custkey, c_custkey + 1 FROM customer WHERE c_custkey % 25 < 4"
)
CLOSURE = f"WITH RECURSIVE links AS ({LINKS}), reach(src, dst, hops) AS (SELECT DISTINCT src, src, 0 FROM links UNION SELECT r.src, l.dst, r.hops + 1 FROM reach r JOIN links l ON r.dst = l.src WHERE r.hops < 25), near AS (SELECT src, dst, min(hops) AS hops FROM reach GROUP BY src, dst)"


def e_sql(*types: str) -> str:
    return " UNION ALL ".join(f"({EDGE_SQL[t]})" for t in (types or EDGE_SQL))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _ids(df: DataFrame) -> DataFrame:
    return df.select("node_id")


def flat(edges_: DataFrame) -> DataFrame:
    """Result edges with their types as one text."""
    return edges_.select("src", "dst", F.array_join("edge_types", ",").alias("edge_types"), "flow")


# ---- counts ----
COUNT_SQL = " UNION ALL ".join(f"SELECT '{t}' AS type, count(*) AS n FROM {n}" for t, n in (("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"), ("Order", "orders"), ("Event", "events"), ("Document", "documents")))


@query(COUNT_SQL)
def node_count_by_type(spark, d):
    return g.count_by(nodes(spark, d).select("type"), "type")


@query(f"SELECT edge_type, count(*) AS n FROM ({e_sql()}) GROUP BY edge_type")
def edge_count_by_type(spark, d):
    return g.count_by(edges(spark, d), "edge_type")


@query(f"SELECT 'nodes' AS what, CAST(sum(n) AS BIGINT) AS n FROM ({COUNT_SQL}) UNION ALL SELECT 'pairs', count(*) FROM (SELECT DISTINCT src, dst FROM ({e_sql()}))")
def graph_totals(spark, d):
    rows = edge_rows(spark, d)
    return g.totals(g.PropertyGraph(nodes(spark, d), edges(spark, d, rows=rows)), rows)


@query(f"SELECT src AS node_id, count(*) AS n FROM (SELECT DISTINCT src, dst FROM ({e_sql()})) GROUP BY src")
def degree_out(spark, d):
    rows = edge_rows(spark, d)
    return g.degrees(edges(spark, d, rows=rows), rows=rows)


@query(f"SELECT dst AS node_id, count(*) AS n FROM (SELECT DISTINCT src, dst FROM ({e_sql()})) GROUP BY dst")
def degree_in(spark, d):
    rows = edge_rows(spark, d)
    return g.degrees(edges(spark, d, rows=rows), "dst", rows)


# ---- predicates ----
def predicate(name: str, kind: str, test: Callable, sql: str) -> None:
    def run(spark, d):
        return _ids(nodes(spark, d, kind).where(test()))

    run.__name__ = name
    query(sql)(run)


P, O, C = f"SELECT 5*{K}+p_partkey AS node_id FROM part WHERE ", f"SELECT 6*{K}+o_orderkey AS node_id FROM orders WHERE ", f"SELECT 3*{K}+c_custkey AS node_id FROM customer WHERE "
predicate("f_eq_ci", "Customer", lambda: p.equals("mktsegment", "building"), C + "lower(c_mktsegment) = 'building'")
predicate("f_exact", "Part", lambda: p.equals("word", "widget", exact=True) | p.equals("brand", "Brand#7", exact=True) | p.equals("brand", "brand#8", exact=True), P + "list_contains(string_split(p_name, ' '), 'widget') OR p_brand = 'Brand#7' OR p_brand = 'brand#8'")
predicate("f_present", "Part", lambda: p.present("large"), P + "p_size > 25")
predicate("f_glob", "Part", lambda: p.glob("name", "*WID?et"), P + "lower(p_name) LIKE '%wid_et'")
predicate("f_glob_prefix", "Part", lambda: p.glob("brand", "brand#1*"), P + "lower(p_brand) LIKE 'brand#1%'")
predicate("f_regex", "Part", lambda: p.regex("name", "^(cold|small) "), P + "regexp_matches(p_name, '^(cold|small) ')")
predicate("f_cmp_int", "Part", lambda: p.compare("size", "<=", 10), P + "p_size <= 10")
predicate("f_cmp_float", "Order", lambda: p.compare("totalprice", ">=", 100000.5), O + "o_totalprice >= 100000.5")
predicate("f_eq_number_text", "Part", lambda: p.equals("size", "24"), P + "p_size = 24")
predicate("f_cmp_time", "Order", lambda: p.since("orderdate", "<", "1998-01-01 00:00:00"), O + "o_orderdate < TIMESTAMP '1998-01-01'")
predicate("f_since_asof", "Order", lambda: p.since("orderdate", "<", "2001-06-15 12:00:00", years=-5), O + "o_orderdate < TIMESTAMP '1996-06-15 12:00:00'")
predicate("f_count", "Part", lambda: p.count("word", "=", 2), P + "len(string_split(p_name, ' ')) = 2")
predicate("f_count_missing", "Part", lambda: p.count("nothing", "=", 0), P + "true")
predicate("f_length", "Part", lambda: p.length("name", ">", 11), P + "strlen(p_name) > 11")
predicate("f_bit_and", "Part", lambda: p.bits_all("size", 6), P + "(p_size & 6) = 6")
predicate("f_bit_or", "Part", lambda: p.bits_any("size", 6), P + "(p_size & 6) <> 0")
predicate("f_any_attr", "Part", lambda: p.equals(None, "economy"), P + "lower(p_type) = 'economy' OR lower(p_name) = 'economy' OR lower(p_brand) = 'economy' OR list_contains(string_split(lower(p_name), ' '), 'economy')")
predicate("f_attr_glob", "Part", lambda: p.equals("b*d", "brand#7"), P + "lower(p_brand) = 'brand#7'")
predicate("f_any_value", "Part", lambda: p.equals("word", "Widget"), P + "list_contains(string_split(lower(p_name), ' '), 'widget')")
predicate("f_and_or_not", "Part", lambda: p.any_of(p.all_of(p.compare("size", ">", 20), p.equals("brand", "Brand#7")), ~p.glob("name", "*widget*") & p.compare("size", "<", 5)), P + "(p_size > 20 AND lower(p_brand) = 'brand#7') OR (NOT lower(p_name) LIKE '%widget%' AND p_size < 5)")
predicate("f_not_missing", "Part", lambda: ~p.equals("nothing", "x"), P + "true")
predicate("f_id", "Customer", lambda: p.node_id("<", 3 * K + 10), C + "c_custkey < 10")
predicate("f_not_equal", "Part", lambda: p.compare("size", "!=", 24) & ~p.equals("brand", "Brand#7"), P + "p_size <> 24 AND p_brand <> 'Brand#7'")
predicate("f_cmp_text", "Order", lambda: p.compare("priority", ">=", 3), O + "lower(o_orderpriority) >= '3'")
predicate("f_glob_class", "Part", lambda: p.glob("brand", "brand#[1-3]{,?}"), P + "regexp_full_match(lower(p_brand), 'brand#[1-3].?')")


@query(f"SELECT 3*{K}+c_custkey AS node_id FROM customer UNION ALL SELECT 2*{K}+n_nationkey FROM nation")
def f_type(spark, d):
    """Types are compared without regard to case, among nodes of several."""
    return _ids(nodes(spark, d, "Customer", "Supplier", "Nation").where(p.of_type("customer") | p.of_type("NATION")))


@query(O + "o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING o_orderdate < min(l_shipdate) - INTERVAL 20 DAY)")
def f_timediff(spark, d):
    """Orders placed more than 20 days before their first shipment."""
    shipped = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"))
    late = shipped.select((F.lit(6 * K) + F.col("l_orderkey")).alias("node_id"), attributes(shipped=("time", F.col("first"))).alias("more"))
    orders = nodes(spark, d, "Order").join(late, "node_id").withColumn("attrs", F.map_concat("attrs", "more"))
    return _ids(orders.where(p.time_difference("orderdate", "shipped", "<", days=-20)))


@query()
def f_hash100(spark, d):
    """About three of ten nodes, by a hash of their ids."""
    return _ids(nodes(spark, d, "Customer", "Order").where(p.random100("<", 30)))


@query(f"SELECT 3*{K}+c_custkey AS node_id FROM customer ORDER BY c_custkey LIMIT 7")
def f_limit(spark, d):
    return _ids(g.ordered(nodes(spark, d, "Customer"), F.col("node_id"), limit=7))


# ---- edge existence ----
@query(C + f"3*{K}+c_custkey IN (SELECT src FROM ({EDGE_SQL['Placed']}))")
def edge_exists_out(spark, d):
    return _ids(g.having_edge(nodes(spark, d, "Customer"), edges(spark, d, "Placed")))


@query(P + f"5*{K}+p_partkey IN (SELECT 5*{K}+l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice >= 400000)")
def edge_exists_in_sub(spark, d):
    target = nodes(spark, d, "Order").where(p.compare("totalprice", ">=", 400000))
    return _ids(g.having_edge(nodes(spark, d, "Part"), edges(spark, d, "Contains"), ("Contains",), "in", target))


@query(C + "c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 400000)")
def edge_not_exists(spark, d):
    dear = nodes(spark, d, "Order").where(p.compare("totalprice", ">=", 400000))
    return _ids(g.having_edge(nodes(spark, d, "Customer"), edges(spark, d, "Placed"), target=dear, negate=True))


@query(C + "lower(c_mktsegment) = 'building' OR c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def edge_exists_under_or(spark, d):
    bought = nodes(spark, d, "Event").where(p.equals("eventtype", "purchase"))
    marked = g.mark_edge(nodes(spark, d, "Customer"), edges(spark, d, "Did"), "bought", ("Did",), target=bought)
    return _ids(marked.where(p.equals("mktsegment", "building") | F.col("bought")))


# ---- order, skip, limit ----
def _price():
    return F.col("attrs")["retailprice"][0]["f"]


@query(f"SELECT 5*{K}+p_partkey AS node_id FROM part ORDER BY p_retailprice, p_partkey LIMIT 20")
def order_limit(spark, d):
    return _ids(g.ordered(nodes(spark, d, "Part"), _price(), limit=20))


@query(f"SELECT 5*{K}+p_partkey AS node_id FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 5")
def order_desc_skip(spark, d):
    return _ids(g.ordered(nodes(spark, d, "Part"), _price(), True, 5, 10))


@query(f"SELECT 5*{K}+p_partkey AS node_id FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 9")
def tail_limit(spark, d):
    return _ids(g.ordered(nodes(spark, d, "Part"), _price(), limit=-9))


# ---- hops ----
@query(EDGE_SQL["Placed"].replace(", 'Placed' AS edge_type", "").split(", CASE")[0] + " FROM orders")
def hop_out(spark, d):
    return g.directed(g.pairs_of(edges(spark, d, "Placed")), "out").select(F.col("u").alias("src"), F.col("v").alias("dst"))


@query(f"SELECT DISTINCT 5*{K}+l_partkey AS src, 4*{K}+l_suppkey AS dst FROM lineitem")
def hop_in(spark, d):
    return g.directed(g.pairs_of(edges(spark, d, "Supplies")), "in").select(F.col("u").alias("src"), F.col("v").alias("dst"))


@query(f"WITH e AS ({e_sql('InRegion', 'InNation')}) SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e")
def hop_any(spark, d):
    return g.directed(g.pairs_of(edges(spark, d, "InRegion", "InNation")), "any").select(F.col("u").alias("src"), F.col("v").alias("dst"))


# ---- paths ----
def _flagship_pattern() -> Pattern:
    start = Node(p.of_type("Customer") & p.equals("mktsegment", "BUILDING"), "start")
    return Pattern((start, Edge(("Placed",)), Node(p.compare("totalprice", ">=", 100000)), Edge(("Contains",)), Node(p.equals("brand", "Brand#7"), "end")))


_PATHS_SQL = f"""SELECT 3*{K}+c_custkey AS a, 6*{K}+o_orderkey AS b, 5*{K}+p_partkey AS c FROM customer JOIN orders ON o_custkey = c_custkey
    JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
    WHERE c_mktsegment = 'BUILDING' AND o_totalprice >= 100000 AND p_brand = 'Brand#7'"""
_FLAG_SQL = f"WITH paths AS ({_PATHS_SQL}) SELECT a AS src, b AS dst, 'Placed' AS edge_types, count(*) AS flow FROM paths GROUP BY 1, 2 UNION ALL SELECT b, c, 'Contains', count(*) FROM paths GROUP BY 1, 2"


def _flag(spark, d):
    return paths.match(graph(spark, d, ("Customer", "Order", "Part"), ("Placed", "Contains")), _flagship_pattern())


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return flat(_flag(spark, d).edges)


query(_FLAG_SQL)(flagship)


@query(f"WITH paths AS ({_PATHS_SQL}), n AS (SELECT a AS id, 'start' AS r FROM paths UNION SELECT b, NULL FROM paths UNION SELECT c, 'end' FROM paths) SELECT id AS node_id, r AS reference FROM n")
def result_labels(spark, d):
    return _flag(spark, d).nodes


@query(f"WITH paths AS ({_PATHS_SQL}) SELECT 'type' AS kind, 'Customer' AS name, count(DISTINCT a) AS n FROM paths UNION ALL SELECT 'type', 'Order', count(DISTINCT b) FROM paths UNION ALL SELECT 'type', 'Part', count(DISTINCT c) FROM paths UNION ALL SELECT 'label', 'start', count(DISTINCT a) FROM paths UNION ALL SELECT 'label', 'end', count(DISTINCT c) FROM paths UNION ALL SELECT 'total', 'edges', (SELECT count(*) FROM (SELECT DISTINCT a, b FROM paths)) + (SELECT count(*) FROM (SELECT DISTINCT b, c FROM paths))")
def result_by_type(spark, d):
    gr = graph(spark, d, ("Customer", "Order", "Part"), ("Placed", "Contains"))
    return paths.result_counts(paths.match(gr, _flagship_pattern()), gr.nodes)


#: The flow of each edge is a product of the ways to it from the start and from it to the end.
_MIXED_ALL_SQL = f"""WITH po AS (SELECT 3*{K}+c_custkey AS a, 6*{K}+o_orderkey AS b FROM customer JOIN orders ON o_custkey = c_custkey),
    op AS (SELECT DISTINCT 6*{K}+l_orderkey AS b, 5*{K}+l_partkey AS c FROM lineitem), ps AS (SELECT DISTINCT 5*{K}+l_partkey AS c, 4*{K}+l_suppkey AS s FROM lineitem),
    sn AS (SELECT 4*{K}+s_suppkey AS s, 2*{K}+s_nationkey AS n FROM supplier),
    c_on AS (SELECT c, count(*) AS m FROM ps JOIN sn USING (s) GROUP BY c), b_on AS (SELECT b, sum(m) AS m FROM op JOIN c_on USING (c) GROUP BY b),
    b_in AS (SELECT b, count(*) AS m FROM po GROUP BY b), c_in AS (SELECT c, sum(m) AS m FROM op JOIN b_in USING (b) GROUP BY c), s_in AS (SELECT s, sum(m) AS m FROM ps JOIN c_in USING (c) GROUP BY s)
    SELECT a AS src, b AS dst, 'Placed' AS edge_types, CAST(m AS BIGINT) AS flow FROM po JOIN b_on USING (b)
    UNION ALL SELECT b, c, 'Contains', CAST(b_in.m * c_on.m AS BIGINT) FROM op JOIN b_in USING (b) JOIN c_on USING (c)
    UNION ALL SELECT s, c, 'Supplies', CAST(c_in.m AS BIGINT) FROM ps JOIN c_in USING (c) JOIN sn USING (s)
    UNION ALL SELECT s, n, 'InNation', CAST(m AS BIGINT) FROM sn JOIN s_in USING (s)"""


@query(_MIXED_ALL_SQL)
def path_mixed_dir_4(spark, d):
    """Four hops in both directions from all customers. The positions' types differ, so that no walk can repeat a node and
    walks may be counted instead of listed."""
    gr = graph(spark, d, ("Customer", "Order", "Part", "Supplier", "Nation"), ("Placed", "Contains", "Supplies", "InNation"))
    kind = lambda t: Node(p.of_type(t))
    parts = (kind("Customer"), Edge(("Placed",)), kind("Order"), Edge(("Contains",)), kind("Part"), Edge(("Supplies",), "in"), kind("Supplier"), Edge(("InNation",)), kind("Nation"))
    return flat(paths.match(gr, Pattern(parts, mode="WALK")).edges)


def _ring_graph(spark, d):
    n = nodes(spark, d, "Customer").withColumn("node_id", F.col("node_id") - 3 * K)
    return g.PropertyGraph(n, ring_links(spark, d))


def _ring_paths(lo: int, hi: int, test: str, seed: str = "src % 25 = 0") -> str:
    """All paths from a seed with lo to hi hops, as lists of pairs, then the flow over each pair."""
    return f"""WITH RECURSIVE links AS ({LINKS}), walk(v, ns, es, h) AS (
        SELECT DISTINCT src, [src], CAST([] AS STRUCT(s BIGINT, d BIGINT)[]), 0 FROM links WHERE {seed}
        UNION ALL SELECT l.dst, list_append(ns, l.dst), list_append(es, {{'s': l.src, 'd': l.dst}}), h + 1 FROM walk JOIN links l ON walk.v = l.src WHERE h < {hi} AND {test}),
        e AS (SELECT unnest(es) AS x FROM walk WHERE h >= {lo}) SELECT x.s AS src, x.d AS dst, 'Link' AS edge_types, count(*) AS flow FROM e GROUP BY 1, 2"""


def _ring(mode: str, lo: int, hi: int):
    def run(spark, d):
        pattern = Pattern((Node(F.col("node_id") % 25 == 0), Edge(("Link",), min_hops=lo, max_hops=hi), Node()), mode=mode)
        return flat(paths.match(_ring_graph(spark, d), pattern).edges)

    return run


for _name, _mode, _test in (
    ("walk_flow", "WALK", "true"),
    ("trail_paths", "TRAIL", "NOT list_contains(es, {'s': l.src, 'd': l.dst})"),
    ("acyclic_paths", "ACYCLIC", "NOT list_contains(ns, l.dst)"),
    ("simple_paths", "SIMPLE", "NOT list_contains(ns, l.dst)"),
):
    _f = _ring(_mode, 1, 7)
    _f.__name__ = _name
    query(_ring_paths(1, 7, _test))(_f)
_f = _ring("ACYCLIC", 0, 3)
_f.__name__ = "path_zero_hop"
query(_ring_paths(0, 3, "NOT list_contains(ns, l.dst)"))(_f)
_f = _ring("ACYCLIC", 2, 3)
_f.__name__ = "path_repeat"
query(_ring_paths(2, 3, "NOT list_contains(ns, l.dst)"))(_f)


@query()
def acyclic_level(spark, d):
    pattern = Pattern((Node(F.col("node_id") % 25 == 0), Edge(("Link",), max_hops=4), Node()), dedup="level")
    return flat(paths.match(_ring_graph(spark, d), pattern).edges)


@query(f"WITH RECURSIVE links AS ({LINKS}) SELECT a.src AS src, a.dst AS dst, 'Link' AS edge_types, count(*) AS flow FROM (SELECT x.src, x.dst FROM links x JOIN links y ON x.dst = y.src WHERE x.src % 25 = 0 AND y.dst <> x.src AND x.dst <> y.dst AND x.dst % 25 < 5 UNION ALL SELECT y.src, y.dst FROM links x JOIN links y ON x.dst = y.src WHERE x.src % 25 = 0 AND y.dst <> x.src AND x.dst <> y.dst AND x.dst % 25 < 5) a GROUP BY 1, 2")
def path_node_requirement(spark, d):
    pattern = Pattern((Node(F.col("node_id") % 25 == 0), Edge(("Link",), min_hops=2, max_hops=2, through=F.col("node_id") % 25 < 5), Node()))
    return flat(paths.match(_ring_graph(spark, d), pattern).edges)


def _step_edges(gr, edge: Edge, a: Node, b: Node) -> DataFrame:
    return paths.match(gr, Pattern((a, edge, b))).edges.select("src", "dst")


_CR = f"SELECT src, dst, count(*) AS n, max(prob) AS prob FROM ({e_sql('Contains', 'Returned')}) GROUP BY src, dst"


@query(f"SELECT src, dst FROM ({_CR}) WHERE n >= 2")
def edge_match_two(spark, d):
    gr = graph(spark, d, ("Order", "Part"), ("Contains", "Returned"))
    return _step_edges(gr, Edge(("Contains", "Returned"), match=(">=", 2)), Node(p.of_type("Order")), Node(p.of_type("Part")))


@query(f"SELECT src, dst FROM ({EDGE_SQL['Contains']}) WHERE (src, dst) NOT IN (SELECT (src, dst) FROM ({EDGE_SQL['Returned']}))")
def edge_not(spark, d):
    gr = graph(spark, d, ("Order", "Part"), ("Contains", "Returned"))
    return _step_edges(gr, Edge(("Returned",), negate=True), Node(p.of_type("Order")), Node(p.of_type("Part")))


@query(f"SELECT src, dst FROM ({EDGE_SQL['Placed']}) WHERE prob >= 50")
def prob_exact(spark, d):
    gr = graph(spark, d, ("Customer", "Order"), ("Placed",))
    return _step_edges(gr, Edge(("Placed",), probability=(">=", 50)), Node(p.of_type("Customer")), Node(p.of_type("Order")))


@query(f"SELECT src, dst FROM ({EDGE_SQL['Supplies']}) WHERE prob < 100")
def prob_below(spark, d):
    gr = graph(spark, d, ("Supplier", "Part"), ("Supplies",))
    return _step_edges(gr, Edge(("Supplies",), probability=("<", 100)), Node(p.of_type("Supplier")), Node(p.of_type("Part")))


@query(f"WITH q AS (SELECT a.src AS a, a.dst AS b, s.src AS s, c.dst AS c FROM ({EDGE_SQL['Placed']}) a JOIN ({EDGE_SQL['Contains']}) c ON a.dst = c.src JOIN ({EDGE_SQL['Supplies']}) s ON s.dst = c.dst WHERE a.prob / 100.0 * (s.prob / 100.0) >= 0.5) SELECT a AS src, b AS dst, 'Placed' AS edge_types, count(*) AS flow FROM q GROUP BY 1, 2 UNION ALL SELECT b, c, 'Contains', count(*) FROM q GROUP BY 1, 2 UNION ALL SELECT s, c, 'Supplies', count(*) FROM q GROUP BY 1, 2")
def prob_accumulated(spark, d):
    """Paths of a least accumulated probability from all customers. The positions' types differ, so that no walk can repeat a
    node and paths may be counted instead of listed."""
    gr = graph(spark, d, ("Customer", "Order", "Part", "Supplier"), ("Placed", "Contains", "Supplies"))
    pattern = Pattern((Node(p.of_type("Customer")), Edge(("Placed",)), Node(p.of_type("Order")), Edge(("Contains",)), Node(), Edge(("Supplies",), "in"), Node()), min_accumulated=0.5, layered=True)
    return flat(paths.match(gr, pattern).edges)


@query(f"SELECT src, dst, 'Placed' AS edge_types, CAST(count(*) AS BIGINT) AS flow FROM (SELECT src, dst FROM ({EDGE_SQL['Placed']}) WHERE prob >= 50 UNION ALL SELECT 3*{K}+c_custkey, 6*{K}+o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING') GROUP BY 1, 2")
def union_queries(spark, d):
    gr = graph(spark, d, ("Customer", "Order"), ("Placed",))
    end = Node(p.of_type("Order"))
    a = paths.match(gr, Pattern((Node(p.of_type("Customer")), Edge(("Placed",), probability=(">=", 50)), end)))
    b = paths.match(gr, Pattern((Node(p.equals("mktsegment", "BUILDING")), Edge(("Placed",)), end)))
    return flat(paths.union(a, b).edges)


# ---- whole-graph operators ----
_CE = f"SELECT * FROM ({e_sql('Placed', 'InNation')})"


@query(C + f"false UNION ALL SELECT 6*{K}+o_orderkey FROM orders WHERE false UNION ALL SELECT 8*{K}+doc_id FROM documents")
def islands(spark, d):
    return g.islands(nodes(spark, d, "Customer", "Order", "Document"), edges(spark, d, "Placed", "InNation"))


@query(f"SELECT 3*{K}+c_custkey AS node_id FROM customer")
def starting_nodes(spark, d):
    return g.starts(nodes(spark, d, "Customer", "Order"), edges(spark, d, "Placed"))


@query(f"SELECT 6*{K}+o_orderkey AS node_id FROM orders UNION ALL SELECT 3*{K}+c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def ending_nodes(spark, d):
    return g.ends(nodes(spark, d, "Customer", "Order"), edges(spark, d, "Placed"))


@query(f"SELECT dst AS src, src AS dst, edge_type FROM ({EDGE_SQL['InRegion']})")
def transpose(spark, d):
    return g.transpose(edges(spark, d, "InRegion")).select("src", "dst", "edge_type")


@query(f"WITH links AS ({LINKS}) SELECT src AS node_id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS next FROM links GROUP BY src")
def adjacency(spark, d):
    gr = _ring_graph(spark, d)
    return g.adjacency(gr.nodes, gr.edges).select("node_id", F.array_join(F.transform("next", lambda x: x.cast("string")), ",").alias("next"))


@query(f"WITH links AS ({LINKS}), b AS (SELECT src AS x, dst AS y FROM links UNION SELECT dst, src FROM links), k AS (SELECT x FROM b GROUP BY x HAVING count(*) > 1) SELECT src, dst FROM links WHERE src IN (SELECT x FROM k) AND dst IN (SELECT x FROM k)")
def coarsen_leaves(spark, d):
    return g.without_leaves(ring_links(spark, d)).select("src", "dst")


@query(CLOSURE + " SELECT src, dst, hops FROM near")
def apsp_hops(spark, d):
    gr = _ring_graph(spark, d)
    return algo.hop_distances(gr.edges, gr.nodes)


@query(CLOSURE + " SELECT src AS seed, dst AS node_id, hops FROM near WHERE src % 25 = 2 AND hops <= 3")
def reach(spark, d):
    return algo.reach(ring_links(spark, d), _ring_graph(spark, d).nodes.where("node_id % 25 = 2"), 3)


_SCC = CLOSURE + ", scc AS (SELECT a.src AS node_id, min(a.dst) AS scc FROM near a JOIN near b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)"


@query(_SCC + " SELECT node_id, scc FROM scc")
def scc(spark, d):
    return algo.strongly_connected(ring_links(spark, d))


_DAG = _SCC + ", dag AS (SELECT DISTINCT a.scc AS src, b.scc AS dst FROM links JOIN scc a ON links.src = a.node_id JOIN scc b ON links.dst = b.node_id WHERE a.scc <> b.scc)"


@query(_DAG + " SELECT src, dst FROM dag")
def scc_dag(spark, d):
    e = ring_links(spark, d)
    return algo.condensation(e, algo.strongly_connected(e))


@query("SELECT c_custkey AS node_id, CAST(c_custkey % 25 AS INTEGER) AS level FROM customer WHERE c_custkey % 25 < 5")
def topo_level(spark, d):
    e = ring_links(spark, d)
    s = algo.strongly_connected(e)
    dag = algo.condensation(e, s)
    return algo.topological_levels(dag, s.select(F.col("scc").alias("node_id")).distinct())


@query(_DAG + " SELECT s.node_id, CAST(o.n + coalesce((SELECT sum(o2.n) FROM dag JOIN (SELECT scc, count(*) AS n FROM scc GROUP BY scc) o2 ON dag.dst = o2.scc WHERE dag.src = s.scc), 0) * (1 + o.n) AS BIGINT) AS power FROM scc s JOIN (SELECT scc, count(*) AS n FROM scc GROUP BY scc) o ON s.scc = o.scc")
def value_direct(spark, d):
    n = _ring_graph(spark, d).nodes
    return algo.propagate_value(ring_links(spark, d), n.select("node_id", F.lit(1).cast("bigint").alias("value")))


@query(CLOSURE + " SELECT src AS node_id, count(*) AS power FROM near GROUP BY src")
def value_transitive(spark, d):
    n = _ring_graph(spark, d).nodes
    return algo.propagate_value(ring_links(spark, d), n.select("node_id", F.lit(1).cast("bigint").alias("value")), "transitive")


@query()
def scc_bought(spark, d):
    """Components of a graph without a pattern, which grows with the tables."""
    return algo.strongly_connected(bought_links(spark, d))


@query()
def walk_bought(spark, d):
    """Walks of two and three steps from all customers over what they bought and who returned it."""
    gr = g.PropertyGraph(nodes(spark, d, "Customer", "Part"), bought_links(spark, d))
    return flat(paths.match(gr, Pattern((Node(p.of_type("Customer")), Edge(("Bought",), min_hops=2, max_hops=3), Node()), mode="WALK")).edges)


@query(f"WITH c AS (SELECT 3*{K}+c_custkey AS node_id, 2*{K}+c_nationkey AS nat FROM customer UNION ALL SELECT 4*{K}+s_suppkey, 2*{K}+s_nationkey FROM supplier UNION ALL SELECT 2*{K}+n_nationkey, 2*{K}+n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)) SELECT node_id, min(nat) OVER (PARTITION BY nat) AS component FROM c")
def components(spark, d):
    return algo.components(edges(spark, d, "InNation"))


@query(f"SELECT node_id, count(*) AS n FROM (SELECT src AS node_id FROM ({_CE}) UNION ALL SELECT dst FROM ({_CE})) GROUP BY node_id HAVING count(*) > 14")
def hubs(spark, d):
    return g.hubs(edges(spark, d, "Placed", "InNation"), 14)


@query()
def communities(spark, d):
    return algo.label_communities(ring_links(spark, d))


# ---- entity resolution and lookups ----
def _overlapping(spark, d) -> DataFrame:
    """Customers, and suppliers named as customers of the same number: two sources that share a merge key."""
    c = nodes(spark, d, "Customer")
    key = F.concat(F.lit("Customer#"), F.substring(F.col("attrs")["name"][0]["s"], 10, 20))
    s = nodes(spark, d, "Supplier").select("node_id", F.lit(None).cast("string").alias("type"), attributes(name=("string", F.lower(key)), acctbal=("float", F.col("attrs")["acctbal"][0]["f"])).alias("attrs"), "parent_id", "tags")
    return c.unionByName(s)


_MERGED = f"SELECT 3*{K}+c_custkey AS node_id, c_custkey AS k FROM customer UNION ALL SELECT CASE WHEN s_suppkey IN (SELECT c_custkey FROM customer) THEN 3*{K}+s_suppkey ELSE 4*{K}+s_suppkey END, s_suppkey FROM supplier"


@query(f"SELECT node_id, count(*) AS n FROM ({_MERGED}) GROUP BY node_id")
def merge_entities(spark, d):
    n = _overlapping(spark, d)
    m = merge.merge_map(n, ("name",))
    return n.join(m, "node_id", "left").groupBy(F.coalesce("into", "node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT node_id, count(DISTINCT b) AS n_balances FROM (SELECT 3*{K}+c_custkey AS node_id, c_acctbal AS b FROM customer UNION ALL SELECT CASE WHEN s_suppkey IN (SELECT c_custkey FROM customer) THEN 3*{K}+s_suppkey ELSE 4*{K}+s_suppkey END, s_acctbal FROM supplier) GROUP BY node_id")
def merge_attr_union(spark, d):
    n = _overlapping(spark, d)
    out = merge.merge_nodes(n, merge.merge_map(n, ("name",)))
    return out.select("node_id", F.size(F.col("attrs")["acctbal"]).cast("bigint").alias("n_balances"))


@query(f"WITH e AS ({EDGE_SQL['InNation']}) SELECT DISTINCT CASE WHEN src >= 4*{K} AND src - {K} IN (SELECT 3*{K}+c_custkey FROM customer) THEN src - {K} ELSE src END AS src, dst, edge_type FROM e")
def merge_edges(spark, d):
    n = _overlapping(spark, d)
    return merge.merge_edges(edges(spark, d, "InNation"), merge.merge_map(n, ("name",))).select("src", "dst", "edge_type")


@query("SELECT 'NATION_' || (n_nationkey + 20) AS key FROM nation WHERE 'NATION_' || (n_nationkey + 20) NOT IN (SELECT n_name FROM nation)")
def upsert_missing(spark, d):
    wanted = table(spark, d, "nation").select(F.concat(F.lit("NATION_"), (F.col("n_nationkey") + 20).cast("string")).alias("key"))
    return merge.missing_keys(nodes(spark, d, "Nation"), wanted, "name")


@query(f"SELECT c_name AS key, 3*{K}+c_custkey AS node_id FROM customer")
def find_one(spark, d):
    return g.find_one(nodes(spark, d, "Customer"), table(spark, d, "customer").select(F.col("c_name").alias("key")), "name")


@query(f"SELECT key, 5*{K}+p_partkey AS node_id FROM part JOIN (VALUES ('brand#7'), ('Brand#13')) v(key) ON lower(p_brand) = lower(key)")
def find_all(spark, d):
    return g.find_all(nodes(spark, d, "Part"), spark.createDataFrame([("brand#7",), ("Brand#13",)], "key string"), "brand")


@query(f"SELECT 3*{K}+c_custkey AS node_id, c_custkey IN (SELECT o_custkey FROM orders UNION SELECT user_id FROM events) AS has_children FROM customer WHERE c_nationkey = 3")
def tree_children(spark, d):
    return g.children(nodes(spark, d, "Customer", "Order", "Event"), 2 * K + 3)


_DN = "SELECT c_custkey, 'CN=' || c_name || ',OU=' || n_name || ',DC=' || r_name || ',DC=example' AS dn, 'OU=' || n_name || ',DC=' || r_name || ',DC=example' AS up, 'DC=' || r_name || ',DC=example' AS dom, lower(r_name) || '.example' AS suffix FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _dns(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select("c_custkey", F.concat(F.lit("CN="), "c_name", F.lit(",OU="), "n_name", F.lit(",DC="), "r_name", F.lit(",DC=example")).alias("dn"))


@query(f"SELECT c_custkey AS node_id, up AS parent_dn, dom AS domain, suffix FROM ({_DN})")
def dn_parent(spark, d):
    dom = names.dn_domain(F.col("dn"))
    return _dns(spark, d).select(F.col("c_custkey").alias("node_id"), names.dn_parent(F.col("dn")).alias("parent_dn"), dom.alias("domain"), names.domain_suffix(dom).alias("suffix"))


@query("WITH RECURSIVE t AS (SELECT c_custkey AS id, CASE WHEN c_custkey = 0 THEN NULL ELSE (c_custkey - 1) // 3 END AS up FROM customer), r(id, h) AS (SELECT id, 0 FROM t WHERE up = 1 UNION ALL SELECT t.id, h + 1 FROM t JOIN r ON t.up = r.id WHERE h < 10) SELECT DISTINCT id AS node_id FROM r")
def dn_chain(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"))
    dn = lambda x: F.concat(F.lit("CN=n"), x.cast("string"), F.lit(",DC=example"))
    rows = c.select("node_id", dn(F.col("node_id")).alias("dn"), F.when(F.col("node_id") > 0, dn(F.floor((F.col("node_id") - 1) / 3))).alias("points_to"))
    return algo.dn_chain(rows, "CN=N1,DC=example")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def collision_pairs(spark, d):
    return merge.collision_pairs(table(spark, d, "supplier"), "s_nationkey", "s_suppkey")


@query("SELECT user_id, arg_max(event_type, (n, event_type)) AS top FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id")
def top_user(spark, d):
    return g.top_value(table(spark, d, "events"), "user_id", "event_type")


@query("SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(x, '[^\\w]+')) AS word FROM (SELECT p_name AS x FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part)) WHERE word <> ''")
def word_list(spark, d):
    return g.word_list(nodes(spark, d, "Part"), ("name", "brand", "parttype"))


@query(f"WITH e AS ({e_sql('InRegion', 'InNation')}) SELECT 0 AS seq, src, dst, edge_type, prob FROM e WHERE src = 3*{K}+1 UNION ALL SELECT 1, src, dst, edge_type, prob FROM e WHERE src = (SELECT dst FROM e WHERE src = 3*{K}+1)")
def path_edge_details(spark, d):
    e = edges(spark, d, "InRegion", "InNation")
    a = e.where(F.col("src") == 3 * K + 1).select(F.lit(0).alias("seq"), F.col("src").alias("node_id"), F.col("dst").alias("next"))
    b = a.join(e.select(F.col("src").alias("next"), F.col("dst").alias("last")), "next")
    stops = a.select("seq", "node_id").union(b.select(F.lit(1), "next")).union(b.select(F.lit(2), "last"))
    return paths.path_details(g.PropertyGraph(nodes(spark, d, "Nation"), e), stops)


@query()
def elements_json(spark, d):
    r = _flag(spark, d)
    return sinks.elements(r.nodes, r.edges, nodes(spark, d, "Customer", "Order", "Part"))


@query(f"SELECT 2*{K}+n_nationkey AS node_id, '{{\"name\":[\"' || n_name || '\"]}}' AS json FROM nation")
def node_json(spark, d):
    return sinks.node_json(nodes(spark, d, "Nation"))


_WORD_SQL = " || '-' || ".join(f"CAST('0x' || substr(h, {8 * i + 7}, 2) || substr(h, {8 * i + 5}, 2) || substr(h, {8 * i + 3}, 2) || substr(h, {8 * i + 1}, 2) AS BIGINT)" for i in range(5))


@query(rf"WITH s AS (SELECT s_suppkey AS id, sha1(unhex(regexp_replace(hex(upper(s_name)), '(..)', '\100', 'g'))) AS h FROM supplier) SELECT id, 'S-1-5-80-' || {_WORD_SQL} AS sid FROM s")
def service_sids(spark, d):
    """The security ids of services that are called as the suppliers are."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), names.service_sid(F.col("s_name")).alias("sid"))
