"""Path search: every hop is a join of the frontier with the pairs; results are sub-graphs, not rows of paths."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import COMPARE
from ..plans.pattern import Edge, Node, Pattern
from ..store import cut
from .graph import PropertyGraph, directed, ordered, pairs_of

#: Hops after which the lineage is cut.
CUT_EVERY = 3
#: Starts are merged where they are more than FEW_STARTS, after each of the first hops, if they have not shown too many nodes.
FEW_STARTS, MERGE_HOPS, MOST_SHOWN = 100, 3, 1_000
#: Nodes behind one with more than MANY_LINKS are told apart by their links, if they have no more than MOST_LINKS.
MANY_LINKS, MOST_LINKS, MOST_ROUNDS = 100, 1_000, 20


@dataclass(frozen=True)
class GraphResult:
    nodes: DataFrame  # node_id, reference
    edges: DataFrame  # src, dst, edge_types, flow


def node_set(graph: PropertyGraph, node: Node) -> DataFrame:
    """(node_id) of the nodes of one position."""
    out = graph.nodes if node.where is None else graph.nodes.where(node.where)
    if node.limit is not None or node.skip:
        out = ordered(out, node.order_by if node.order_by is not None else F.col("node_id"), node.descending, node.skip, node.limit)
    return out.select("node_id")


def _typed_pairs(edges: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(src, dst, n, edge_types, prob): pairs with an edge of the types, by one plain aggregate a type."""
    types = sorted(types)
    best = [F.max(F.when(F.col("edge_type") == t, F.col("prob"))).alias(f"p{i}") for i, t in enumerate(types)]
    pairs = edges.where(F.col("edge_type").isin(*types) & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(*best)
    probs = [F.col(f"p{i}") for i in range(len(types))]
    named = F.array_compact(F.array(*[F.when(p.isNotNull(), F.lit(t)) for p, t in zip(probs, types, strict=True)]))
    largest = probs[0] if len(probs) == 1 else F.greatest(*probs)
    return pairs.select("src", "dst", F.size(named).alias("n"), named.alias("edge_types"), largest.alias("prob"))


def _all_pairs(edges: DataFrame) -> DataFrame:
    """(src, dst, n, edge_types, prob) of all pairs with an edge."""
    pairs = edges.where("src <> dst").groupBy("src", "dst").agg(F.array_sort(F.collect_set("edge_type")).alias("edge_types"), F.max("prob").alias("prob"))
    return pairs.select("src", "dst", F.size("edge_types").alias("n"), "edge_types", "prob")


def steps(graph: PropertyGraph, edge: Edge, bare: bool = False) -> DataFrame:
    """(u, v, src, dst, edge_types, p): the steps an edge position allows. Only edges of the listed types are grouped
    into pairs, unless the position asks for their absence. bare: the types are not asked for, and not gathered where
    nothing depends on them."""
    if bare and not edge.types:
        none = F.array().cast("array<string>").alias("edge_types")
        pairs = graph.edges.where("src <> dst").groupBy("src", "dst").agg(F.max("prob").alias("prob")).select("src", "dst", none, "prob")
    elif edge.types and not edge.negate:
        pairs = _typed_pairs(graph.edges, edge.types)
        pairs = pairs.where(COMPARE[edge.match[0]](F.col("n"), F.lit(edge.match[1])))
    else:
        pairs = _all_pairs(graph.edges)
        if edge.types:
            pairs = pairs.where(~F.arrays_overlap("edge_types", F.array(*[F.lit(t) for t in edge.types])))
    pairs = pairs.where(COMPARE[edge.probability[0]](F.col("prob"), F.lit(edge.probability[1])))
    return directed(pairs.withColumn("p", F.col("prob") / 100.0), edge.direction, ("edge_types", "p"))


def _among(df: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    return df.join(nodes.select(F.col("node_id").alias(column)), column, "left_semi")


def _constrained(node: Node) -> bool:
    return node.where is not None or node.limit is not None or bool(node.skip)


def needs(graph: PropertyGraph, pattern: Pattern, sets: list[DataFrame], allowed: list[DataFrame]) -> list[DataFrame | None]:
    """For each edge position (v, d): the nodes from which it can be ended, and in how few hops d; None where any node can.

    A pass from the last position to the first: the ends of a position are its target's nodes from which the next one can be
    ended; each layer adds the nodes one step before those of the last. A path at v after h hops of the position leads
    nowhere unless h + d is within max_hops, so that only rows which can still end (but for what paths may not repeat)
    are lengthened. A layer has a row a node; layers end when nothing is new."""
    found: list[DataFrame | None] = [None] * len(pattern.edges)
    after: DataFrame | None = None
    for seg in range(len(pattern.edges) - 1, -1, -1):
        edge = pattern.edges[seg]
        ends = sets[seg + 1] if _constrained(pattern.nodes[seg + 1]) else None
        if after is not None:
            ends = after if ends is None else ends.join(after, "node_id", "left_semi")
        if ends is None:
            continue
        inner = graph.nodes.where(edge.through).select(F.col("node_id").alias("v")) if edge.through is not None else None
        layer = cut(ends.select(F.col("node_id").alias("v")).distinct().withColumn("d", F.lit(0)), "needs")
        total = layer
        for d in range(1, edge.max_hops + 1):
            on = layer if d == 1 or inner is None else layer.join(inner, "v", "left_semi")
            before = allowed[seg].join(on.select("v"), "v", "left_semi").select(F.col("u").alias("v")).distinct()
            layer = cut(before.join(total.select("v"), "v", "left_anti").withColumn("d", F.lit(d)), "needs")
            if not layer.take(1):
                break
            total = total.unionByName(layer)
        found[seg] = total
        after = total.select(F.col("v").alias("node_id"))
    return found


def _start(sets: list[DataFrame]) -> DataFrame:
    used = "array<struct<src:bigint,dst:bigint,edge_types:array<string>>>"
    return sets[0].select(
        F.col("node_id").alias("start"), F.col("node_id").alias("v"), F.array("node_id").alias("visited"),
        F.array().cast(used).alias("used"), F.array(F.struct(F.col("node_id").alias("node"), F.lit(0).alias("seg"))).alias("refs"), F.lit(1.0).alias("chance"),
    )


def _grown(frontier: DataFrame, allowed: DataFrame, pattern: Pattern) -> DataFrame:
    """frontier one step further, within what the mode lets a path repeat, the depth and the accumulated probability."""
    grown = frontier.withColumnRenamed("v", "u").join(allowed, "u")
    if pattern.mode in ("TRAIL", "SIMPLE"):
        grown = grown.where(~F.exists("used", lambda e: (e["src"] == F.col("src")) & (e["dst"] == F.col("dst"))))
    if pattern.mode in ("ACYCLIC", "SIMPLE"):
        grown = grown.where(~F.array_contains("visited", F.col("v")))
    chance = F.col("chance") * F.col("p")
    return grown.where((F.size("visited") <= pattern.max_depth) & (chance >= pattern.min_accumulated))


def _moved(grown: DataFrame, *carry: str) -> DataFrame:
    visited, used = F.array_append("visited", F.col("v")), F.array_append("used", F.struct("src", "dst", "edge_types"))
    return grown.select("start", "v", visited.alias("visited"), used.alias("used"), "refs", (F.col("chance") * F.col("p")).alias("chance"), *carry)


def _can_end(rows: DataFrame, need: DataFrame | None, hop: int, most: int) -> DataFrame:
    """rows (v, ...) that can end their position after hop hops."""
    return rows if need is None else rows.join(need.where(F.col("d") <= most - hop).select("v"), "v", "left_semi")


def _referred(rows: DataFrame, seg: int) -> DataFrame:
    return rows.withColumn("refs", F.array_append("refs", F.struct(F.col("v").alias("node"), F.lit(seg).alias("seg"))))


def _planned(graph: PropertyGraph, pattern: Pattern, bare: bool = False) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame | None]]:
    """Node sets, steps (planned once where a position repeats) and needs; chains of single steps are left to the optimizer."""
    sets = [node_set(graph, n) for n in pattern.nodes]
    repeats = any(e.max_hops > 1 for e in pattern.edges)
    allowed = [cut(steps(graph, e, bare), "steps") if repeats else steps(graph, e, bare) for e in pattern.edges]
    return sets, allowed, needs(graph, pattern, sets, allowed) if repeats else [None] * len(pattern.edges)


def find_paths(graph: PropertyGraph, pattern: Pattern) -> DataFrame:
    """Completed paths (start, v, visited, used, refs, chance) of TRAIL, ACYCLIC and SIMPLE patterns.

    visited: nodes in order; used: stored pairs in order with their types; refs: position of each labelled node. Where a
    position repeats, rows that cannot end it any more are dropped at each hop, see needs()."""
    if pattern.traversal is not None:
        return best_first(graph, pattern)
    sets, steps_of, need = _planned(graph, pattern)
    at = _start(sets)
    hops = 0
    for seg, edge in enumerate(pattern.edges, 1):
        allowed, target = steps_of[seg - 1], sets[seg]
        inner = graph.nodes.where(edge.through).select("node_id") if edge.through is not None else None
        done, frontier = [], _can_end(at, need[seg - 1], 0, edge.max_hops)
        if edge.min_hops == 0:
            done.append(_among(at, "v", target))
        for hop in range(1, edge.max_hops + 1):
            grown = _can_end(_moved(_grown(frontier, allowed, pattern)), need[seg - 1], hop, edge.max_hops)
            if pattern.mode == "ACYCLIC" and pattern.dedup == "level" and seg == len(pattern.edges) and done:
                held = reduce(DataFrame.unionByName, done).select("start", F.explode("visited").alias("v")).distinct()
                grown = grown.join(held, ["start", "v"], "left_anti")
            hops += 1
            if hops % CUT_EVERY == 0 and (hop < edge.max_hops or seg < len(pattern.edges)):
                grown = cut(grown)
            if hop >= edge.min_hops:
                done.append(_among(grown, "v", target))
            if hop == edge.max_hops:
                break
            frontier = grown if inner is None else _among(grown, "v", inner)
        at = _referred(reduce(DataFrame.unionByName, done), seg)
    return at


# ---- one path at a time ----
def _prefix_keys(pattern: Pattern) -> Column:
    """For each prefix of a path (visited, chances) its place in the order of the traversal, smaller ones come first: a state
    is taken up when its key is the smallest of those that wait. Under the two orders that prefer short or likely paths keys
    grow along a path; under the others what follows a state always comes before its siblings, so that the key is the way
    to it. Equal ones are told apart by the way."""
    at = F.sequence(F.lit(1), F.size("visited"))
    way = lambda i: F.slice("visited", 1, i)
    last = lambda i: F.get("visited", i - 1)
    chance = lambda i: F.get("chances", i - 1)
    chances_to = lambda i: F.transform(F.sequence(F.lit(1), i), lambda k: F.struct(chance(k).alias("c"), last(k).alias("n")))
    keys = {
        "shortest": lambda i: F.struct(i.alias("h"), last(i).alias("n"), way(i).alias("w")),
        "likely": lambda i: F.struct((-chance(i)).alias("c"), i.alias("h"), last(i).alias("n"), way(i).alias("w")),
        "longest": way,
        "unlikely": chances_to,
    }
    return F.transform(at, keys[pattern.traversal])


def best_first(graph: PropertyGraph, pattern: Pattern) -> DataFrame:
    """Completed paths as of find_paths(), where the paths of each start are taken up one at a time in the pattern's order:

    - shortest: fewer hops first; likely: larger accumulated probability first, then fewer hops;
    - longest, unlikely: the reverse of these; equal ones by the last node's id, then by the way; ended paths first.

    An ACYCLIC path is not lengthened to a node of a path that was completed before (of the same start). With node_limit,
    nothing more is taken up once the completed paths of a start hold that many nodes.

    All starts go on together, a hop a round. For "shortest" the rounds follow the order, and a table of the first
    completed path through each (start, node) drops rows as they grow. For the other orders all node-unique paths are made,
    and then decided in rounds: a path stands when no path before it that stands, or is open, holds a node it
    was lengthened to. The first open path of each start can always be decided; in practice most are, in each round."""
    sets, allowed, need = _planned(graph, pattern)
    last, refuse = len(pattern.edges), pattern.mode == "ACYCLIC"
    held: DataFrame | None = None  # (start, node, first): for "shortest"
    done: list[DataFrame] = []
    begin = _start(sets).withColumn("chances", F.array(F.lit(1.0)))
    waiting: dict[tuple[int, int], DataFrame] = {(0, 0): _can_end(begin, need[0], 0, pattern.edges[0].max_hops)}
    depth = 0
    while waiting:
        for seg, edge in enumerate(pattern.edges):  # positions of no hops
            if edge.min_hops == 0 and (seg, 0) in waiting:
                over = _referred(_among(waiting[seg, 0], "v", sets[seg + 1]), seg + 1)
                waiting[seg + 1, 0] = waiting[seg + 1, 0].unionByName(over) if (seg + 1, 0) in waiting else over
        if (last, 0) in waiting:
            ended = cut(waiting.pop((last, 0)), "ended")
            done.append(ended)
            if refuse and pattern.traversal == "shortest":
                first = F.min(F.struct(F.lit(depth + 1).alias("h"), F.col("v").alias("n"), F.col("visited").alias("w"))).alias("first")
                now = ended.select("start", F.explode("visited").alias("node"), "v", "visited").groupBy("start", "node").agg(first)
                held = now if held is None else held.unionByName(now).groupBy("start", "node").agg(F.min("first").alias("first"))
                held = cut(held, "held")
            if pattern.node_limit and held is not None:  # a start that has its nodes goes no further
                full = held.groupBy("start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= pattern.node_limit).select("start")
                waiting = {k: w.join(full, "start", "left_anti") for k, w in waiting.items()}
        grown: dict[tuple[int, int], list[DataFrame]] = {}
        for (seg, hop), rows in waiting.items():
            edge = pattern.edges[seg]
            more = _grown(rows, allowed[seg], pattern)
            if held is not None:
                mine = F.struct(F.lit(depth + 1).alias("h"), F.col("u").alias("n"), F.col("visited").alias("w"))
                known = held.select("start", F.col("node").alias("v"), "first")
                more = more.join(known, ["start", "v"], "left").where(F.col("first").isNull() | (F.col("first") > mine)).drop("first")
            chances = F.array_append("chances", F.col("chance") * F.col("p"))
            more = _moved(more.withColumn("chances", chances), "chances")
            more = cut(_can_end(more, need[seg], hop + 1, edge.max_hops), "states")
            if not more.take(1):
                continue
            if hop + 1 >= edge.min_hops:
                ending = _referred(_among(more, "v", sets[seg + 1]), seg + 1)
                if seg + 1 < last:
                    ending = _can_end(ending, need[seg + 1], 0, pattern.edges[seg + 1].max_hops)
                grown.setdefault((seg + 1, 0), []).append(ending)
            if hop + 1 < edge.max_hops:
                on = more if edge.through is None else _among(more, "v", graph.nodes.where(edge.through).select("node_id"))
                grown.setdefault((seg, hop + 1), []).append(on)
        waiting = {k: reduce(DataFrame.unionByName, parts) for k, parts in grown.items()}
        depth += 1
    paths = reduce(DataFrame.unionByName, done) if done else begin.where("false")
    paths = cut(paths.withColumn("keys", _prefix_keys(pattern)).withColumn("id", F.monotonically_increasing_id()), "paths")
    if refuse and pattern.traversal != "shortest":
        paths = _decided(paths)
    if pattern.node_limit:
        paths = _within(paths, pattern.node_limit)
    return paths.select("start", "v", "visited", "used", "refs", "chance")


def _decided(paths: DataFrame) -> DataFrame:
    """The paths that stand, of (id, start, visited, keys): those that were not lengthened to a node which a path that
    stands and was completed before holds."""
    key = F.element_at("keys", -1)
    entered = paths.select("id", "start", F.posexplode(F.slice("visited", 2, F.size("visited"))).alias("i", "node"), "keys")
    entered = cut(entered.select("id", "start", "node", F.get("keys", F.col("i")).alias("left"), F.element_at("keys", -1).alias("key")), "entered")
    firsts = lambda rows: rows.groupBy("start", "node").agg(F.min("key").alias("first"))
    stands, open_ = paths.select("id").where("false"), paths.select("id")
    while True:
        rows = entered.join(open_, "id", "left_semi")
        kept = firsts(entered.join(stands, "id", "left_semi")).withColumnRenamed("first", "kept")
        maybe = firsts(rows).withColumnRenamed("first", "maybe")
        judged = rows.join(kept, ["start", "node"], "left").join(maybe, ["start", "node"], "left")
        judged = judged.groupBy("id").agg(F.max(F.coalesce(F.col("kept") <= F.col("left"), F.lit(False))).alias("refused"), F.max(F.coalesce(F.col("maybe") <= F.col("left"), F.lit(False))).alias("waits"))
        alone = open_.join(entered.select("id"), "id", "left_anti").select("id", F.lit(False).alias("refused"), F.lit(False).alias("waits"))  # paths without a step
        judged = cut(judged.unionByName(alone), "judged")
        stands = cut(stands.union(judged.where("not refused and not waits").select("id")), "stands")
        open_ = judged.where("not refused and waits").select("id")
        if not open_.take(1):
            return paths.join(stands, "id", "left_semi").withColumn("key", key)


def _within(paths: DataFrame, limit: int) -> DataFrame:
    """The first paths of each start, up to the one with which their nodes number limit or more. Of each start at most
    `limit` paths that add a node are looked at."""
    keyed = paths.withColumn("key", F.element_at("keys", -1))
    place = F.struct("key", "refs").alias("place")
    news = keyed.select("start", F.explode("visited").alias("node"), place).groupBy("start", "node").agg(F.min("place").alias("place"))
    adds = news.groupBy("start", "place").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("start").orderBy("place")
    few = adds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    summed = few.withColumn("nodes", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    full = summed.where(F.col("nodes") >= limit).groupBy("start").agg(F.min("place").alias("until"))
    return keyed.join(full, "start", "left").where(F.col("until").isNull() | (F.struct("key", "refs") <= F.col("until"))).drop("until")


def _labels(pattern: Pattern) -> Column:
    out = F.lit(None).cast("string")
    for i, n in enumerate(pattern.nodes):
        if n.label:
            out = F.when(F.col("seg") == i, F.lit(n.label)).otherwise(out)
    return out


# ---- likely paths over one position, without what they went along ----
def _plain(pattern: Pattern) -> bool:
    edge = pattern.edges[0] if len(pattern.edges) == 1 else None
    whole = pattern.mode == "ACYCLIC" and pattern.traversal == "likely" and pattern.node_limit is None
    return whole and edge is not None and edge.min_hops == 1 and edge.through is None and edge.max_hops <= pattern.max_depth and edge.direction in ("out", "in")


def _likely(graph: PropertyGraph, pattern: Pattern) -> DataFrame:
    """Completed paths (start, v, visited, tail) as of best_first() for "likely" over one position. tail: the nodes since the last
    one that satisfies the end, without v; what was before those belongs to a shorter path that stands as well.

    Rows have neither pairs nor types nor the keys of all prefixes. Of each (start, node) the first path that holds it is known
    when all are made: only a step behind that one may be refused, and only paths with such a step are decided in rounds, as
    _decided() does with all of them; the others stand."""
    sets, (allowed,), (need,) = _planned(graph, pattern, bare=True)
    most = pattern.edges[0].max_hops
    ends = sets[1].select(F.col("node_id").alias("v")).distinct().withColumn("ends", F.lit(True))
    links = allowed.select("u", "v", "p").join(ends, "v", "left").withColumn("ends", F.coalesce("ends", F.lit(False)))
    links = cut(_can_end(links, need, 1, most), "links")
    long = F.array().cast("array<bigint>")
    at = sets[0].select(F.col("node_id").alias("start"), F.col("node_id").alias("v"), F.array("node_id").alias("visited"), F.array(F.lit(1.0)).alias("chances"), long.alias("rest"), F.lit(None).cast("bigint").alias("id"))
    at, layers = _can_end(at, need, 0, most), []
    for hop in range(1, most + 1):
        chance = F.element_at("chances", -1) * F.col("p")
        rows = at.withColumnRenamed("v", "u").withColumnRenamed("id", "before").join(links, "u")
        rows = _can_end(rows.where(~F.array_contains("visited", F.col("v")) & (chance >= pattern.min_accumulated)), need, hop, most)
        rows = rows.select("start", "v", F.array_append("visited", F.col("v")).alias("visited"), F.array_append("chances", chance).alias("chances"), F.col("rest").alias("tail"), "ends", "before", F.lit(hop).alias("hop"))
        at = cut(rows.withColumn("id", F.monotonically_increasing_id()), "likely")
        if not at.take(1):
            break
        layers.append(at)
        at = at.select("start", "v", "visited", "chances", F.when(F.col("ends"), long).otherwise(F.array_append("tail", F.col("v"))).alias("rest"), "id")
    made = reduce(DataFrame.unionByName, layers) if layers else at.where("false").select("start", "v", "visited", "chances", F.col("rest").alias("tail"), F.lit(True).alias("ends"), F.col("id").alias("before"), F.lit(0).alias("hop"), "id")
    ended = made.where("ends")
    key = lambda i: F.struct((-F.get("chances", i)).alias("c"), i.alias("h"), F.get("visited", i).alias("n"), F.slice("visited", 1, i + 1).alias("w"))
    holds = lambda rows: rows.select("start", F.explode(F.array_append("tail", F.col("v"))).alias("node"), key(F.col("hop")).alias("key"))
    firsts = lambda held: held.groupBy("start", "node").agg(F.min("key").alias("first"))
    first = cut(firsts(holds(ended)), "first")
    behind = made.where("hop > 1").select("hop", "id", "start", F.col("v").alias("node"), key(F.col("hop") - 1).alias("left")).join(first, ["start", "node"]).where("first < left")
    doubted = cut(behind.select("hop", "id"), "doubted")
    if not doubted.take(1):
        return ended.select("start", "v", "visited", "tail")
    parts, last = [], None  # paths with a step in doubt, their own or one before
    for hop, layer in enumerate(layers, 1):
        mine = doubted.where(F.col("hop") == hop).select("id")
        if last is not None:
            mine = mine.union(layer.join(last.withColumnRenamed("id", "before"), "before", "left_semi").select("id"))
        last = cut(mine.distinct(), "in-doubt")
        parts.append(last.withColumn("hop", F.lit(hop)))
    doubted = reduce(DataFrame.unionByName, parts)
    doubtful = cut(ended.join(doubted, ["hop", "id"], "left_semi"), "doubtful")
    entered = doubtful.select("hop", "id", "start", "visited", "chances", F.explode(F.sequence(F.lit(2), F.greatest("hop", F.lit(2)))).alias("i"))
    entered = entered.select("hop", "id", "start", F.get("visited", F.col("i")).alias("node"), key(F.col("i") - 1).alias("left")).join(first, ["start", "node"]).where("first < left")
    entered = cut(entered.select("hop", "id", "start", "node", "left"), "entered")
    asked = cut(entered.select("start", "node").distinct(), "asked")
    sure = holds(ended.join(doubtful.select("hop", "id"), ["hop", "id"], "left_anti")).join(asked, ["start", "node"], "left_semi")
    held = cut(doubtful.select("hop", "id", "start", F.explode(F.array_append("tail", F.col("v"))).alias("node"), key(F.col("hop")).alias("key")).join(asked, ["start", "node"], "left_semi"), "holds")
    kept, open_, refused = cut(firsts(sure), "kept"), doubtful.select("hop", "id"), []
    while True:
        rows = entered.join(open_, ["hop", "id"], "left_semi")
        maybe = firsts(held.join(open_, ["hop", "id"], "left_semi")).withColumnRenamed("first", "maybe")
        judged = rows.join(kept.withColumnRenamed("first", "kept"), ["start", "node"], "left").join(maybe, ["start", "node"], "left")
        before = lambda c: F.max(F.coalesce(F.col(c) < F.col("left"), F.lit(False)))
        judged = cut(judged.groupBy("hop", "id").agg(before("kept").alias("refused"), before("maybe").alias("waits")), "judged")
        refused.append(judged.where("refused").select("hop", "id"))
        open_ = judged.where("not refused and waits").select("hop", "id")
        if not open_.take(1):
            gone = reduce(DataFrame.unionByName, refused)
            return ended.join(gone, ["hop", "id"], "left_anti").select("start", "v", "visited", "tail")
        stand = judged.where("not refused and not waits").select("hop", "id")
        kept = cut(firsts(held.join(stand, ["hop", "id"], "left_semi").select("start", "node", "key").unionByName(kept.withColumnRenamed("first", "key"))), "kept")


# ---- shortest paths counted, not listed ----
def _countable(pattern: Pattern) -> bool:
    edge = pattern.edges[0] if len(pattern.edges) == 1 else None
    whole = pattern.mode == "ACYCLIC" and pattern.traversal == "shortest" and pattern.node_limit is None and pattern.min_accumulated <= 0
    return whole and edge is not None and edge.min_hops == 1 and edge.through is None and edge.max_hops <= pattern.max_depth


def _ways(c: Column, b: Column) -> Column:
    return F.coalesce(F.try_multiply(c, b), F.raise_error(F.lit("more paths than a long holds")).cast("bigint"))


def _shown(at: DataFrame, held: DataFrame) -> DataFrame:
    """(start, node): what the paths of each start may not enter any more, or not by every way."""
    rows = at.select("start", F.explode("tail").alias("node")).union(held.select("start", "node")).union(at.where("own is not null").select("start", F.col("own").alias("node")))
    return rows.distinct()


def _merged(at: DataFrame, held: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """at and held with one start for all that go on alike from here, and (start, cls, private) of those it stands for; None
    where there are none. now: hops taken.

    Starts go on alike when they have the same rows but for nodes that no other start has shown. Such private nodes are left
    out of a class; where a class enters one later, the start it is of went another way, see _counted()."""
    shown = cut(_shown(at, held), "shown")
    counts = shown.groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    if len(counts.take(FEW_STARTS + 1)) <= FEW_STARTS:
        return None
    small = counts.where(F.col("n") <= MOST_SHOWN).select("start")
    lone = shown.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start")).where("n = 1").select("start", "node")
    private = lone.join(small, "start", "left_semi").groupBy("start").agg(F.collect_list("node").alias("private"))
    private = cut(small.join(private, "start", "left").select("start", F.coalesce("private", F.array().cast("array<bigint>")).alias("private")), "private")
    bare = lambda tail: F.filter(tail, lambda x: ~F.array_contains("private", x))
    ahead = at.join(private, "start").groupBy("start", bare("tail").alias("tail"), "v").agg(_exact_sum("c").alias("c"))
    known = held.join(private, "start").where(~F.array_contains("private", F.col("node"))).select("start", "node", "first")
    ahead, known = cut(ahead, "ahead"), cut(known, "known")
    none = F.struct(F.lit(0).alias("h"), F.lit(0).cast("bigint").alias("n"))  # the end at which a node was held counts in the next hop alone
    one = ahead.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("tail", "v", "c"))).alias("ahead"))
    two = known.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("node", F.when(F.col("first.h") == now, F.col("first")).otherwise(none).alias("first")))).alias("known"))
    state = cut(one.join(two, "start", "left"), "alike")
    classes = state.groupBy(F.col("ahead").alias("a"), F.col("known").alias("k")).agg(F.min("start").alias("cls"), F.count(F.lit(1)).alias("n")).where("n > 1")
    of = cut(state.join(classes, F.expr("ahead = a and known <=> k")).select("start", "cls").join(private, "start").select("start", "cls", "private"), "classes")
    if not of.take(1):
        return None
    heads = of.where("start = cls").select("start")
    rest = lambda rows: rows.join(of.select("start"), "start", "left_anti")
    ahead = ahead.join(heads, "start", "left_semi").select("start", "tail", "v", "c", F.lit(None).cast("bigint").alias("own"))
    at = rest(at).select("start", "tail", "v", "c", "own").unionByName(ahead)
    return cut(at, "counted"), cut(rest(held).unionByName(known.join(heads, "start", "left_semi")), "held"), of


def _counted(graph: PropertyGraph, pattern: Pattern, merge: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """Steps (start, u, v, src, dst, hop, ends, c, b, w) of the paths that best_first() completes, without listing these; the
    steps allowed; the starts with a tie, which are left out, if any; and those that are left out to be counted alone.

    merge: starts whose paths go on alike after some hops are counted as one, with w as their number; start is then the least of
    them. A class may enter what is private to one of its starts, which that one could not: it is left out, to be counted alone.

    c: ways from the start to u; b: ways on from v, ending there included. For "shortest" all that a path's way on depends on
    is its start, hops and last node, and the nodes since the last one that satisfies the end (tail): what was before
    those belongs to a completed path and is refused in any case. Paths that agree in these are one row with a count. Where
    the first completed path through a node and a path that would enter it agree in hops and last node, their ways decide:
    starts with such a tie are left out, for best_first()."""
    sets, (allowed,), (need,) = _planned(graph, pattern)
    most = pattern.edges[0].max_hops
    ends = sets[1].select(F.col("node_id").alias("v")).distinct().withColumn("ends", F.lit(True))
    links = allowed.select("u", "v", "src", "dst").join(ends, "v", "left").withColumn("ends", F.coalesce("ends", F.lit(False)))
    links = cut(_can_end(links, need, 1, most), "links")
    at = sets[0].select(F.col("node_id").alias("start"), F.array("node_id").alias("tail"), F.col("node_id").alias("v"), F.lit(1).cast("bigint").alias("c"), F.col("node_id").alias("own"))
    at, held, layers, ties = _can_end(at, need, 0, most), None, [], []
    merges: dict[int, DataFrame] = {}  # (start, cls, private) by the hops taken before
    names: DataFrame | None = None  # (real, start): of what was merged, the start that stands for it now
    watched: DataFrame | None = None  # (start, v, real): what a start of a class may not enter
    entered: list[DataFrame] = []
    renamed: list[tuple[int, DataFrame]] = []  # names of the layers from a hop on
    for hop in range(most):
        rows = at.withColumnRenamed("v", "u").join(links, "u").where(~F.array_contains("tail", F.col("v")) & (F.col("own").isNull() | (F.col("v") != F.col("own"))))
        rows = _can_end(rows, need, hop + 1, most).withColumn("tie", F.lit(False))
        if held is not None:
            mine, known = F.struct(F.lit(hop).alias("h"), F.col("u").alias("n")), held.select("start", F.col("node").alias("v"), "first")
            rows = rows.join(known, ["start", "v"], "left").where(F.col("first").isNull() | (F.col("first") >= mine))
            rows = rows.withColumn("tie", F.coalesce(F.col("first") == mine, F.lit(False))).drop("first")
        taken = cut(rows.select("start", "tail", "u", "v", "src", "dst", "ends", "c", "tie", "own"), "taken")
        if not taken.take(1):
            break
        lost = taken.where("tie").select("start")
        ties.append(lost if names is None else lost.distinct().join(names, "start", "left").select(F.coalesce("real", "start").alias("start")))
        if watched is not None:
            entered.append(taken.select("start", "v").join(watched, ["start", "v"]).select(F.col("real").alias("start")))
        taken = taken.where("not tie").drop("tie").withColumn("to", F.when(F.col("ends"), F.array().cast("array<bigint>")).otherwise(F.array_append("tail", F.col("v"))))
        layers.append(taken)
        if hop + 1 == most:
            break
        at = cut(taken.groupBy("start", F.col("to").alias("tail"), "v", "own").agg(_exact_sum("c").alias("c")), "counted")
        first = F.struct(F.lit(hop + 1).alias("h"), F.col("v").alias("n")).alias("first")
        now = taken.where("ends").select("start", F.explode(F.array_append("tail", F.col("v"))).alias("node"), first)
        held = cut((now if held is None else held.unionByName(now)).groupBy("start", "node").agg(F.min("first").alias("first")), "held")
        found = _merged(at, held, hop + 1) if merge and hop + 1 < most and hop < MERGE_HOPS else None
        if found is not None:
            at, held, of = found
            merges[hop + 1] = of
            one = of.select("start", "cls")
            fresh = one if names is None else one.join(names.select("start").distinct(), "start", "left_anti")
            fresh = fresh.select(F.col("start").alias("real"), F.col("cls").alias("start"))
            follow = lambda rows, *more: rows.join(one, "start", "left").select(F.coalesce("cls", "start").alias("start"), *more)
            behind = of.select("start", "cls", F.explode("private").alias("v"))
            # what is private to a class is so to each start of it
            new = behind.select(F.col("cls").alias("start"), "v", F.col("start").alias("real")) if names is None else behind.join(names, "start", "left").select(F.col("cls").alias("start"), "v", F.coalesce("real", "start").alias("real"))
            watched = cut(new if watched is None else new.unionByName(follow(watched, "v", "real")), "watched")
            names = cut(fresh if names is None else fresh.unionByName(follow(names, "real").select("real", "start")), "names")
            renamed.append((hop + 1, names))
    tied = _some(ties, "tied")
    apart = _some(entered, "apart")
    if apart is not None and tied is not None:
        tied = cut(tied.join(apart, "start", "left_anti"), "tied")  # what a class had in the way of ties need not be theirs
        tied = tied if tied.take(1) else None
    gone = None if tied is None and apart is None else reduce(DataFrame.union, [x for x in (tied, apart) if x is not None])
    stays = lambda named: named.groupBy("start").agg(F.count(F.lit(1)).alias("w"))
    onward, goods = None, []
    for hop in range(len(layers) - 1, -1, -1):
        rows, w = layers[hop], F.lit(1).cast("bigint")
        named = next((n for first, n in reversed(renamed) if first <= hop), None)
        if named is not None:  # how many starts a class stands for
            kept = named if gone is None else named.join(gone.withColumnRenamed("start", "real"), "real", "left_anti")
            each = named.select("start").distinct().join(stays(kept), "start", "left").select("start", F.coalesce("w", F.lit(0).cast("bigint")).alias("w"))
            rows = rows.join(each, "start", "left").withColumn("w", F.coalesce("w", F.lit(1).cast("bigint")))
            w = F.col("w")
            if gone is not None:
                alone = gone.join(named.select(F.col("real").alias("start")), "start", "left_anti")
                rows = rows.where("w > 0").join(alone, "start", "left_anti")
        elif gone is not None:
            rows = rows.join(gone, "start", "left_anti")
        on = F.lit(0).cast("bigint")
        if hop + 1 in merges:  # ways on are those of the class
            rows = rows.join(merges[hop + 1], "start", "left")
            to = F.when(F.col("cls").isNull(), F.col("to")).otherwise(F.filter("to", lambda x: ~F.array_contains("private", x)))
            rows = rows.withColumn("by", F.coalesce("cls", "start")).withColumn("to", to)
        else:
            rows = rows.withColumn("by", F.col("start"))
        if onward is not None:
            rows, on = rows.join(onward, ["by", "to", "v"], "left"), F.coalesce("more", F.lit(0).cast("bigint"))
        good = rows.withColumn("b", F.col("ends").cast("bigint") + on).where("b > 0").select("start", "tail", "u", "v", "src", "dst", F.lit(hop).alias("hop"), "ends", "c", "b", w.alias("w"))
        good = good if onward is None else cut(good, "good")  # the last layer is there already
        goods.append(good.drop("tail"))
        onward = good.groupBy(F.col("start").alias("by"), F.col("tail").alias("to"), F.col("u").alias("v")).agg(_exact_sum("b").alias("more"))
    none = at.where("false").select("start", F.col("v").alias("u"), "v", F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(0).alias("hop"), F.lit(True).alias("ends"), "c", F.col("c").alias("b"), F.col("c").alias("w"))
    return reduce(DataFrame.unionByName, goods, none), allowed, tied, apart


def _some(parts: list[DataFrame], name: str) -> DataFrame | None:
    """The distinct rows of all parts, None where there are none."""
    rows = cut(reduce(DataFrame.union, parts).distinct(), name) if parts else None
    return rows if rows is not None and rows.take(1) else None


# ---- what all nodes can end: nodes that all starts see alike are one ----
def _alike(links: DataFrame, starts: DataFrame) -> DataFrame | None:
    """(node, cls) of nodes behind a node with many links, and behind these, no starts: the coarsest classes of these such that each node of a class has
    as many links from, and to, each class (other nodes are their own), of those that go up in ids and of the others. None where
    there are none, or not after MOST_ROUNDS."""
    many = links.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY_LINKS).select("u")
    up = (F.col("v") > F.col("u")).alias("up")
    both = links.select(F.col("u").alias("node"), F.col("v").alias("other"), F.lit(0).alias("way"), up).union(links.select("v", "u", F.lit(1), up))
    few = both.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= MOST_LINKS).select("node")
    may = cut(few.join(starts.select(F.col("node_id").alias("node")), "node", "left_anti"), "may")
    behind, new = None, many.withColumnRenamed("u", "node")
    for _ in range(MOST_ROUNDS):
        after = links.join(new.withColumnRenamed("node", "u"), "u", "left_semi").select(F.col("v").alias("node")).distinct().join(may, "node", "left_semi")
        new = cut(after if behind is None else after.join(behind, "node", "left_anti"), "behind")
        if not new.take(1):
            break
        behind = new if behind is None else behind.unionByName(new)
    if behind is None:
        return None
    near = cut(both.join(behind, "node", "left_semi"), "near")
    classes, n = cut(near.select("node").distinct().crossJoin(F.broadcast(near.agg(F.min("node").alias("cls")))), "alike"), 1
    for _ in range(MOST_ROUNDS):
        seen = near.join(classes.withColumnRenamed("node", "other"), "other", "left").groupBy("node", "way", "up", F.coalesce("cls", "other").alias("of")).agg(F.count(F.lit(1)).alias("n"))
        seen = seen.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("way", "up", "of", "n"))).alias("seen")).join(classes, "node")
        seen = cut(seen, "seen")
        keys = seen.groupBy(F.col("cls").alias("c"), F.col("seen").alias("s")).agg(F.min("node").alias("new"))
        classes = cut(seen.join(keys, F.expr("cls = c and seen = s")).select("node", F.col("new").alias("cls")), "alike")
        was, n = n, classes.select("cls").distinct().count()
        if n == was:
            return classes
    return None


def _reached(graph: PropertyGraph, pattern: Pattern) -> tuple[DataFrame, DataFrame] | None:
    """(node_id, seg) and (src, dst, edge_types, flow) as of _flows(), where each node that a step leads to satisfies the end;
    None where one does not.

    Then the first path that holds a node is the first to it: a step goes from u to a node that is one hop further from
    the start, or as far as u and of a larger id. Such ways cannot repeat a node, and nodes of a class of _alike() are as far from
    any start, with as many ways to each of them and on from it, so that a start has one row for the class. Rows are (start, v, far,
    c) by hop; steps are found again from these on the way back."""
    sets, (allowed,), _ = _planned(graph, pattern)
    links = cut(allowed.select("u", "v", "src", "dst"), "links")
    if links.join(sets[1].select(F.col("node_id").alias("v")), "v", "left_anti").take(1):
        return None
    classes = _alike(links, sets[0])
    if classes is None:
        dealt = links.withColumn("a", F.col("u")).withColumn("z", F.col("v"))
        nin = nout = F.col("n")
        sized = lambda rows: rows
    else:
        dealt = links.join(classes.select(F.col("node").alias("u"), F.col("cls").alias("a")), "u", "left").join(classes.select(F.col("node").alias("v"), F.col("cls").alias("z")), "v", "left")
        dealt = dealt.withColumn("a", F.coalesce("a", "u")).withColumn("z", F.coalesce("z", "v"))
        sizes = classes.groupBy("cls").agg(F.count(F.lit(1)).alias("size"))
        of = lambda end: sizes.select(F.col("cls").alias(end), F.col("size").alias(f"of_{end}"))
        sized = lambda rows: rows.join(of("a"), "a", "left").join(of("z"), "z", "left")
        share = lambda end: F.expr(f"n div coalesce(of_{end}, 1)")
        nin, nout = share("z"), share("a")
    dealt = cut(dealt.withColumn("up", F.col("v") > F.col("u")), "dealt")
    between = cut(sized(dealt.groupBy("a", "z", "up").agg(F.count(F.lit(1)).alias("n"))).select("a", "z", "up", nin.alias("nin"), nout.alias("nout")), "between")
    one, most = F.lit(1).cast("bigint"), pattern.edges[0].max_hops
    at = sets[0].select(F.col("node_id").alias("start"), F.col("node_id").alias("v"), F.lit(0).alias("far"), one.alias("c")).distinct()
    layers, known = [cut(at, "reached")], None
    for hop in range(most):
        new = layers[-1].where(F.col("far") == hop).select("start", "v", "far")
        known = new if known is None else known.unionByName(new)
        ways = layers[-1].select("start", F.col("v").alias("a"), "c").join(between, "a").select("start", F.col("z").alias("v"), "up", _ways(F.col("c"), F.col("nin")).alias("c"))
        ways = ways.groupBy("start", "v").agg(_exact_sum("c").alias("all"), F.try_sum(F.when(F.col("up"), F.col("c"))).alias("ups")).join(known, ["start", "v"], "left")
        ways = ways.where(F.col("far").isNull() | ((F.col("far") == hop) & F.col("ups").isNotNull()))
        ways = cut(ways.select("start", "v", F.coalesce("far", F.lit(hop + 1)).alias("far"), F.when(F.col("far").isNull(), F.col("all")).otherwise(F.col("ups")).alias("c")), "reached")
        if not ways.take(1):
            break
        layers.append(ways)
    onward, flows = layers[-1].select("start", "v", "far", one.alias("b")), []
    for hop in range(len(layers) - 2, -1, -1):
        on = onward.select("start", F.col("v").alias("z"), "far", "b")
        good = layers[hop].select("start", F.col("v").alias("a"), "c").join(between, "a").join(on, ["start", "z"]).where((F.col("far") == hop + 1) | F.col("up"))
        good = good.select("start", "a", "z", "up", "c", "b", "nout")
        if hop:
            good = cut(good, "good")
            more = good.groupBy("start", F.col("a").alias("v")).agg(_exact_sum(_ways(F.col("nout"), F.col("b"))).alias("more"))
            onward = cut(layers[hop].join(more, ["start", "v"], "left").select("start", "v", "far", (one + F.coalesce("more", F.lit(0).cast("bigint"))).alias("b")), "onward")
        flows.append(cut(good.groupBy("a", "z", "up").agg(_exact_sum(_ways(F.col("c"), F.col("b"))).alias("f")).withColumn("hop", F.lit(hop)), "flows"))
    none = between.where("false").select("a", "z", "up", F.col("nin").alias("f"), F.lit(0).alias("hop"))
    found = reduce(DataFrame.unionByName, flows, none)
    per = found.groupBy("a", "z", "up").agg(_exact_sum("f").alias("f"))
    on_links = cut(dealt.join(per, ["a", "z", "up"]).select("v", "src", "dst", "f"), "on-links")
    marks = found.where("hop = 0").select(F.col("a").alias("node_id"), F.lit(0).alias("seg")).union(on_links.select("v", F.lit(1)))
    return marks, _typed_flows([(on_links.select("src", "dst", "f"), pattern.edges[0], allowed)])


def _of_starts(graph: PropertyGraph, pattern: Pattern, starts: DataFrame) -> tuple[PropertyGraph, Pattern]:
    """The pattern from some of its starts alone."""
    nodes = graph.nodes.join(starts.select(F.col("start").alias("node_id"), F.lit(True).alias("starts_here")), "node_id", "left")
    return PropertyGraph(nodes, graph.edges), replace(pattern, parts=(Node(F.coalesce("starts_here", F.lit(False)), pattern.nodes[0].label), *pattern.parts[1:]))


def path_counts(graph: PropertyGraph, pattern: Pattern) -> DataFrame:
    """(start, paths, nodes, hops): of each start, how many paths there are, the nodes they hold and the hops they take."""
    if _plain(pattern):
        found = cut(_likely(graph, pattern), "found")
        ended = found.groupBy("start").agg(F.count(F.lit(1)).alias("paths"), F.sum(F.size("visited") - 1).alias("hops"))
        others = found.select("start", F.explode(F.array_append("tail", F.col("v"))).alias("node")).distinct().groupBy("start").agg((F.count(F.lit(1)) + 1).alias("nodes"))
        return ended.join(others, "start").select("start", "paths", "nodes", "hops")
    if not _countable(pattern):
        found = find_paths(graph, pattern)
        return found.groupBy("start").agg(
            F.count(F.lit(1)).alias("paths"), F.size(F.array_distinct(F.flatten(F.collect_set("visited")))).cast("long").alias("nodes"), F.sum(F.size("used")).alias("hops"),
        )
    found, _, tied, _ = _counted(graph, pattern)
    ended = found.where("ends").groupBy("start").agg(_exact_sum("c").alias("paths"), F.sum(F.col("c") * (F.col("hop") + 1)).alias("hops"))
    nodes = found.select("start", "u").union(found.select("start", "v")).distinct().groupBy("start").agg(F.count(F.lit(1)).alias("nodes"))
    counts = ended.join(nodes, "start").select("start", "paths", "nodes", "hops")
    if tied is None:
        return counts
    on, part = _of_starts(graph, pattern, tied)
    listed = best_first(on, part).groupBy("start").agg(
        F.count(F.lit(1)).alias("paths"), F.size(F.array_distinct(F.flatten(F.collect_set("visited")))).cast("long").alias("nodes"), F.sum(F.size("used")).alias("hops"),
    )
    return counts.unionByName(listed)


def match(graph: PropertyGraph, pattern: Pattern) -> GraphResult:
    """The sub-graph of all paths of the pattern: nodes with their label (of the last position where there are several),
    and pairs with their types and the number of paths over them. A pattern of one node gives all its nodes."""
    if not pattern.edges:
        only = node_set(graph, pattern.nodes[0]).withColumn("seg", F.lit(0))
        none = pairs_of(graph.edges).where("false").select("src", "dst", F.array().cast("array<string>").alias("edge_types"), F.lit(0).cast("bigint").alias("flow"))
        return GraphResult(only.select("node_id", _labels(pattern).alias("reference")), none)
    if pattern.mode == "WALK" or pattern.layered:
        return _walk(graph, pattern)
    if not _countable(pattern):
        return _labelled(*_listed(graph, pattern), pattern)
    found = None if _constrained(pattern.nodes[1]) else _reached(graph, pattern)
    return _labelled(*(found or _flows(graph, pattern, True)), pattern)


def _flows(graph: PropertyGraph, pattern: Pattern, merge: bool) -> tuple[DataFrame, DataFrame]:
    """(node_id, seg) and (src, dst, edge_types, flow) of paths that are counted."""
    from .graph import merge_results

    found, allowed, tied, apart = _counted(graph, pattern, merge)
    edges = _typed_flows([(found.select("src", "dst", _ways(_ways(F.col("c"), F.col("b")), F.col("w")).alias("f")), pattern.edges[0], allowed)])
    marks = found.select(F.col("u").alias("node_id"), F.when(F.col("hop") == 0, 0).otherwise(-1).alias("seg"))
    nodes = marks.union(found.select("v", F.when(F.col("ends"), 1).otherwise(-1)))
    more = [] if tied is None else [_listed(*_of_starts(graph, pattern, tied))]
    if apart is not None:
        more.append(_flows(*_of_starts(graph, pattern, apart), False))
    for more_nodes, more_edges in more:
        nodes, edges = nodes.union(more_nodes), merge_results(edges, more_edges)
    return nodes, edges


def _listed(graph: PropertyGraph, pattern: Pattern) -> tuple[DataFrame, DataFrame]:
    """(node_id, seg) and (src, dst, edge_types, flow) of paths made one by one."""
    paths = cut(find_paths(graph, pattern))
    edges = paths.select(F.explode("used").alias("e")).groupBy("e.src", "e.dst").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("e.edge_types")))).alias("edge_types"), F.count(F.lit(1)).alias("flow"))
    inner = paths.select(F.explode("visited").alias("node_id"), F.lit(-1).alias("seg"))
    return inner.union(paths.select(F.explode("refs").alias("r")).select(F.col("r.node").alias("node_id"), F.col("r.seg").alias("seg"))), edges


def _labelled(marks: DataFrame, edges: DataFrame, pattern: Pattern) -> GraphResult:
    nodes = marks.groupBy("node_id").agg(F.max("seg").alias("seg"))
    return GraphResult(nodes.select("node_id", _labels(pattern).alias("reference")), edges)


def _exact_sum(column: str | Column) -> Column:
    """A sum of whole numbers; one that a long does not hold is an error, whatever the session's settings."""
    return F.coalesce(F.try_sum(column), F.raise_error(F.lit("more walks than a long holds")).cast("bigint"))


def _typed_flows(flows: list[tuple[DataFrame, Edge, DataFrame]]) -> DataFrame:
    """(src, dst, edge_types, flow) of (flows (src, dst, f), edge position, its steps). Types are not carried along with the
    walks: where each position has one, they are added up as bits, otherwise they are joined to the sums."""
    if all(len(edge.types) == 1 and not edge.negate for _, edge, _ in flows):
        names = sorted({edge.types[0] for _, edge, _ in flows})
        rows = [f.withColumn("bit", F.lit(1 << names.index(edge.types[0])).cast("bigint")) for f, edge, _ in flows]
        summed = reduce(DataFrame.unionByName, rows).groupBy("src", "dst").agg(F.bit_or("bit").alias("bits"), _exact_sum("f").alias("flow"))
        types = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(1 << i) != 0, F.lit(t)) for i, t in enumerate(names)]))
        return summed.select("src", "dst", types.alias("edge_types"), "flow")
    rows = []
    for f, _, allowed in flows:
        types = allowed.select("src", "dst", "edge_types").dropDuplicates(["src", "dst"])
        rows.append(f.groupBy("src", "dst").agg(_exact_sum("f").alias("f")).join(types, ["src", "dst"]))
    types = F.array_sort(F.array_distinct(F.flatten(F.collect_set("edge_types")))).alias("edge_types")
    return reduce(DataFrame.unionByName, rows).groupBy("src", "dst").agg(types, _exact_sum("f").alias("flow"))


def _walk(graph: PropertyGraph, pattern: Pattern) -> GraphResult:
    """All walks, without listing them: a forward pass counts the ways to each state (position, hop, node), a backward pass
    those from it to the end; a step's flow is the product. Where a walk started is not part of the state, so that states
    are no more than nodes times hops. Where there is a least accumulated probability, what a walk has accumulated is part
    of the state, so that there are as many more as there are different products. Numbers of ways up to 2^63 are exact; more
    raise an error.

    max_depth bounds the hops of a pattern with one edge position; elsewhere it must not be below their sum. WALK has no
    accumulated probability; paths of a layered pattern do. Both raise an error rather than be ignored."""
    if pattern.mode == "WALK" and pattern.min_accumulated > 0:
        raise ValueError("a WALK has no accumulated probability; use TRAIL, ACYCLIC or SIMPLE")
    if len(pattern.edges) > 1 and sum(e.max_hops for e in pattern.edges) > pattern.max_depth:
        raise ValueError("the hops of a WALK over several positions may not go beyond max_depth")
    sets = [node_set(graph, n) for n in pattern.nodes]
    weighed = pattern.min_accumulated > 0
    state = ["v", "chance"] if weighed else ["v"]
    total = lambda rows, c: rows.groupBy(*state).agg(_exact_sum(c).alias(c))
    at = sets[0].select(F.col("node_id").alias("v"), *([F.lit(1.0).alias("chance")] if weighed else []), F.lit(1).cast("bigint").alias("c"))
    layers = []  # of each segment: (transitions of each hop, edge, steps, ...)
    for seg, edge in enumerate(pattern.edges, 1):
        most = min(edge.max_hops, pattern.max_depth)
        allowed, target = cut(steps(graph, edge)), sets[seg]
        inner = graph.nodes.where(edge.through).select("node_id") if edge.through is not None else None
        hops, done, frontier = [], [], at
        if edge.min_hops == 0:
            done.append(_among(at, "v", target))
        for hop in range(1, most + 1):
            taken = frontier.withColumnRenamed("v", "u").join(allowed, "u")
            if weighed:
                taken = taken.withColumnRenamed("chance", "had").withColumn("chance", F.col("had") * F.col("p")).where(F.col("chance") >= pattern.min_accumulated)
            taken = cut(taken.select("u", "src", "dst", "c", *state, *(["had"] if weighed else [])))
            hops.append(taken)
            reached = total(taken, "c")
            if hop >= edge.min_hops:
                done.append(_among(reached, "v", target))
            frontier = reached if inner is None else _among(reached, "v", inner)
        none = at.where("false")
        at = cut(total(reduce(DataFrame.unionByName, done, none), "c"))
        layers.append((hops, edge, allowed, target, inner))
    after = at.select(*state, F.lit(1).cast("bigint").alias("b"))
    flows, marks = [], [after.select(F.col("v").alias("node_id"), F.lit(len(pattern.edges)).alias("seg"))]
    for seg in range(len(layers) - 1, -1, -1):
        hops, edge, allowed, target, inner = layers[seg]
        onward = after.where("false").select(*state, "b")
        for hop in range(len(hops), 0, -1):
            last = _among(after, "v", target) if hop >= edge.min_hops else after.where("false")
            on = onward if inner is None else _among(onward, "v", inner)
            good = cut(hops[hop - 1].join(total(last.unionByName(on), "b"), state))
            ways = F.coalesce(F.try_multiply("c", "b"), F.raise_error(F.lit("more walks than a long holds")).cast("bigint"))
            flows.append((good.select("src", "dst", ways.alias("f")), edge, allowed))
            marks.append(good.select(F.col("u").alias("node_id"), F.lit(-1).alias("seg")))
            onward = total(good.select(F.col("u").alias("v"), *([F.col("had").alias("chance")] if weighed else []), "b"), "b")
        zero = _among(after, "v", target) if edge.min_hops == 0 else after.where("false")
        after = cut(total(onward.unionByName(zero.select(*state, "b")), "b"))
        marks.append(after.select(F.col("v").alias("node_id"), F.lit(seg).alias("seg")))
    nodes = reduce(DataFrame.unionByName, marks).groupBy("node_id").agg(F.max("seg").alias("seg"))
    return GraphResult(nodes.select("node_id", _labels(pattern).alias("reference")), _typed_flows(flows))


def union(*results: GraphResult) -> GraphResult:
    """Of several queries: flows add up, types are united, the largest label of a node stays."""
    from .graph import merge_results

    nodes = reduce(DataFrame.unionByName, [r.nodes for r in results]).groupBy("node_id").agg(F.max("reference").alias("reference"))
    return GraphResult(nodes, merge_results(*[r.edges for r in results]))


def result_counts(result: GraphResult, nodes: DataFrame) -> DataFrame:
    """(kind, name, n): result nodes by type and by label, and the totals."""
    typed = result.nodes.join(nodes.select("node_id", "type"), "node_id").groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("type").alias("kind"), "name", "n")
    labels = result.nodes.where("reference is not null").groupBy(F.col("reference").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("label").alias("kind"), "name", "n")
    total = result.edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit("edges").alias("name"), "n")
    return typed.union(labels).union(total)


def path_details(graph: PropertyGraph, nodes: DataFrame) -> DataFrame:
    """nodes (seq, node_id) along a path -> (seq, src, dst, edge_type, prob) between each and the next, in either direction."""
    after = nodes.select((F.col("seq") - 1).alias("seq"), F.col("node_id").alias("next"))
    near = nodes.join(after, "seq")
    e = graph.edges
    there = near.join(e, (near.node_id == e.src) & (near.next == e.dst)).select("seq", "src", "dst", "edge_type", "prob")
    back = near.join(e, (near.node_id == e.dst) & (near.next == e.src)).select("seq", "src", "dst", "edge_type", "prob")
    return there.union(back).distinct()
