"""Graph algorithms as loops of joins and aggregations; lineage is cut in each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import by_few, cut, keyed


def reach(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(seed, node_id, hops): nodes that each seed (node_id) reaches, and in how few hops; itself in 0."""
    links = cut(edges.select("src", "dst").where("src <> dst").distinct())
    frontier = cut(seeds.select(F.col("node_id").alias("seed"), "node_id").distinct().withColumn("hops", F.lit(0)))
    seen, hop, n_links, n = frontier, 0, links.count(), frontier.count()
    n_seen = n
    while max_hops is None or hop < max_hops:
        hop += 1
        near = frontier.join(keyed(links, min(n, n_links)), F.col("node_id") == F.col("src")).select("seed", F.col("dst").alias("node_id")).distinct()
        frontier = cut(near.join(keyed(seen.select("seed", "node_id"), n_seen), ["seed", "node_id"], "left_anti").withColumn("hops", F.lit(hop)))
        n = frontier.count()
        if not n:
            break
        seen, n_seen = seen.unionByName(frontier), n_seen + n
    return seen


def reach_states(links: DataFrame, seeds: DataFrame, step, max_hops: int | None = None) -> DataFrame:
    """(seed, node_id, state, hops): the nodes that each seed reaches together with the states it can be in there.

    A walk over the product of the graph with an automaton. seeds: (node_id, state), or (seed, node_id, state). links: (src,
    dst) and whatever else step() reads; step gives the state after a link as a Column over state and these columns, or
    null where the link may not be taken in that state. Each (seed, node, state) is reached once, in the fewest hops, so that
    cycles end; there are at most as many rows a seed as nodes times states."""
    links = cut(links.where("src <> dst"), "links")
    if "seed" not in seeds.columns:
        seeds = seeds.withColumn("seed", F.col("node_id"))
    frontier = cut(seeds.select("seed", "node_id", "state").distinct().withColumn("hops", F.lit(0)), "frontier")
    seen, hop = frontier, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        near = frontier.withColumnRenamed("node_id", "src").join(links, "src").withColumn("state", step(F.col("state"))).where("state is not null")
        near = near.select("seed", F.col("dst").alias("node_id"), "state").distinct()
        frontier = cut(near.join(seen.select("seed", "node_id", "state"), ["seed", "node_id", "state"], "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen


#: Minima of up to so many nodes, 16 bytes each, are broadcast.
MOST_BROADCAST = 1_000_000


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, component): the smallest id of the connected component, edges (src, dst) taken in both directions.

    Alternating star contractions: each round hangs every larger neighbour of a node, then every smaller-or-equal one, on
    the smallest of them; the number of rounds grows with the logarithm of the longest chain. Minima are pre-aggregated
    before the shuffle; what is broadcast is gathered by few tasks. An empty table gives an empty result; repeated edges and loops change nothing."""

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()

    everyone = edges.select(F.col("src").alias("node_id")).union(edges.select("dst"))
    if nodes is not None:
        everyone = everyone.union(nodes.select("node_id"))
    links = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "links")
    was = state(links)
    while was[0]:
        nodes_left = 2 * was[0]  # an edge has two nodes
        few = (lambda minima: by_few(minima, nodes_left)) if nodes_left <= MOST_BROADCAST else lambda minima: minima  # noqa: B023
        small = F.broadcast if nodes_left <= MOST_BROADCAST else lambda minima: minima
        both = links.union(links.select("v", "u"))
        least = few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        hung = both.where("v > u").join(small(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(hung.where("u <> v").distinct(), "stars", nodes_left)
        down = few(large.groupBy("u").agg(F.min("v").alias("m")))
        again = large.join(small(down), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = cut(again.union(down.select("u", "m")).distinct(), "links", nodes_left)
        now = state(links)
        if now == was:
            break
        was = now
    named = links.select(F.col("u").alias("node_id"), F.col("v").alias("component"))
    return everyone.distinct().join(keyed(named, was[0]) if was[0] > MOST_BROADCAST else named, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def _ends(links: DataFrame) -> DataFrame:
    """(x, ins, outs, a, b): how many links (u, v) a node has in and out, and the greatest node that has one to it and from it."""
    ends = links.select(F.col("u").alias("x"), F.lit(None).cast("bigint").alias("a"), F.col("v").alias("b")).union(links.select("v", "u", F.lit(None).cast("bigint")))
    return cut(ends.groupBy("x").agg(F.count("a").alias("ins"), F.count("b").alias("outs"), F.max("a").alias("a"), F.max("b").alias("b")), "ends")


def _trimmed(links: DataFrame, size: int) -> tuple[DataFrame, int, DataFrame | None, int, int]:
    """links (u, v) without nodes that have none in or none out, layer by layer as long as these have a tenth of the links; how
    many links are left, their ends, the number of nodes with one link in and one out, and that of all nodes."""
    while size:
        ends = _ends(links)
        total, single, lost = ends.agg(F.count(F.lit(1)), F.count_if(F.expr("ins = 1 and outs = 1")), F.sum(F.expr("if(ins = 0 or outs = 0, ins + outs, 0)"))).first()
        if 10 * lost < size:
            return links, size, ends, single, total
        kept = ends.where("ins > 0 and outs > 0").select("x")
        links = cut(links.join(keyed(kept.withColumnRenamed("x", "u"), total), "u", "left_semi").join(keyed(kept.withColumnRenamed("x", "v"), total), "v", "left_semi").select("u", "v"), "links")
        size = links.count()
    return links, 0, None, 0, 0


def _connected(links: DataFrame, ends: DataFrame, total: int) -> DataFrame:
    """(node_id, region): the connected components of links (u, v) between `total` nodes. Each node is hung on its greatest neighbour first, so that
    only the links between such trees, of which there are few where nodes have many, are contracted."""
    trees = components(ends.select(F.col("x").alias("src"), F.greatest("a", "b").alias("dst"))).toDF("node_id", "tree")
    trees = cut(trees, "trees")
    of = lambda c: keyed(trees.select(F.col("node_id").alias(c), F.col("tree").alias(f"of_{c}")), total)
    between = links.join(of("u"), "u").join(of("v"), "v").where("of_u <> of_v").select(F.col("of_u").alias("src"), F.col("of_v").alias("dst")).distinct()
    joined = components(cut(between, "between")).toDF("tree", "component")
    return trees.join(joined, "tree", "left").select("node_id", F.coalesce("component", "tree").alias("region"))


def _contracted(links: DataFrame, middles: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chains of nodes with one link in and one out become a link each: (links left, chains (x, a, b), cycles (node_id, scc)).

    Each node of a chain learns the nodes a and b at its ends by pointer jumping: its pointers go twice as far in each
    round, so that rounds grow with the logarithm of the longest chain. What points to such a node after 2^k >= n steps is on a
    cycle of them alone."""
    state, steps = cut(middles.withColumn("low", F.col("x")), "chains"), 1
    while True:
        other = state.select(F.col("x").alias("y"), F.col("a").alias("ya"), F.col("b").alias("yb"), F.col("low").alias("ylow"))
        ahead = other.select(F.col("y").alias("b"), F.col("yb").alias("next_b"), F.col("ylow").alias("low_b"))
        behind = other.select(F.col("y").alias("a"), F.col("ya").alias("next_a"))
        open_ = state.join(keyed(ahead, n), "b", "left").join(keyed(behind, n), "a", "left")
        if steps >= 2 * n or not open_.where("next_a is not null or next_b is not null").take(1):
            break
        moved = open_.select("x", F.coalesce("next_a", "a").alias("a"), F.coalesce("next_b", "b").alias("b"), F.least("low", F.coalesce("low_b", "low")).alias("low"))
        state, steps = cut(moved, "chains"), steps * 2
    around = keyed(middles.select(F.col("x").alias("b")), n)
    cycles = state.join(around, "b", "left_semi").select(F.col("x").alias("node_id"), F.col("low").alias("scc"))
    chains = state.join(around, "b", "left_anti").select("x", "a", "b")
    rest = links.join(keyed(middles.select(F.col("x").alias("u")), n), "u", "left_anti").join(keyed(middles.select(F.col("x").alias("v")), n), "v", "left_anti").select("u", "v")
    made = chains.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return cut(rest.union(made).distinct(), "links"), cut(chains, "chains"), cut(cycles, "cycles")


def _two_ways(links: DataFrame, pivots: DataFrame) -> DataFrame:
    """(node_id, forward, backward) of the nodes that pivots (node_id) reach along links (u, v), and against them; both at once."""
    both = cut(links.select(F.lit(True).alias("way"), F.col("u").alias("at"), F.col("v").alias("node_id")).union(links.select(F.lit(False), "v", "u")), "both")
    frontier = cut(pivots.select("node_id", F.explode(F.array(F.lit(True), F.lit(False))).alias("way")), "frontier")
    seen, n = frontier, frontier.count()
    n_seen = n
    while True:
        near = keyed(frontier.withColumnRenamed("node_id", "at"), n).join(both, ["at", "way"]).select("node_id", "way").distinct()
        frontier = cut(near.join(keyed(seen, n_seen), ["node_id", "way"], "left_anti"), "frontier")
        n = frontier.count()
        if not n:
            return seen.groupBy("node_id").agg(F.bool_or("way").alias("forward"), F.bool_or(~F.col("way")).alias("backward"))
        seen, n_seen = seen.unionByName(frontier), n_seen + n


def strongly_connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, scc): the smallest id of the strongly connected component.

    Nodes without incoming or outgoing edges are components of their own and are trimmed where they have many edges; where many
    nodes have one edge in and one out, chains of these become single edges, in rounds that grow with the logarithm of
    their length. What is left is split into connected regions. Each region has a pivot, the node with the most pairs of an
    edge in and one out, and all of them reach forwards and backwards at once: what a pivot reaches both ways is its
    component, and what it reaches one way, the other, or not at all are three regions that share no component. Where a
    round leaves most edges, the regions are the connected components of what is left.

    Nodes of a contracted chain are in the component of its ends if these are in one, and components of their own otherwise."""
    pairs = cut(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct(), "links")
    everyone = pairs.select(F.col("u").alias("node_id")).union(pairs.select("v"))
    everyone = cut((everyone if nodes is None else everyone.union(nodes.select("node_id"))).distinct(), "nodes")
    left, n = pairs.where("u <> v"), everyone.count()
    found, contracted, size = [], [], left.count()
    regions, split = None, True  # (node_id, region); whether they are to be made anew, of what is connected
    while size:
        while size:
            left, size, ends, single, total = _trimmed(left, size)
            if 4 * single <= total:
                break
            left, chains, cycles = _contracted(left, ends.where("ins = 1 and outs = 1").select("x", "a", "b"), single)
            found.append(cycles)
            contracted.append((chains, single))
            size = left.count()
        if not size:
            break
        if split:
            regions = cut(_connected(left, ends, total), "regions")
        alive = ends.where("ins > 0 and outs > 0").select(F.col("x").alias("node_id"), (F.col("ins") * F.col("outs")).alias("weight"))
        alive = cut(alive.join(keyed(regions, total), "node_id"), "alive")
        pivots = alive.groupBy("region").agg(F.max_by("node_id", F.struct("weight", "node_id")).alias("node_id")).select("node_id")
        marked = alive.select("node_id", "region").join(keyed(_two_ways(left, pivots), total), "node_id", "left")
        marked = cut(marked.select("node_id", "region", F.coalesce("forward", F.lit(False)).alias("f"), F.coalesce("backward", F.lit(False)).alias("b")), "marked")
        inside = marked.where("f and b")
        found.append(inside.join(inside.groupBy("region").agg(F.min("node_id").alias("scc")), "region").select("node_id", "scc"))
        regions = marked.where("not (f and b)").select("node_id", F.xxhash64("region", "f", "b").alias("region"))
        of = lambda c: keyed(regions.select(F.col("node_id").alias(c), F.col("region").alias(f"of_{c}")), total)  # noqa: B023, E731
        was = size
        left = cut(left.join(of("u"), "u").join(of("v"), "v").where("of_u = of_v").select("u", "v"), "links")
        size = left.count()
        split, regions = 2 * size > was, cut(regions, "regions")
    named = everyone.select("node_id", F.col("node_id").alias("scc"))
    if found:
        all_found = found[0]
        for more in found[1:]:
            all_found = all_found.union(more)
        named = everyone.join(keyed(all_found.withColumnRenamed("scc", "of"), n), "node_id", "left").select("node_id", F.coalesce("of", "node_id").alias("scc"))
    for chains, of_chains in reversed(contracted):  # the ends of a chain may be in one that was contracted later
        named = cut(named, "named")
        end = lambda c: keyed(named.select(F.col("node_id").alias(c), F.col("scc").alias(f"scc_{c}")), of_chains)  # noqa: B023, E731
        same = chains.join(end("a"), "a").join(end("b"), "b").where("scc_a = scc_b").select(F.col("x").alias("node_id"), F.col("scc_a").alias("of"))
        named = named.join(keyed(same, of_chains), "node_id", "left").select("node_id", F.coalesce("of", "scc").alias("scc"))
    named = cut(named, "named")
    least = cut(named.groupBy("scc").agg(F.min("node_id").alias("least")), "least")
    return named.join(keyed(least, least.count()), "scc").select("node_id", F.col("least").alias("scc"))


def condensation(edges: DataFrame, scc: DataFrame, rows: int = 0) -> DataFrame:
    """Distinct edges between different components, named by their ids. rows: how many nodes there are, if known."""
    s = keyed(scc.select("node_id", "scc"), rows)
    joined = edges.select("src", "dst").join(s.toDF("src", "a"), "src").join(s.toDF("dst", "b"), "dst")
    return joined.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


class NotAcyclic(ValueError):
    pass


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, level): the longest distance from a node without incoming edges; raises NotAcyclic on a cycle."""
    left_edges, left, done, level = cut(edges.select("src", "dst").distinct()), cut(nodes.select("node_id").distinct()), None, 0
    while left.take(1):
        blocked = left_edges.select(F.col("dst").alias("node_id")).distinct()
        ready = cut(left.join(blocked, "node_id", "left_anti").withColumn("level", F.lit(level)))
        if not ready.take(1):
            raise NotAcyclic("the graph has a cycle")
        done = ready if done is None else done.unionByName(ready)
        gone = ready.select("node_id")
        left = cut(left.join(gone, "node_id", "left_anti"))
        left_edges = cut(left_edges.join(gone.withColumnRenamed("node_id", "src"), "src", "left_anti"))
        level += 1
    return done if done is not None else left.withColumn("level", F.lit(0))


def hop_distances(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, hops) of all ordered pairs that are connected, self in 0."""
    return reach(edges, nodes).select(F.col("seed").alias("src"), F.col("node_id").alias("dst"), "hops")


def propagate_value(edges: DataFrame, values: DataFrame, mode: str = "direct") -> DataFrame:
    """values (node_id, value) -> (node_id, power): the total of the node's component, and of the components after it.

    direct: for each component that follows directly, its own total times (1 + size of the node's component);
    transitive: the total of every component that can be reached, once."""
    scc = cut(strongly_connected(edges, values))
    n = scc.count()
    own = scc.join(keyed(values, n), "node_id").groupBy("scc").agg(F.sum("value").alias("own"), F.count(F.lit(1)).alias("size"))
    own = cut(own, "own")
    groups, dag = own.count(), cut(condensation(edges, scc, n))
    if mode == "direct":
        after = dag.join(keyed(own.select(F.col("scc").alias("dst"), F.col("own").alias("next")), groups), "dst").groupBy(F.col("src").alias("scc")).agg(F.sum("next").alias("next"))
        power = own.join(keyed(after, groups), "scc", "left").select("scc", (F.col("own") + F.coalesce("next", F.lit(0)) * (1 + F.col("size"))).alias("power"))
    else:
        far = reach(dag, own.select(F.col("scc").alias("node_id")))
        power = far.join(keyed(own.select(F.col("scc").alias("node_id"), "own"), groups), "node_id").groupBy(F.col("seed").alias("scc")).agg(F.sum("own").alias("power"))
    return scc.join(keyed(power, groups), "scc").select("node_id", "power")


def label_communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node_id, community) by label propagation: each round a node takes the most frequent label near it, the smallest of equal ones."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct())
    labels = both.select(F.col("src").alias("node_id")).distinct().withColumn("community", F.col("node_id"))
    for _ in range(rounds):
        near = both.join(labels.toDF("dst", "community"), "dst").groupBy("src", "community").agg(F.count(F.lit(1)).alias("n"))
        labels = cut(near.groupBy(F.col("src").alias("node_id")).agg(F.max_by("community", F.struct("n", -F.col("community"))).alias("community")))
    return labels


def dn_chain(attr: DataFrame, target: str, depth: int = 10) -> DataFrame:
    """attr (node_id, dn, points_to): nodes whose points_to is the target DN, directly or through the DNs of others, in at most `depth` steps."""
    rows = cut(attr.select("node_id", F.lower("dn").alias("dn"), F.lower("points_to").alias("to")))
    frontier = rows.where(F.col("to") == target.lower()).select("node_id", "dn").distinct()
    seen = cut(frontier)
    frontier = seen
    for _ in range(depth):
        more = rows.join(frontier.select(F.col("dn").alias("to")), "to").select("node_id", "dn").distinct()
        frontier = cut(more.join(seen.select("node_id"), "node_id", "left_anti"))
        if not frontier.take(1):
            break
        seen = seen.union(frontier)
    return seen.select("node_id").distinct()
