"""Entity resolution: nodes of several sources that share a merge key become one node; upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import VALUE, sorted_union
from ..store import cut
from .algorithms import components


def _values(attr: str):
    return F.coalesce(F.col("attrs")[attr], F.array().cast(f"array<{VALUE}>"))


def _key_list(keys: tuple[str, ...]):
    """All values of the key attributes, each under its attribute's name."""

    def of(k: str):
        return F.transform(_values(k), lambda v: F.concat(F.lit(f"{k}="), F.lower(v["s"])))

    return F.concat(F.array().cast("array<string>"), *[of(k) for k in keys])


def merge_map(nodes: DataFrame, keys: tuple[str, ...], single: tuple[str, ...] = (), always: tuple[str, ...] = (), exclusive: tuple[str, ...] = ("machine",), sourced: str | None = None) -> DataFrame:
    """(node_id, into): nodes with an equal value (ignoring case) of a key attribute and no conflict go into the smallest id.

    Two nodes conflict when both have a type and the types differ, when one and only one of them is of an exclusive type, or
    when both have different values of an attribute of `single`. Nodes with an attribute `sourced` stay apart. Equal values
    of `always` merge in any case.

    A node's signature is its type and single values. Nodes of a key that agree in a signature without gaps go together; a
    node with gaps goes to the most complete signature of one of its keys that it fits (the smallest id of equal ones), and
    among themselves nodes with gaps go together if they agree. What has merged takes part again with all its keys, until
    nothing merges. So no component holds a conflict, and what fits into some entity is in one."""
    parts = ["t", *[f"s{i}" for i in range(len(single))]]
    first = [F.lower("type").alias("t"), *[F.lower(F.col("attrs")[s][0]["s"]).alias(f"s{i}") for i, s in enumerate(single)]]
    apart = F.size(_values(sourced)) > 0 if sourced else F.lit(False)
    state = cut(nodes.select("node_id", F.col("node_id").alias("rep"), _key_list(keys).alias("keys"), *first, apart.alias("apart"), _key_list(always).alias("always")), "merge")
    same = state.select("node_id", F.explode("always").alias("key"))
    heads = same.groupBy("key").agg(F.min("node_id").alias("dst"), F.count_distinct("node_id").alias("n")).where("n > 1").select("key", "dst")
    links = same.join(heads, "key").select(F.col("node_id").alias("src"), "dst").where("src <> dst") if always else None
    while True:
        if links is None:
            links = _round(state, parts, exclusive)
        links = cut(links, "links")
        if not links.take(1):
            break
        to = components(links).toDF("rep", "to")
        state = cut(state.join(to, "rep", "left").withColumn("rep", F.coalesce("to", "rep")).drop("to"), "merge")
        links = None
    return _moved(state)


def _moved(state: DataFrame) -> DataFrame:
    """The nodes of entities of several nodes."""
    several = state.where("node_id <> rep").select("rep").distinct()
    return state.join(several, "rep", "left_semi").select("node_id", F.col("rep").alias("into"))


def _round(state: DataFrame, parts: list[str], exclusive: tuple[str, ...]) -> DataFrame:
    """Links (src, dst) between entities that may merge now."""
    keys = F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys")
    reps = state.groupBy("rep").agg(keys, *[F.max(c).alias(c) for c in parts], F.max("apart").alias("apart")).where(~F.col("apart"))
    gaps = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in parts])
    rows = cut(reps.select("rep", F.explode("keys").alias("key"), F.struct(*parts).alias("sig"), gaps.alias("gaps")), "keys")
    groups = rows.groupBy("key", "sig", "gaps").agg(F.min("rep").alias("head"))

    def together(some: DataFrame) -> DataFrame:
        head = some.groupBy("key", "sig").agg(F.min("rep").alias("dst"))
        return some.join(head, ["key", "sig"]).where("rep <> dst").select(F.col("rep").alias("src"), "dst")

    fits = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"sig.{c}") == F.col(f"to.{c}"), F.lit(True)) for c in parts])
    only = lambda c: F.coalesce(F.col(f"{c}.t").isin(*exclusive), F.lit(False))
    partial = rows.where("gaps > 0")
    other = groups.select("key", F.col("sig").alias("to"), F.col("gaps").alias("to_gaps"), "head")
    asked = partial.join(other, "key").where((F.col("to_gaps") < F.col("gaps")) & fits & (only("sig") == only("to")))
    target = cut(asked.groupBy("rep", "sig").agg(F.min(F.struct("to_gaps", "head")).alias("x")).select("rep", "sig", "x.*"), "targets")
    stable = target.join(target.select(F.col("rep").alias("head")), "head", "left_anti")  # an entity that moves itself takes nobody in
    leading = stable.where("to_gaps > 0").groupBy("head").agg(F.min("sig").alias("lead"))
    taken = stable.join(leading, "head", "left").where("to_gaps = 0 or sig <=> lead").select(F.col("rep").alias("src"), F.col("head").alias("dst"))
    left = partial.join(target.select("rep"), "rep", "left_anti")
    return together(rows.where("gaps = 0")).union(taken).union(together(left)).distinct()


def merge_nodes(nodes: DataFrame, mapping: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """One node for each target: attributes united value by value, but for those in drop, of which the target's own stay."""
    moved = nodes.join(mapping, "node_id", "left").withColumn("into", F.coalesce("into", "node_id"))
    flat = moved.select("into", F.col("node_id"), F.explode("attrs").alias("name", "vals")).where(~F.col("name").isin(*drop) | (F.col("into") == F.col("node_id")) if drop else F.lit(True))
    united = flat.groupBy("into", "name").agg(sorted_union(F.flatten(F.collect_list("vals"))).alias("vals"))
    attrs = united.groupBy("into").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "vals")))).alias("attrs"))
    parents = mapping.select(F.col("node_id").alias("parent_id"), F.col("into").alias("new_parent"))
    rest = moved.groupBy("into").agg(F.min_by("type", "node_id").alias("type"), F.min_by("parent_id", F.when(F.col("parent_id").isNotNull(), F.col("node_id"))).alias("parent_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))
    placed = rest.join(parents, "parent_id", "left").withColumn("parent_id", F.coalesce("new_parent", "parent_id"))
    return placed.join(attrs, "into", "left").select(F.col("into").alias("node_id"), "type", "attrs", "parent_id", "tags")


def merge_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between the targets; what would point at itself goes, equal edges keep the largest probability."""
    a, b = mapping.toDF("src", "to_src"), mapping.toDF("dst", "to_dst")
    moved = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("to_src", "src").alias("src"), F.coalesce("to_dst", "dst").alias("dst"), "edge_type", "prob")
    return moved.where("src <> dst").groupBy("src", "dst", "edge_type").agg(F.max("prob").alias("prob"))


def adopt_orphans(nodes: DataFrame, container: int) -> DataFrame:
    """Nodes without a parent get the container (unless they are it)."""
    return nodes.withColumn("parent_id", F.when(F.col("parent_id").isNull() & (F.col("node_id") != container), F.lit(container)).otherwise(F.col("parent_id")))


def missing_keys(nodes: DataFrame, wanted: DataFrame, attr: str) -> DataFrame:
    """Distinct wanted keys (key) that no node has as that attribute, ignoring case: what an upsert has to add."""
    have = nodes.select(F.explode(F.col("attrs")[attr]).alias("v")).select(F.lower("v.s").alias("low")).distinct()
    return wanted.where("key is not null").groupBy(F.lower("key").alias("low")).agg(F.min("key").alias("key")).join(have, "low", "left_anti").select("key")


def find_or_add(nodes: DataFrame, wanted: DataFrame, attr: str, type_name: str, first_id: int) -> DataFrame:
    """nodes and a new node for each missing key, whose id is first_id and a hash of the key."""
    from ..functions.values import attributes

    new = missing_keys(nodes, wanted, attr)
    numbered = new.withColumn("node_id", (F.xxhash64(F.lower("key")).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(first_id)))
    row = numbered.select("node_id", F.lit(type_name).alias("type"), attributes(**{attr: ("string", F.col("key"))}).alias("attrs"), F.lit(None).cast("bigint").alias("parent_id"), F.array().cast("array<string>").alias("tags"))
    return nodes.select("node_id", "type", "attrs", "parent_id", "tags").unionByName(row)


def adjacent_ids(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (sid, context, source, own) -> with node_id: the node that a security id means near another node.

    An id of a domain (S-1-5-21-...) means the node with it, whichever; under a machine's own id (own, with its source) the
    one of that source. Others mean the node of the same domain context, else of the same source, else any. Of several the
    smallest; none leaves node_id null, which find_or_add() can add."""
    low = lambda a, n: F.lower(F.col("attrs")[a][0]["s"]).alias(n)
    known = nodes.select("node_id", low("objectsid", "low"), low("domaincontext", "at_context"), low("datasource", "at_source")).where("low is not null")
    rows = asked.withColumn("low", F.lower("sid")).join(known, "low", "left")
    local = F.col("own").isNotNull() & F.col("low").startswith(F.concat(F.lower("own"), F.lit("-")))
    in_domain = F.col("low").startswith("s-1-5-21-") & ~F.col("low").startswith("s-1-5-21-0-")
    near_context, near_source = F.lower("context") == F.col("at_context"), F.lower("source") == F.col("at_source")
    rank = F.when(local, F.when(near_source, 0)).when(in_domain, 0).when(near_context, 0).when(near_source, 1).otherwise(2)
    best = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("node_id").alias("n"))))
    return rows.groupBy(*asked.columns).agg(best.alias("x")).select(*asked.columns, F.when(F.col("x.n").isNotNull(), F.col("x.n")).alias("node_id"))


def unique_values(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key))).where("n = 1").drop("n")


def collisions(rows: DataFrame, key: str, node: str = "node_id") -> DataFrame:
    """(key, first, n): keys that several nodes share, in a row each; what to read where a key may be very common."""
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(node).alias("first"), F.count_distinct(node).alias("n")).where("n > 1")


#: Nodes of a key that a cell of collision_pairs() holds on each side, about: it gives no more than their product.
BLOCK_NODES = 1000


def collision_pairs(rows: DataFrame, key: str, node: str = "node_id") -> DataFrame:
    """(a, b), a < b: nodes that share a key, all pairs of them, once each; see collisions() for a row a key.

    The nodes of a key are dealt to blocks, and each two blocks meet in a cell of their own, so that a common key is spread
    over the tasks and what one holds does not grow with it. Only pairs of nodes with several keys can arise twice and are
    compared with each other."""
    x = cut(rows.select(F.col(key).alias("key"), F.col(node).alias("a")).where("key is not null").distinct(), "keys")
    size = x.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / BLOCK_NODES).cast("int").alias("blocks"))
    several = x.groupBy("a").agg((F.count(F.lit(1)) > 1).alias("several"))
    dealt = x.join(size, "key").join(several, "a").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    left = dealt.select("key", "a", F.col("several").alias("several_a"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = dealt.select("key", F.col("a").alias("b"), F.col("several").alias("several_b"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"))
    met = left.join(right, ["key", "i", "j"]).where("i < j or a < b")
    pair = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    twice = F.col("several_a") & F.col("several_b")
    return met.where(~twice).select(*pair).unionByName(met.where(twice).select(*pair).distinct())
