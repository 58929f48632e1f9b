"""Merges under the OR rule, components and walks along prerequisite edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocking_pairs(members: DataFrame) -> DataFrame:
    """a, b, paper_id: clusters a < b with questions that are alternatives of one another in a paper (the first such).

    members: cluster, paper_id, or_group; null groups block nothing. The join is within one question's alternatives.
    """
    some = members.where("or_group is not null").select("paper_id", "or_group", "cluster").distinct()
    other = some.select("paper_id", "or_group", F.col("cluster").alias("b"))
    pairs = some.withColumnRenamed("cluster", "a").join(other, ["paper_id", "or_group"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.min("paper_id").alias("paper_id"))


def components(edges: DataFrame, saved) -> DataFrame:
    """id, component (least id reachable) for the ends of edges (a, b).

    Labels spread to neighbours and along labels of labels, so a chain of n takes about log n rounds. saved(df) must cut
    the lineage of df where lost executors cannot take it along.
    """
    both = saved(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        new = labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("l", "m").alias("l"))
        hop = new.select(F.col("id").alias("_i"), F.col("l").alias("_l"))
        new = saved(new.join(hop, new["l"] == hop["_i"], "left").select("id", F.least("l", "_l").alias("l")))
        if not new.join(labels.withColumnRenamed("l", "was"), "id").where("l <> was").take(1):
            return new.select("id", F.col("l").alias("component"))
        labels = new


def merged(pairs: DataFrame, members: DataFrame, saved) -> DataFrame:
    """cluster, survivor, rejected for the ends of pairs (a, b).

    Pairs that the OR rule blocks go first. A component in which the rule would still be broken, as transitivity can
    reunite alternatives, is rejected whole: its clusters survive as themselves.
    """
    blocked = saved(blocking_pairs(members))
    legal = pairs.join(blocked.select("a", "b"), ["a", "b"], "left_anti")
    found = components(legal, saved)
    x, y = (found.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    broken = blocked.join(x, "a").join(y, "b").where("ca = cb").select(F.col("ca").alias("component")).distinct().withColumn("rejected", F.lit(True))
    out = found.join(broken, "component", "left").withColumn("rejected", F.coalesce("rejected", F.lit(False)))
    return out.select(F.col("id").alias("cluster"), F.when(F.col("rejected"), F.col("id")).otherwise(F.col("component")).alias("survivor"), "rejected")


def version_conflicts(rows: DataFrame) -> DataFrame:
    """Rows whose expected version is not the stored one; no expectation is no check."""
    return rows.where("expected_version is not null and not (expected_version <=> version)")


def peeled(edges: DataFrame, nodes: DataFrame, saved) -> tuple[DataFrame, DataFrame]:
    """(layers, rest) of edges (upper, lower): node and depth, the longest way down to it; and the edges among all other nodes.

    A round takes off the nodes that no edge of those left leads to, so paths are never listed and rounds are as many as
    the longest way, whatever cycles there are. The rest holds the nodes that are on a cycle or below one.
    """
    left = saved(edges.select("upper", "lower").where("upper is not null and lower is not null").distinct())
    nodes = saved(nodes.select("node").unionByName(left.select(F.explode(F.array("upper", "lower")).alias("node"))).distinct())
    layers, level = None, 0
    while True:
        off = saved(nodes.join(left.select(F.col("lower").alias("node")).distinct(), "node", "left_anti"))
        if not off.take(1):
            layers = off.select("node", F.lit(0).cast("long").alias("depth")) if layers is None else layers
            return layers, left
        layer = off.select("node", F.lit(level).cast("long").alias("depth"))
        layers, level = layer if layers is None else layers.unionByName(layer), level + 1
        nodes = saved(nodes.join(off, "node", "left_anti"))
        left = saved(left.join(off.withColumnRenamed("node", "upper"), "upper", "left_anti"))


HOPS = 4  # steps along edges between two cuts of lineage


def trimmed(edges: DataFrame, saved) -> DataFrame:
    """The edges (upper, lower) that are left once nodes which nothing leads to, or which lead nowhere, are taken off again and again."""
    left, size = edges, edges.count()
    while size:
        for _ in range(HOPS):
            led, leads = left.select(F.col("lower").alias("upper")).distinct(), left.select(F.col("upper").alias("lower")).distinct()
            left = left.join(led, "upper", "left_semi").join(leads, "lower", "left_semi").select("upper", "lower")
        left = saved(left)
        size, before = left.count(), size
        if size == before:
            break
    return left


def cycles(edges: DataFrame, saved) -> DataFrame:
    """node, component (its least node) of all nodes on cycles of edges (upper, lower): the strongly connected components.

    Nodes that nothing leads to or that lead nowhere are trimmed first. Then each node takes the greatest name among those
    that reach it, as its colour; the nodes of a colour that reach the node of that name are its component. They are taken
    off, the rest is trimmed and coloured again. Rounds follow the length of ways, not the number of nodes.
    """
    left = saved(edges.select("upper", "lower").where("upper is not null and lower is not null").distinct())
    loops = left.where("upper = lower").select(F.col("upper").alias("node"))
    found = None
    while True:
        left = trimmed(left, saved)
        if not left.take(1):
            break
        colours = saved(left.select(F.col("upper").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            new = colours.withColumn("_was", F.col("colour"))
            for _ in range(HOPS):
                near = left.join(new.select(F.col("node").alias("upper"), "colour"), "upper").groupBy(F.col("lower").alias("node")).agg(F.max("colour").alias("_c"))
                new = new.join(near, "node", "left").select("node", F.greatest("colour", "_c").alias("colour"), "_was")
            new = saved(new)
            if not new.where("colour <> _was").take(1):
                break
            colours = new.drop("_was")
        same = left.join(colours.select(F.col("node").alias("upper"), F.col("colour").alias("_u")), "upper").join(colours.select(F.col("node").alias("lower"), F.col("colour").alias("_l")), "lower").where("_u = _l")
        same = saved(same.select("upper", "lower", F.col("_u").alias("colour")))
        back = same.select("upper", F.col("lower").alias("node"), "colour")
        frontier = colours.where("node = colour").select("node", "colour")
        inside = frontier
        while True:
            reached = frontier
            for _ in range(HOPS):
                reached = reached.unionByName(back.join(reached, ["node", "colour"]).select(F.col("upper").alias("node"), "colour")).distinct()
            frontier = saved(reached.join(inside, ["node", "colour"], "left_anti"))
            if not frontier.take(1):
                break
            inside = saved(inside.unionByName(frontier))
        found = inside if found is None else found.unionByName(inside)
        gone = saved(inside.select("node"))
        for side in ("upper", "lower"):
            left = left.join(gone.withColumnRenamed("node", side), side, "left_anti")
        left = saved(left.select("upper", "lower"))
    if found is None:
        return loops.select("node", F.col("node").alias("component"))
    real = found.groupBy("colour").agg(F.count("*").alias("_n"), F.min("node").alias("component"))
    named = found.join(real, "colour").join(loops.withColumn("_loop", F.lit(True)), "node", "left")
    return named.where("_n > 1 or _loop").select("node", "component")


def depths(edges: DataFrame, nodes: DataFrame, saved) -> DataFrame:
    """node, depth: the longest way down to a node along edges (upper, lower), 0 for a node without any.

    A ValueError where a cycle leaves no longest way; `peeled` and `cycles` tell which nodes those are.
    """
    layers, rest = peeled(edges, nodes, saved)
    stuck = rest.limit(3).collect()
    if stuck:
        raise ValueError(f"the edges have a cycle, at or above {sorted({r['lower'] for r in stuck})}")
    return layers


def ancestors(edges: DataFrame, start: DataFrame, saved) -> DataFrame:
    """origin, node, hops: the fewest steps up from each origin to every node above it; a node is entered once, so cycles end."""
    frontier = saved(start.select(F.col("node").alias("origin"), "node"))
    seen, hops = frontier.select("origin", "node", F.lit(0).cast("long").alias("hops")), 0
    while True:
        hops += 1
        up = frontier.join(edges, edges["lower"] == frontier["node"]).select("origin", F.col("upper").alias("node")).distinct()
        frontier = saved(up.join(seen, ["origin", "node"], "left_anti"))
        if not frontier.take(1):
            break
        seen = seen.unionAll(frontier.select("origin", "node", F.lit(hops).cast("long").alias("hops")))
    return seen.where("hops > 0")


def dependents(edges: DataFrame, nodes: DataFrame, saved, size: int = 12) -> DataFrame:
    """node, dependents, exact: how many other nodes are below each along edges (upper, lower), without listing them.

    A node's set below is a Theta sketch of up to 2^size hashes: those of its neighbours, merged with the neighbours' own
    sketches until none changes. Counts under 2^size are exact; beyond, the relative error is about 1 / sqrt(2^size). State
    is one sketch a node, and a round sends a changed sketch along each edge once; rounds follow the longest way.
    """
    edges = saved(edges.select("upper", "lower").where("upper is not null and lower is not null").distinct())
    have = saved(edges.groupBy(F.col("upper").alias("node")).agg(F.theta_sketch_agg("lower", size).alias("sketch")))
    fresh = have
    while True:
        sent = edges.join(fresh.withColumnRenamed("node", "lower"), "lower").groupBy(F.col("upper").alias("node")).agg(F.theta_union_agg("sketch", size).alias("_more"))
        new = have.join(sent, "node", "left").withColumn("_all", F.when(F.col("_more").isNotNull(), F.theta_union("sketch", "_more", size)))
        new = saved(new.select("node", F.coalesce("_all", "sketch").alias("sketch"), (F.theta_sketch_estimate("_all") != F.theta_sketch_estimate("sketch")).alias("_grown")))
        have, fresh = new.select("node", "sketch"), new.where("_grown").select("node", "sketch")
        if not fresh.take(1):
            break
    own = nodes.select("node").distinct().groupBy("node").agg(F.theta_sketch_agg("node", size).alias("_own"))
    count = F.coalesce(F.theta_sketch_estimate(F.theta_difference("sketch", "_own")), F.lit(0).cast("long"))
    rows = own.join(have, "node", "left").select("node", count.alias("dependents"))
    return rows.withColumn("exact", F.col("dependents") < (1 << size) - 1)
