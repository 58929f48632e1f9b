"""Cluster merges by falling confidence under the OR rule, as a distributed spanning forest with pairs that must stay apart.

The result is that of taking the pairs one by one, the most confident first, and refusing each that would bring two
alternatives of one question into a cluster: the pair refused is the weakest on the path that would have joined them.
Here all clusters move at once. In a round each takes its best pair left (an aggregate). A pair that both sides take is
one that the sequence would reach before any other of the two, so it is made; a cluster that is to stay apart from none
of its component joins along its best pair at once, whatever the other side takes. Pairs between clusters to stay apart
are dropped as soon as they are. Pairs of equal confidence go by a digest of their ids, so that ties make no long chains
of clusters that wait for one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.operators import graph, reads

MERGED, REFUSED, STALE, GONE, SELF = "merged", "refused", "stale", "gone", "self"


def tie(a: Column, b: Column) -> Column:
    """The digest by which pairs of equal confidence go, the greatest first."""
    return F.md5(F.concat_ws(",", a.cast("string"), b.cast("string")).cast("binary"))


def _renamed(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """rows with x and y replaced by where moves (id, component) take them; x < y, and pairs within one are gone."""
    for side in ("x", "y"):
        to = moves.select(F.col("id").alias(side), F.col("component").alias("_to"))
        rows = rows.join(to, side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
    low, high = F.least("x", "y"), F.greatest("x", "y")
    return rows.withColumns({"x": low, "y": high}).where("x <> y")


def forest(pairs: DataFrame, apart: DataFrame, saved) -> tuple[DataFrame, DataFrame]:
    """(labels, made): cluster and component (its least cluster) for all ends of pairs, and the pairs that were made.

    pairs: a, b, confidence; apart: a, b that must not meet. Either may name a pair in both orders or more than once.
    """
    ordered = lambda df: df.where("a <> b").withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    best = ordered(pairs.select("a", "b", "confidence").where("confidence is not null")).groupBy("a", "b").agg(F.max("confidence").alias("confidence"))
    edges = saved(best.withColumn("tie", tie(F.col("a"), F.col("b"))))
    whole = graph.components(edges, saved)
    labels = whole.select(F.col("id").alias("cluster"), F.col("id").alias("component"))
    home = lambda side: whole.select(F.col("id").alias(side), F.col("component").alias(f"_{side}"))
    wall = ordered(apart.select("a", "b")).distinct().join(home("a"), "a").join(home("b"), "b").where("_a = _b").select(F.col("a").alias("x"), F.col("b").alias("y"))
    edges, wall, made = edges.withColumns({"x": F.col("a"), "y": F.col("b")}), saved(wall), None
    edges = saved(edges.join(wall, ["x", "y"], "left_anti"))
    while edges.take(1):
        sides = edges.withColumn("c", F.explode(F.array("x", "y")))
        picks = sides.groupBy("c").agg(F.max(F.struct("confidence", "tie", "a", "b", "x", "y")).alias("p"))
        bound = wall.select(F.explode(F.array("x", "y")).alias("c")).distinct().withColumn("_bound", F.lit(1))
        picks = picks.join(bound, "c", "left").select("p.*", F.col("_bound").isNull().alias("free"))
        taken = picks.groupBy("a", "b", "x", "y", "confidence").agg(F.count("*").alias("n"), F.max("free").alias("free")).where("n = 2 or free")
        taken = saved(taken.select("a", "b", "x", "y", "confidence"))
        moves = graph.components(taken.select(F.col("x").alias("a"), F.col("y").alias("b")), saved)
        made = taken if made is None else made.unionByName(taken)
        to = moves.select(F.col("id").alias("component"), F.col("component").alias("_to"))
        labels = saved(labels.join(to, "component", "left").select("cluster", F.coalesce("_to", "component").alias("component")))
        wall = saved(_renamed(wall, moves).distinct())
        edges = saved(_renamed(edges, moves).join(wall, ["x", "y"], "left_anti"))
    made = edges.select("a", "b", "confidence") if made is None else made.select("a", "b", "confidence")
    return labels, made


def merges(pairs: DataFrame, clusters: DataFrame, members: DataFrame, saved) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, clusters, members) after all proposals, as one flow.

    pairs: a, b, confidence, version_a, version_b (as read; null: no check). clusters: cluster_id, version, ... members:
    question_id, cluster_id, paper_id, or_group, decided_by, confidence. Verdicts of pairs: `self`, `gone` (a cluster is not there),
    `stale` (a version is another by now), `review` and `reject` by the gate, and of the rest `merged` or `refused` by the OR
    rule. The least cluster of a group survives with its next version; questions that move are decided by the agent, with
    the confidence of the weakest merge of their group.
    """
    now = lambda side: clusters.select(F.col("cluster_id").alias(side), F.col("version").alias(f"_{side}"))
    rows = pairs.join(now("a"), "a", "left").join(now("b"), "b", "left")
    stale = ~(F.coalesce(F.col("version_a") == F.col("_a"), F.lit(True)) & F.coalesce(F.col("version_b") == F.col("_b"), F.lit(True)))
    gone = F.col("_a").isNull() | F.col("_b").isNull()
    first = F.when(F.col("a") == F.col("b"), SELF).when(gone, GONE).when(stale, STALE).otherwise(F.coalesce(reads.gate(F.col("confidence")), F.lit("reject")))
    rows = saved(rows.withColumn("verdict", first).drop("_a", "_b"))
    apart = graph.blocking_pairs(members.select(F.col("cluster_id").alias("cluster"), "paper_id", "or_group"))
    labels, made = forest(rows.where("verdict = 'auto'"), apart, saved)
    home = lambda side: labels.select(F.col("cluster").alias(side), F.col("component").alias(f"_{side}"))
    rows = rows.join(home("a"), "a", "left").join(home("b"), "b", "left")
    verdict = F.when(F.col("verdict") != "auto", F.col("verdict")).when(F.col("_a") == F.col("_b"), MERGED).otherwise(REFUSED)
    groups = made.join(labels.select(F.col("cluster").alias("a"), "component"), "a").groupBy("component").agg(F.min("confidence").alias("_weakest"))
    survivors = labels.select("cluster", F.col("component").alias("survivor"))
    moved = reads.moved(members, survivors, "agent", 0.0).join(groups.withColumnRenamed("component", "cluster_id"), "cluster_id", "left")
    own = members.select("question_id", F.col("cluster_id").alias("_was"), F.col("paper_id"), F.col("or_group"))
    moved = moved.join(own, "question_id").withColumn("confidence", F.when(F.col("_was") == F.col("cluster_id"), F.col("confidence")).otherwise(F.col("_weakest"))).drop("_was", "_weakest")
    return rows.withColumn("verdict", verdict).drop("_a", "_b"), reads.after_merges(clusters, survivors), moved
