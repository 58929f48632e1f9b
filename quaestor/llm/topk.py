"""Exact top-k search with two cover trees.

Rows are dealt into chunks of CHUNK to MOST rows; a chunk is indexed in cover trees of TREE rows, and so is each block of
at most BLOCK queries that meets it. In a cover tree every node is a vector; at each scale, BASE times finer than the one above, its
children lie farther apart than the scale and cover all vectors below them within it. A node keeps its covering radius,
so no product between two nodes' vectors exceeds c1.c2 + |c1| r2 + |c2| r1 + r1 r2, and a pair of nodes is dropped when
that is below the worst k-th score of its queries. A first pass over a bounded sample (SAMPLE vectors by hash order) gives
each query a true lower bound of its k-th score, from which pruning starts. Queries are copied to every chunk and
streamed through its task block after block; a task holds one chunk and one block, the driver the sample alone. What the
chunks return, k for each query at most, is merged by query.

Products are of whole numbers and exact in float64; vectors with whose length and components they might not be (beyond
2**53 in all) are refused with an error. Ties go to the smaller vec_id. Vectors null, or with null or non-finite
components, take no part; so do empty ones, and rows with null vec_id. A row never answers a query of its own vec_id;
rows that repeat a vec_id answer each, and as queries count once (the first in the order of their vectors). Vectors of
another length than the query's take no part in its answer. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK, MOST, TREE, BLOCK, SAMPLE, LEAF, BASE, EXACT = 8192, 131_072, 1024, 2048, 2048, 64, 1.4, 2.0**53


class Node:
    """A vector (by row) with its covering radius, the rows it covers and its children, None for a leaf."""

    __slots__ = ("centre", "radius", "rows", "children")

    def __init__(self, centre: int, radius: float, rows: np.ndarray, children: list | None):
        self.centre, self.radius, self.rows, self.children = centre, radius, rows, children


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, centre: int | None = None) -> Node:
    rows = np.arange(len(x)) if rows is None else rows
    centre = int(rows[0]) if centre is None else centre
    away = np.sqrt(((x[rows] - x[centre]) ** 2).sum(1))
    radius = float(away.max())
    if len(rows) <= LEAF or radius == 0:
        return Node(centre, radius, rows, None)
    scale, centres, owner = radius / BASE, [centre], np.zeros(len(rows), int)
    while away.max() > scale:  # the next child is the vector that no child covers yet, the farthest first
        centres.append(int(rows[away.argmax()]))
        d = np.sqrt(((x[rows] - x[centres[-1]]) ** 2).sum(1))
        owner[d < away] = len(centres) - 1
        away = np.minimum(away, d)
    return Node(centre, radius, rows, [cover_tree(x, rows[owner == i], c) for i, c in enumerate(centres)])


def leaves(node: Node) -> Iterator[Node]:
    if node.children is None:
        yield node
    for child in node.children or ():
        yield from leaves(child)


class Search:
    """One block of queries against trees: groups of queries (the leaves of their own tree) go down a tree together."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, k: int, worst: np.ndarray):
        self.q, self.ids, self.k, self.worst = q, q_ids, k, worst
        self.groups = list(leaves(cover_tree(q)))
        centres = [g.centre for g in self.groups]
        self.centres, self.radii = q[centres], np.array([g.radius for g in self.groups])
        self.sizes = np.sqrt((self.centres**2).sum(1))
        self.found = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))  # query, row's id, score

    def bounds(self, groups: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Whether a pair of a group and a node (centre, radius) may hold a product as good as a k-th score of the group."""
        least = np.array([self.worst[self.groups[g].rows].min() for g in groups])
        most = self.centres[groups] @ c.T + self.sizes[groups][:, None] * r + np.sqrt((c**2).sum(1)) * self.radii[groups][:, None] + self.radii[groups][:, None] * r
        return most >= least[:, None] - 1e-6

    def score(self, groups: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.groups[g].rows for g in groups])
        s = self.q[rows] @ x.T
        s[self.ids[rows][:, None] == ids[None, :]] = -np.inf
        i, j = np.nonzero((s >= self.worst[rows][:, None]) & (s > -np.inf))
        query, of, score = (np.concatenate(z) for z in zip(self.found, (rows[i], ids[j], s[i, j])))
        order = np.lexsort((of, -score, query))
        query, of, score = query[order], of[order], score[order]
        first = np.searchsorted(query, query)  # where each query's run begins
        place = np.arange(len(query)) - first
        last = place == self.k - 1
        self.worst[query[last]] = np.maximum(self.worst[query[last]], score[last])
        self.found = tuple(z[place < self.k] for z in (query, of, score))

    def visit(self, x: np.ndarray, ids: np.ndarray, node: Node, groups: np.ndarray | None = None) -> None:
        groups = np.arange(len(self.groups)) if groups is None else groups
        kids = node.children or [node]
        may = self.bounds(groups, x[[c.centre for c in kids]], np.array([c.radius for c in kids]))
        ends = np.array([c.children is None for c in kids])
        if (may & ends).any():
            rows = np.concatenate([kids[i].rows for i in np.flatnonzero(ends & may.any(0))])
            self.score(groups[(may & ends).any(1)], x[rows], ids[rows])
        for i in np.flatnonzero(~ends & may.any(0)):
            self.visit(x, ids, kids[i], groups[may[:, i]])

    def best(self) -> list[tuple[int, int, int]]:
        """(query, row, score) of every product that may be among a query's k best."""
        return [(int(self.ids[q]), int(i), int(s)) for q, i, s in zip(*self.found)]


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    # A product is at most the length times the square of the largest component.
    large = F.array_max(F.transform("v", lambda c: F.abs(c)))
    return rows.withColumn("v", F.when(F.size("v") * large * large >= EXACT, F.raise_error(F.lit("products of these vectors are not exact")).cast("array<double>")).otherwise(F.col("v")))


def matrix(part: pd.DataFrame) -> np.ndarray:
    return np.stack(part["v"].to_numpy()).astype(float)


def bounded(asked: DataFrame, sample: list, k: int) -> DataFrame:
    """asked with worst: the k-th best score that the sample's rows alone give."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            worst = np.full(len(batch), -np.inf)
            width = batch["v"].map(len).to_numpy()
            for w in np.unique(width):
                near = [s for s in sample if len(s[1]) == w]
                if near:
                    at = np.flatnonzero(width == w)
                    s = matrix(batch.iloc[at]) @ np.array([v for _, v in near]).T
                    s[batch["vec_id"].to_numpy()[at][:, None] == np.array([i for i, _ in near])[None, :]] = -np.inf
                    worst[at] = -np.partition(-s, k - 1, 1)[:, k - 1] if len(near) >= k else -np.inf
            yield batch.assign(worst=worst)

    return asked.mapInPandas(add, "vec_id long, v array<double>, worst double")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score."""
    rows = quantised(vectors)
    n = rows.count()
    chunks = max(1, -(-n // min(MOST, max(CHUNK, n // 4096))))
    sample = [(r["vec_id"], r["v"]) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = bounded(asked, sample, k).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    dealt = rows.select("vec_id", "v", F.lit(None).cast("double").alias("worst"), F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(chunks)).cast("int").alias("chunk"))
    both = dealt.withColumn("asks", F.lit(0)).unionByName(asked.withColumn("asks", F.lit(1)))
    both = both.repartition(chunks, "chunk").sortWithinPartitions("chunk", "asks", F.size("v"), F.xxhash64("vec_id"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, trees, waiting = None, [], {}, []

        def answers() -> pd.DataFrame:
            out = []
            asked_ = pd.concat(waiting)
            for w, group in asked_.groupby(asked_["v"].map(len)):
                if w in trees:
                    run = Search(matrix(group), group["vec_id"].to_numpy(), k, group["worst"].to_numpy().copy())
                    for x, ids, tree in trees[w]:
                        run.visit(x, ids, tree)
                    out += run.best()
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

        for batch in batches:
            for (chunk, asks), part in batch.groupby(["chunk", "asks"], sort=True):
                if chunk != at:
                    if waiting:
                        yield answers()
                    at, parts, trees, waiting = chunk, [], {}, []
                if not asks:
                    parts.append(part)
                    continue
                if parts:  # the chunk's rows are all there
                    held = pd.concat(parts)
                    for w, group in held.groupby(held["v"].map(len)):
                        x, ids = matrix(group), group["vec_id"].to_numpy()
                        trees[w] = [(x[i : i + TREE], ids[i : i + TREE], cover_tree(x[i : i + TREE])) for i in range(0, len(x), TREE)]
                    parts = []
                for low in range(0, len(part), BLOCK):
                    waiting.append(part.iloc[low : low + BLOCK])
                    if sum(map(len, waiting)) >= BLOCK:
                        yield answers()
                        waiting = []
        if waiting:
            yield answers()

    found = both.mapInPandas(find, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score
      FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""
