"""Nearest neighbours within a group by an inverted-list index: centroids from a bounded sample, every row in a list.

`fitted` runs spherical k-means on a sample of at most about SAMPLE vectors, drawn by a hash of their ids; `listed` puts every
vector into the list of its nearest centroid. A search sends a query to the lists nearest to it, as many as `probes`
says (`probes_for` finds how many hold the wanted share of a sample's neighbours), and compares it with all vectors there.
With `exact`, the k-th best so far and the radius of each list tell which further lists could hold a better one, and a
second round reads those: the result is that of comparing all pairs.

A list of a group of any size is cut into tiles: at most about TILE rows by TILE queries meet in one task, so neither a
hot group nor a hot list fills a task, and the pairs of a tile are one matrix product whose best are all that leaves it.

vectors: id, grp, apart, e. Neighbours share `grp` and differ in `apart`; a null in any of the four takes no part, nor does a
vector with null or non-finite entries. Ties go to the smaller id. A group without others gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, LISTS, ROUNDS, TILE = 20_000, (8, 1024), 12, 4096
BEST = "q long, other long, similarity double"


def sound(vectors: DataFrame) -> DataFrame:
    """id, grp, apart, e (doubles) of the vectors that take part."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("grp").cast("string").alias("grp"), F.col("apart").cast("long").alias("apart"), F.col("e").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("grp").isNotNull() & F.col("apart").isNotNull() & finite)


def sampled(rows: DataFrame, n: int, most: int = SAMPLE) -> pd.DataFrame:
    """About `most` of n rows, by a hash of the id; the same on every run."""
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most / max(n, 1)))
    return rows.where(share).toPandas()


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fitted(sample: pd.DataFrame, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids, about the square root of n of them, by k-means on the directions of the sample."""
    if sample.empty:
        return np.zeros((0, 0))
    x = unit(np.stack(sample["e"].to_numpy()))
    lists = min(len(x), max(LISTS[0], min(LISTS[1], int(n**0.5))))
    rng = np.random.default_rng(7)
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=lists)
        bare = count == 0
        sums[bare] = x[rng.choice(len(x), int(bare.sum()))]
        centres = unit(sums)
    return centres


def probes_for(sample: pd.DataFrame, centres: np.ndarray, k: int, recall: float, asked: int = 512) -> int:
    """How many of a query's nearest lists hold `recall` of its k nearest neighbours, on the sample.

    Neighbours in the whole table are nearer than those in a sample of it, so they stand in lists that are nearer still.
    """
    if sample.empty:
        return 1
    e = np.stack(sample["e"].to_numpy())
    grp, apart = pd.factorize(sample["grp"])[0], sample["apart"].to_numpy()
    home = (unit(e) @ centres.T).argmax(axis=1)
    places = []
    for q in range(0, len(e), max(1, len(e) // asked)):
        at = np.flatnonzero((grp == grp[q]) & (apart != apart[q]))
        best = at[np.argsort(-(e[at] @ e[q]), kind="stable")[:k]]
        order = np.empty(len(centres), int)
        order[np.argsort(-(centres @ e[q]), kind="stable")] = np.arange(len(centres))
        places += order[home[best]].tolist()
    return int(np.quantile(places, recall, method="higher")) + 1 if places else 1


def listed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows with `list`, that of the nearest centroid, and `away`, the distance to it."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                e = np.stack(b["e"].to_numpy())
                near = (unit(e) @ centres.T).argmax(axis=1)
                yield b.assign(list=near.astype("int32"), away=np.linalg.norm(e - centres[near], axis=1))

    return rows.mapInPandas(assign, "id long, grp string, apart long, e array<double>, list int, away double")


def routed(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """queries with `list`: a row for each of the `probes` nearest lists."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = np.argsort(-(np.stack(b["e"].to_numpy()) @ centres.T), axis=1, kind="stable")[:, :probes]
                out = b.loc[b.index.repeat(near.shape[1])].reset_index(drop=True)
                yield out.assign(list=near.ravel().astype("int32"))

    return queries.mapInPandas(probe, "id long, grp string, apart long, e array<double>, list int")


def further(queries: DataFrame, cells: DataFrame, best: DataFrame, centres: np.ndarray, probes: int, k: int) -> DataFrame:
    """queries with `list`: the lists beyond the nearest `probes` that could hold a neighbour among the k best.

    A vector of a list is at most its radius away from the centroid c, so its product with q is at most q c + |q| radius.
    """
    worst = best.groupBy("q").agg(F.count("*").alias("_n"), F.min("similarity").alias("_w"))
    floor = worst.select(F.col("q").alias("id"), F.when(F.col("_n") >= k, F.col("_w")).alias("worst"))
    radii = cells.groupBy("grp").agg(F.collect_list(F.struct("list", "radius")).alias("radii"))  # at most one entry a list
    rows = queries.join(floor, "id", "left").join(radii, "grp")

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            e = np.stack(b["e"].to_numpy())
            near = e @ centres.T
            bound, length = np.full(near.shape, -np.inf), np.linalg.norm(e, axis=1)
            for row, radii in enumerate(b["radii"]):
                for r in radii:
                    bound[row, r["list"]] = near[row, r["list"]] + length[row] * r["radius"] + 2e-6  # similarities are rounded
            np.put_along_axis(bound, np.argsort(-near, axis=1, kind="stable")[:, :probes], -np.inf, axis=1)  # read before
            row, list_ = np.nonzero((bound >= b["worst"].fillna(-np.inf).to_numpy(float)[:, None]) & (bound > -np.inf))
            yield b.iloc[row][["id", "grp", "apart", "e"]].reset_index(drop=True).assign(list=list_.astype("int32"))

    return rows.mapInPandas(reach, "id long, grp string, apart long, e array<double>, list int")


def compared(index: DataFrame, asked: DataFrame, k: int, tile: int = TILE) -> DataFrame:
    """BEST of each query and tile of its lists: the k greatest products, rounded to 6 digits, ties to the smaller id."""
    keys = ["grp", "list"]
    have = index.groupBy(*keys).agg(F.count("*").alias("_rows")).join(asked.groupBy(*keys).agg(F.count("*").alias("_asked")), keys)
    tiles = have.select(*keys, F.ceil(F.col("_rows") / tile).cast("int").alias("_down"), F.ceil(F.col("_asked") / tile).cast("int").alias("_across"))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(tiles, keys).select(*keys, deal("_down").alias("down"), every("_across").alias("across"), "id", "apart", "e")
    right = asked.join(tiles, keys).select(*keys, every("_down").alias("down"), deal("_across").alias("across"), "id", "apart", "e")

    def meet(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"q": [], "other": [], "similarity": []})
        rows = rows.sort_values("id", ignore_index=True)
        x, ids, apart, out = np.stack(rows["e"].to_numpy()), rows["id"].to_numpy(), rows["apart"].to_numpy(), []
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            scores = np.round(np.stack(part["e"].to_numpy()) @ x.T, 6)
            scores[part["apart"].to_numpy()[:, None] == apart[None, :]] = -np.inf
            order = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # stable, and rows by id: ties to the smaller
            best = np.take_along_axis(scores, order, axis=1)
            out.append(pd.DataFrame({"q": np.repeat(part["id"].to_numpy(), order.shape[1]), "other": ids[order].ravel(), "similarity": best.ravel()}))
        found = pd.concat(out)
        return found[found["similarity"] > -np.inf]

    tile_keys = [*keys, "down", "across"]
    return left.groupBy(*tile_keys).cogroup(right.groupBy(*tile_keys)).applyInPandas(meet, BEST)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """q, place, other, similarity of the k best of each query; a window per query over k rows a tile, pruned in each task."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "other")).cast("long")
    return found.withColumn("place", place).where(F.col("place") <= k).select("q", "place", "other", "similarity")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, saved, recall: float = 0.95, exact: bool = False, tile: int = TILE) -> DataFrame:
    """q, place, other, similarity: the k vectors with the greatest products with each query, of its group and another `apart`.

    Without `exact`, of the lists that hold `recall` of the neighbours on the sample. saved(df) must cut the lineage of df
    where lost executors cannot take it along.
    """
    rows = sound(vectors)
    n = rows.count()
    sample = sampled(rows, n)
    centres = fitted(sample, n)
    if not len(centres):
        return rows.sparkSession.createDataFrame([], "q long, place long, other long, similarity double")
    probes = probes_for(sample, centres, k, recall)
    index, asked = saved(listed(rows, centres)), sound(queries)
    found = compared(index, routed(asked, centres, probes), k, tile)
    if exact:
        found = saved(found)
        cells = index.groupBy("grp", "list").agg(F.max("away").alias("radius"))
        found = found.unionByName(compared(index, further(asked, cells, ranked(found, k), centres, probes, k), k, tile))
    return ranked(found, k)
