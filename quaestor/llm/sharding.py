"""Sharding with a k-d tree.

Cells are split at distributed weighted medians along their widest metadata dimension until there is a leaf for each
shard: the logarithm of the length, and the places of language and source on a line (by checksum). Equal texts take the
metadata of the one with the least doc_id among them, so they fall into one leaf, and the tree is applied as one
expression. Ties in a dimension are ordered by a hash of the text, so medians can cut anywhere between two texts. A text
whose copies together outweigh a shard gets a shard of its own. Only histograms reach the driver: at most cells x 4096
rows, whatever the input.

A null text weighs 8 bytes and goes with the empty one; null language or source is a place of its own. Repeated rows each
get a slot. An empty table gives an empty result. Language and source may be missing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import buckets_for, cut, numbered

BITS, ROUND = 48, 12  # a composite key: 20 bits of the dimension, 28 of the hash; refined 12 bits a round
DIMS = ("length", "lang", "source")


def _key(dim: str, low: float, high: float) -> Column:
    scale = (2**20 - 1) / (high - low) if high > low else 0.0
    place = F.floor((F.col(dim) - F.lit(low)) * F.lit(scale)).cast("long")
    return F.shiftleft(F.greatest(F.lit(0), F.least(F.lit(2**20 - 1), place)).cast("long"), 28) + F.pmod(F.col("h"), F.lit(2**28))


def kd_shards(points: DataFrame, shards: int) -> tuple[DataFrame, list[int], int]:
    """(points with leaf, texts with shards of their own, number of leaves) of points (DIMS, h, size)."""
    total = points.agg(F.sum("size").alias("s")).first()["s"] or 0
    giants = [r["h"] for r in points.groupBy("h").agg(F.sum("size").alias("s")).where(F.col("s") * shards > total).orderBy(F.desc("s"), "h").limit(shards - 1).collect()]
    light = points.where(~F.col("h").isin(giants)) if giants else points
    leaves = shards - len(giants)
    cells: list[tuple[int, int]] = [(0, leaves)]  # first shard, number of shards
    shard = F.lit(0)
    while any(n > 1 for _, n in cells):
        at = light.withColumn("cell", shard)
        spans = {r["cell"]: r for r in at.groupBy("cell").agg(F.sum("size").alias("w"), *[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        keys, wanted, floor, done = {}, {}, {}, {}
        base = {d: max((r[f"hi_{d}"] - r[f"lo_{d}"] for r in spans.values()), default=1) or 1 for d in DIMS}
        for first, n in cells:
            if n > 1 and first in spans:
                r = spans[first]
                dim = max(DIMS, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / base[d])
                keys[first] = _key(dim, float(r[f"lo_{dim}"]), float(r[f"hi_{dim}"]))
                wanted[first], floor[first], done[first] = r["w"] * (n // 2) / n, 0, 0
        if keys:
            key = F.lit(None).cast("long")
            for c, k in keys.items():
                key = F.when(F.col("cell") == c, k).otherwise(key)
            keyed = at.withColumn("key", key).where(F.col("key").isNotNull())
            for shift in range(BITS - ROUND, -1, -ROUND):
                inside = F.lit(False)
                for c in keys:
                    inside = inside | ((F.col("cell") == c) & (F.shiftright("key", shift + ROUND) == (floor[c] >> (shift + ROUND))))
                bins: dict[int, dict[int, int]] = {}
                for r in keyed.where(inside).groupBy("cell", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("w")).collect():
                    bins.setdefault(r["cell"], {})[r["bin"]] = r["w"]
                for c in keys:
                    for b in sorted(bins.get(c, {})):
                        if shift == 0 and done[c] + bins[c][b] / 2 > wanted[c]:
                            floor[c] = b
                            break
                        if shift and done[c] + bins[c][b] > wanted[c]:
                            floor[c] = b << shift
                            break
                        done[c] += bins[c][b]
                        floor[c] = (b + 1) << shift
        split, grown = [], shard
        for first, n in cells:
            if n == 1:
                split.append((first, n))
                continue
            split += [(first, n // 2), (first + n // 2, n - n // 2)]
            if first in keys:
                grown = F.when((shard == first) & (keys[first] >= floor[first]), first + n // 2).otherwise(grown)
        cells, shard = split, grown
        light = cut(light.withColumn("leaf", shard))
        shard = F.col("leaf")
    return light.withColumn("leaf", shard), giants, leaves


def sharded(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    place = lambda c: (F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) / 2.0**32 if c in docs.columns else F.lit(0.0)).alias(c)
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.lit(7)).alias("h"), place("lang"), place("source"))
    rows = cut(rows)
    first = rows.groupBy("h").agg(F.min_by(F.struct("lang", "source"), F.struct("doc_id", "lang", "source")).alias("of"))
    points = cut(rows.drop("lang", "source").join(first, "h").select("doc_id", "size", "text_crc32", "h", F.log2(F.col("size").cast("double")).alias("length"), "of.lang", "of.source"))
    light, giants, leaves = kd_shards(points, shards)
    placed = light.select("doc_id", "size", "text_crc32", F.col("leaf").cast("int").alias("shard"))
    if giants:
        own = F.coalesce(*[F.when(F.col("h") == h, leaves + i) for i, h in enumerate(giants)])
        placed = placed.unionByName(points.where(F.col("h").isin(giants)).select("doc_id", "size", "text_crc32", own.cast("int").alias("shard")))
    out = numbered(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32")], F.lit(1), "slot", buckets_for(points.count()))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
