"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents with the same shingle set are one class, so copies are never paired. Classes that share a band of their
signature are candidates, in two steps that emit no more rows than there are band keys:

1. Every class is compared with the head of each of its buckets, the class that stands in the fullest ones. Signatures are compared a batch at a time; a
   pair is dropped as soon as the posterior chance (uniform prior) of a similarity at the threshold is below MISS. What
   survives is verified on whole shingle sets, the likeliest head of a class first, the others only where they would
   join components.
2. Buckets whose other classes still lie in more than one component are open. Those classes are joined by an exact
   prefix filter: sets with 100 * intersection >= 75 * union share one of the rarest shingles of each (rarest among the
   open classes), the smaller within a seventh of its set, the larger within a quarter. Pairs of one component are
   skipped, the component that is most frequent for a shingle stands on one side only, and sizes bound the rest. A class
   whose own shingles fill its prefix meets nobody. Survivors go through the same Bayesian and exact verification.

BANDS x ROWS leave a pair at 0.75 without a shared band with chance 2e-5, and only then can it be lost.

Words are runs of anything but ASCII white space, after A-Z are lower-cased. A document with fewer than five words has
its whole sequence as its one shingle; one without words or text has an empty set, links with nothing and is kept. A
null doc_id takes no part in links. A row is known by its doc_id and text: rows that repeat both share one verdict, rows
that repeat the doc_id alone are documents of their own. Shingles stand as 64-bit hashes. An empty table gives an empty
result; other columns are not read. Texts are read whole, a piece of PIECE bytes at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quaestor.llm.common import cut, small

WIDTH, PERCENT, BANDS, ROWS, BATCH, MISS, PIECE = 5, 75, 40, 5, 20, 1e-6, 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTES = np.arange(256, dtype=np.uint64)
CODE = mixed((_BYTES + np.uint64(32) * ((_BYTES >= 65) & (_BYTES <= 90)).astype(np.uint64) + np.uint64(1)) * MIX)  # A-Z as a-z
PLACE = np.cumprod(np.full(256, MIX))
SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * MIX).astype(np.uint32) | np.uint32(1)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of texts that lie one after another in UTF-8, and where the words of each text begin."""
    at = np.flatnonzero(~SPACE[data])
    first = np.searchsorted(at, bounds)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), int)
    fresh = np.ones(len(at), bool)
    fresh[1:] = np.diff(at) > 1
    fresh[first[first < len(at)]] = True
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(at)))
    place = PLACE if sizes.max() <= len(PLACE) else np.cumprod(np.full(sizes.max(), MIX))
    value = CODE[data[at]] * place[np.arange(len(at)) - np.repeat(starts, sizes)]
    return mixed(np.add.reduceat(value, starts) + sizes.astype(np.uint64)), np.searchsorted(starts, first)


def grams(h: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a sequence of words."""
    n = min(WIDTH, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out += h[i : len(h) - n + 1 + i] * PLACE[i + 1]
    return np.unique(mixed(out))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PIECE, "right")) - 1)
        low, high = int(bounds[i]), int(bounds[j])
        if j == i + 1 and high - low > PIECE:  # one long text: pieces that end at white space
            parts = []
            while low < high:
                end = min(low + PIECE, high)
                while end < high and not SPACE[data[end]]:
                    end += 1
                parts.append(words(data[low:end], np.array([0, end - low]))[0])
                low = end
            yield grams(np.concatenate(parts))
        else:
            h, first = words(data[low:high], bounds[i : j + 1] - low)
            for a, b in zip(first[:-1], first[1:]):
                yield grams(h[a:b])
        i = j


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(len(SEEDS), np.iinfo(np.uint32).max, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(low, (x[None, at : at + 512] * SEEDS[:, None]).min(1), out=low)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    x = sig.astype(np.uint64).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        out = mixed(out * MIX + x[:, i])
    return out.view(np.int64)


def least_matches(threshold: float, total: int) -> list[tuple[int, int]]:
    """(compared, matches): with fewer matches among so many, P(similarity >= threshold) < MISS under Beta(m + 1, n - m + 1)."""
    out = []
    for n in range(BATCH, total + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n and (tail := tail + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < MISS:
            m += 1
        out.append((n, m))
    return out


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text), text: doc_id and t name a row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def features(docs: DataFrame) -> DataFrame:
    """doc_id, t, n_shingles, digest, keys, sig (the last byte of each hash); the last three are null for an empty set."""

    def rows(batches):
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                n, digest, keys, sig = [], [], [], []
                for s in shingle_sets(batch.column("text")):
                    low = signature(s)
                    n.append(len(s))
                    digest.append(_digest(s) if len(s) else None)
                    keys.append(band_keys(low) if len(s) else None)
                    sig.append(low.astype(np.uint8).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["doc_id", "t", "n_shingles", "digest", "keys", "sig"])

    return identified(docs).mapInArrow(rows, "doc_id long, t long, n_shingles long, digest binary, keys array<long>, sig binary")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, n, sig, grams of the classes wanted (id, doc_id, t, n, sig): only their texts are cut into shingles again."""

    def rows(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                s = [x.view(np.int64) for x in shingle_sets(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "n", "sig")), pa.array(s, pa.list_(pa.int64()))], names=["id", "n", "sig", "grams"])

    found = identified(docs).join(small(wanted), ["doc_id", "t"]).dropDuplicates(["id"])
    return found.select("id", "n", "sig", "text").mapInArrow(rows, "id long, n long, sig binary, grams array<long>")


def sized(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def matched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, matches: the pairs that the sequential test does not drop."""
    bounds = least_matches(PERCENT / 100, BANDS * ROWS)

    @F.pandas_udf("int")
    def matches(x: pd.Series, y: pd.Series) -> pd.Series:
        """Equal places of two signatures; -1 once the posterior is too low."""
        if not len(x):
            return pd.Series([], dtype="int32")
        a, b = (np.frombuffer(b"".join(z), np.uint8).reshape(len(x), -1) for z in (x, y))
        live, got = np.arange(len(x)), np.zeros(len(x), np.int32)
        for n, least in bounds:
            got[live] += (a[live, n - BATCH : n] == b[live, n - BATCH : n]).sum(1, dtype=np.int32)
            got[live[got[live] < least]] = -1
            live = live[got[live] >= 0]
        return pd.Series(got)

    for c in "ba":
        pairs = pairs.join(sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")), c)
    near = pairs.where(sized(F.col("n_a"), F.col("n_b"))).withColumn("matches", matches("sig_a", "sig_b"))
    return cut(near.where("matches >= 0").select("a", "b", "matches"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that whole sets confirm. The head's set is joined last, so it is not shuffled with its followers."""
    for c in "ba":
        pairs = pairs.join(sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("grams").alias(f"grams_{c}")), c)
    pairs = pairs.withColumn("both", F.size(F.array_intersect("grams_a", "grams_b")))
    return cut(pairs.where(F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * PERCENT).select("a", "b"))


def roots(parents: DataFrame) -> DataFrame:
    """id, component (the root) of a forest (b, a), where every b has one a and none leads to itself: pointers are doubled until none moves."""
    labels = cut(parents.select(F.col("b").alias("id"), F.col("a").alias("component")))
    while True:
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        moved = cut(labels.join(up, "component", "left").select("id", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("moved")))
        labels = moved.select("id", "component")
        if not moved.agg(F.max("moved")).first()[0]:
            return labels


def components(edges: DataFrame) -> DataFrame:
    """id, component (least id reachable) of every end of edges (a, b), by alternating large and small stars."""
    edges = cut(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u > v").distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(edges.select("v", "v")).distinct()
        mark = now
        edges = edges.coalesce(1 + now[0] // 100_000)  # few edges need few tasks
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = cut(large.coalesce(1 + now[0] // 100_000))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        edges = cut(stars.coalesce(1 + now[0] // 100_000))


def placed(rows: DataFrame, found: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the component of the class in column key, itself where it has no link."""
    other = found.select(F.col("id").alias(key), F.col("component").alias("_c"))
    return rows.join(other, key, "left").withColumn(name, F.coalesce("_c", key)).drop("_c")


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (id, component) with more links (a, b): only the components that these join are walked."""
    ends = placed(placed(links, found, "a", "x"), found, "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    grown = cut(components(ends))
    new = placed(found, grown, "component", "c").select("id", F.col("c").alias("component"))
    alone = grown.join(found.select("id"), "id", "left_anti")
    return cut(new.unionByName(alone))


def rare_pairs(sets: DataFrame) -> DataFrame:
    """a, b: the pairs of different components among sets (id, n, grams, c) that the prefix filter leaves."""
    each = sets.select("id", "n", "c", F.explode("grams").alias("gram"))
    known = each.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(known, "gram")
    # A set's shingles that nobody else has come first in its order; they fill places but meet nothing.
    order = Window.partitionBy("id").orderBy("df", "gram")
    ranked = shared.withColumn("r", F.row_number().over(order)).withColumn("m", F.count("*").over(Window.partitionBy("id")))
    ranked = ranked.withColumn("place", F.col("n") - F.col("m") + F.col("r")).select("gram", "id", "n", "c", "place")
    need = lambda size: F.col("n") - F.ceil((F.col("n") + size) * PERCENT / (100 + PERCENT)) + 1
    # Classes of size: a tenth wide. A smaller set stands in its own, a larger looks through those it can meet.
    level = lambda x: F.floor(F.log(x.cast("double")) / F.log(F.lit(1.1)) + 1e-9)
    least = F.ceil(F.col("n") * PERCENT / 100)
    ranked = cut(ranked.where(F.col("place") <= need(least)))
    smaller = ranked.where(F.col("place") <= need(F.col("n"))).select("gram", level(F.col("n")).alias("k"), "id", "n", "c", "place")
    larger = ranked.where(F.col("place") <= need(least)).withColumn("k", F.explode(F.sequence(level(least), level(F.col("n")))))
    floor_ = F.greatest(least, F.floor(F.pow(F.lit(1.1), F.col("k")) * (1 - 1e-9)))
    larger = larger.where(F.col("place") <= need(floor_)).select("gram", "k", "id", "n", "c", "place")
    counts = smaller.select("gram", "k", "c").unionAll(larger.select("gram", "k", "c")).groupBy("gram", "k", "c").agg(F.count("*").alias("n"))
    leads = counts.groupBy("gram", "k").agg(F.max_by("c", F.struct("n", "c")).alias("lead"), F.count("*").alias("held")).where("held > 1").drop("held")
    s, l = (x.join(leads, ["gram", "k"]).select("gram", "k", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "c", "place")], "lead") for x, side in ((smaller, "s"), (larger, "l")))
    # The first shingle that two linked sets share, in this order, leaves room in both for all that they must share.
    must = F.ceil((F.col("n_s") + F.col("n_l")) * PERCENT / (100 + PERCENT))
    room = F.least(F.col("n_s") - F.col("place_s"), F.col("n_l") - F.col("place_l")) + 1
    fits = (F.col("c_s") != F.col("c_l")) & (F.struct("n_s", "id_s") < F.struct("n_l", "id_l")) & sized(F.col("n_s"), F.col("n_l")) & (room >= must)
    one = s.where("c_s <> lead").drop("lead").join(l.drop("lead"), ["gram", "k"]).where(fits)
    other = s.where("c_s = lead").drop("lead").join(l.where("c_l <> lead").drop("lead"), ["gram", "k"]).where(fits)
    return cut(one.unionByName(other).select(F.least("id_s", "id_l").alias("a"), F.greatest("id_s", "id_l").alias("b")).distinct())


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, t, n_shingles, component_id, kept: a row for each row of docs."""
    every = cut(features(docs))
    members = every.where("digest is not null and doc_id is not null")
    one = members.groupBy("digest").agg(F.min_by(F.struct("doc_id", "t", F.col("n_shingles").alias("n"), "keys", "sig"), F.struct("doc_id", "t")).alias("x"))
    classes = cut(one.select(F.monotonically_increasing_id().alias("id"), "digest", "x.*"))
    keys = classes.select("id", F.explode("keys").alias("key"))
    held = keys.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    keys = cut(keys.join(held, "key"))  # only of buckets that are shared
    # A bucket's head is the class that stands in the fullest buckets: the one most like the others.
    weights = keys.groupBy("id").agg(F.sum("held").alias("weight"))
    heads = keys.join(weights, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", "id")).alias("head"))
    keys = cut(keys.select("key", "id").join(heads, "key"))
    crowd = classes.select("id", "doc_id", "t", "n", "sig").join(keys.select("id").distinct(), "id", "left_semi")
    sets = cut(sets_of(docs, crowd))
    near = matched(keys.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), sets)
    best = near.groupBy("b").agg(F.max_by("a", F.struct("matches", "a")).alias("a")).select("a", "b")
    found = roots(verified(best, sets))
    ends = placed(placed(near.select("a", "b"), found, "a", "x"), found, "b", "y").where("x <> y").select("a", "b")
    found = joined(found, verified(cut(ends), sets))
    # Of a bucket, only pairs without its head are untested.
    spread = placed(keys.where("id <> head").select("key", "id"), found, "id", "c")
    opened = spread.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    opened = cut(spread.join(opened, "key", "left_semi").select("id", "c").distinct())
    rest = matched(rare_pairs(sets.select("id", "n", "grams").join(opened, "id")), sets)
    found = joined(found, verified(rest.select("a", "b"), sets))
    named = placed(classes.select("id", "digest", "doc_id", "t"), found, "id", "c")
    first = named.groupBy("c").agg(F.min(F.struct("doc_id", "t")).alias("first"))
    named = named.join(first, "c").select("digest", F.col("first.doc_id").alias("_first"), F.col("first.t").alias("_t"))
    out = every.select("doc_id", "t", "n_shingles", "digest").join(named, "digest", "left")
    alone = F.col("digest").isNull() | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("_first"))
    return out.select("doc_id", "t", "n_shingles", component.alias("component_id"), (alone | (F.col("doc_id") == F.col("_first"))).alias("kept"), (alone | ((F.col("doc_id") == F.col("_first")) & (F.col("t") == F.col("_t")))).alias("stays"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each document."""
    return verdicts(docs).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component, with all columns: of rows that repeat a doc_id the one with the least text hash."""
    lost = verdicts(docs).where(~F.col("stays")).select(F.col("doc_id").alias("d"), F.col("t").alias("h")).distinct()
    # The documents travel as one struct, so no helper column meets one of theirs.
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    return keyed.join(small(lost), (F.col("doc_id") == F.col("d")) & (F.col("t") == F.col("h")), "left_anti").select("doc.*")
