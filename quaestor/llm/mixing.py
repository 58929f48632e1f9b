"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, document after document, are packed into blocks of BLOCK words. The mix is a sequence of output
shards of about SHARD slots; a source has target / BLOCK slots. Each output shard's counts by source are a multinomial
draw, given that a source's counts add up to its slots (so that targets are met to the word). The counts, added up over
the shards, are ranges of the source's slots; slot k is index k mod n of epoch k / n, and an epoch's pseudorandom
permutation (swap-or-not, ROUNDS rounds, any n) maps the index to a block. Blocks and slots are joined by (source, block).
The words left over by full blocks are the last slot of an epoch, and a source's last slot is cut to the words it needs.

Null text has no words; null source is a source of its own, the last. A row is known by doc_id, source and text; rows that
repeat all three are documents of their own. An empty table gives an empty result; other columns are not read. Targets
are the water level of weights under the caps: sources in the order of cap / weight, closed form, no loop (one row for
each source goes through one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.common import WORD, buckets_for, cut, numbered, small

BLOCK, CAP, WEIGHTS, SHARD, ROUNDS = 64, 3, (5, 2, 1), 16_384, 14
KEY = ("doc_id", "source", "t", "copy")


def targets(sizes: DataFrame, share: float = 1.0) -> DataFrame:
    """source, source_size, target, weight of the table (source, source_size): a row for each source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (n + 1).cast("int")))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(float(CAP))).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    weighted = weighted.withColumn("left_size", F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(by), F.lit(0.0)))
    weighted = weighted.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by), F.lit(0.0)))
    water = F.col("left_size") / F.col("left_weight")
    first = F.row_number().over(Window.orderBy("ratio", F.col("source").isNull(), "source"))
    weighted = weighted.withColumn("first", first).withColumn("level", F.min(F.when(F.col("ratio") >= water, F.struct("first", water.alias("at")))).over(every)["at"])
    return weighted.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap")).alias("target"), "weight")


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def laid_out(docs: DataFrame) -> DataFrame:
    """doc_id, source, t, copy, size, start (words of the source before the document): a row for each row of docs."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", "source", text_key().alias("t"), size.alias("size"))
    # Rows that repeat everything are counted and numbered.
    rows = rows.groupBy("doc_id", "source", "t").agg(F.first("size").alias("size"), F.count("*").alias("copies"))
    rows = cut(rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies"))
    return cut(numbered(rows, ["source"], [F.col("doc_id"), F.col("t"), F.col("copy")], F.col("size"), "start", buckets_for(rows.count())))


def plan(rows: DataFrame, share: float = 1.0) -> DataFrame:
    """source, source_size, target, blocks (full ones), epoch (its slots), words (to take), slots of each source."""
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share)
    goal = goal.withColumn("blocks", F.floor(F.col("source_size") / BLOCK)).withColumn("epoch", F.ceil(F.col("source_size") / BLOCK))
    goal = goal.withColumn("words", F.least(F.round("target").cast("long"), CAP * F.col("source_size")))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    slots = full * F.col("epoch") + F.ceil((F.col("words") - full * F.col("source_size")) / BLOCK)
    return cut(goal.select("source", "source_size", "target", "blocks", "epoch", "words", slots.alias("slots")))


def dealt(goal: DataFrame, seed: int) -> DataFrame:
    """goal with shard, low, count: the multinomial counts of the output shards, as ranges of each source's slots."""
    total = goal.agg(F.sum("slots")).first()[0] or 0
    shards, tasks = max(1, -(-total // SHARD)), buckets_for(total)
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / 4096)))
    parts = goal.where("slots > 0").select("source", "slots", part.alias("part")).repartition(tasks, "source", "part")
    last = F.least(F.col("slots"), (F.col("part") + 1) * 4096) - 1
    draw = F.pmod(F.xxhash64(F.lit(seed), "source", "slot"), F.lit(shards)).cast("int")
    drawn = parts.select("source", F.explode(F.sequence(F.col("part") * 4096, last)).alias("slot")).groupBy("source", draw.alias("shard")).agg(F.count("*").alias("count"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("low", F.coalesce(F.sum("count").over(before), F.lit(0)))
    return goal.withColumnRenamed("source", "_s").join(drawn, F.col("_s").eqNullSafe(F.col("source"))).drop("_s").repartition(tasks, "source", "shard")


def permuted(index: Column, n: Column, *key: Column | str) -> Column:
    """A pseudorandom permutation of 0 .. n - 1, named by key: in each round an index and its partner stay or change places."""

    def step(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit("partner"), *key, i), n) - x, n)
        swap = F.pmod(F.xxhash64(F.lit("swap"), *key, i, F.greatest(x, partner)), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, step)


def slot_table(goal: DataFrame, seed: int = 17) -> DataFrame:
    """source, shard, epoch_no, block, words: a row for each output slot; words is how many of the block it takes."""
    slots = dealt(goal, seed).withColumn("slot", F.explode(F.sequence(F.col("low"), F.col("low") + F.col("count") - 1)))
    slots = slots.withColumn("epoch_no", F.floor(F.col("slot") / F.col("epoch"))).withColumn("index", F.pmod("slot", "epoch"))
    block = F.when(F.col("index") < F.col("blocks"), permuted(F.col("index"), F.greatest(F.col("blocks"), F.lit(1)), F.lit(seed), F.col("source"), F.col("epoch_no"))).otherwise(F.col("index"))
    left = F.col("words") - F.col("epoch_no") * F.col("source_size") - F.col("index") * BLOCK
    return slots.select("source", "shard", "epoch_no", block.alias("block"), F.least(left, F.lit(BLOCK)).alias("words"))


def pieces(rows: DataFrame, goal: DataFrame, seed: int = 17) -> DataFrame:
    """KEY, from, till, takes: how many words of the part [from, till) of a document each slot takes, by shard."""
    takes = slot_table(goal, seed).groupBy("source", "block").agg(F.collect_list(F.struct("words", "shard")).alias("takes"))  # CAP + 1 at most
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    spans = rows.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    takes = takes.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "takes").hint("merge")
    joined = spans.join(takes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    at = F.col("block") * BLOCK
    low, high = F.greatest(F.col("start"), at), F.least(F.col("start") + F.col("size"), at + BLOCK)
    taken = F.transform("takes", lambda x: F.struct(F.greatest(F.least(x["words"], high - at) - (low - at), F.lit(0)).alias("n"), x["shard"].alias("shard")))
    return joined.select(*KEY, "size", (low - F.col("start")).alias("from"), (high - F.col("start")).alias("till"), F.filter(taken, lambda x: x["n"] > 0).alias("takes"))


def mixed(docs: DataFrame, share: float = 1.0, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards (output shards that take words of it): a row for each document."""
    rows = laid_out(docs)
    goal = plan(rows, share)
    n = F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    taken = pieces(rows, goal, seed).select(*KEY, F.lit(0).cast("long").alias("size"), n.alias("taken"), F.col("takes.shard").alias("shards"))
    every = rows.select(*KEY, "size", F.lit(0).cast("long").alias("taken"), F.array().cast("array<int>").alias("shards"))
    both = every.unionByName(taken).groupBy(*KEY).agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.size(F.array_distinct(F.flatten(F.collect_list("shards")))).alias("shards"))
    goal = goal.select(F.col("source").alias("_s"), "source_size", "target")
    return both.join(goal, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "size", "source_size", "target", "taken", "shards")


def materialised(docs: DataFrame, share: float = 1.0, seed: int = 17) -> DataFrame:
    """docs as the mix takes them, with all their columns; documents of which nothing is taken go.

    A text is repeated as often as it is taken whole; after it come, on lines of their own, the runs of words that are
    taken once more, with the white space inside them. n_chars, if there, is counted anew; other columns stay.
    """
    rows = laid_out(docs)
    whole = F.col("till") - F.col("from")
    some = pieces(rows, plan(rows, share), seed)
    some = some.withColumn("times", F.size(F.filter("takes", lambda x: x["n"] == whole)).cast("long"))
    some = some.withColumn("part", F.coalesce(F.array_max(F.filter(F.col("takes.n"), lambda n: n < whole)), F.lit(0).cast("long")))
    spans = some.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("from", "till", "times", "part"))).alias("spans"), F.when(F.sum(whole) == F.first("size"), F.min("times")).otherwise(0).cast("int").alias("full"))
    spans = spans.select(*[F.col(c).alias(f"{c}_") for c in KEY], "spans", "full").hint("merge")
    # The documents travel as one struct, so no helper column meets one of theirs.
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", text_key().alias("t"))
    repeated = small(rows.where("copy = 2").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("t").alias("h")))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("t") == F.col("h"))
    number = F.row_number().over(Window.partitionBy("doc_id", "source", "t").orderBy("t")).cast("long")
    keyed = keyed.join(repeated, same, "left_anti").withColumn("copy", F.lit(1).cast("long")).unionByName(keyed.join(repeated, same, "left_semi").withColumn("copy", number))
    joined = keyed.join(spans, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in KEY])
    # A generated column, so that the words are cut once and not in each expression that reads them.
    open_ = F.exists("spans", lambda x: (x["times"] > F.col("full")) | (x["part"] > 0))
    words = F.when(open_, F.regexp_extract_all(F.col("doc.text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)))
    joined = joined.select("doc", "spans", "full", F.explode(F.array(words)).alias("words"))
    run = lambda x, n: F.array_join(F.slice("words", (x["from"] + 1).cast("int"), n.cast("int")), "")
    once_more = F.transform(F.sequence(F.lit(1), F.lit(CAP)), lambda e: F.when(e > F.col("full"), F.rtrim(F.array_join(F.transform(F.filter("spans", lambda x: x["times"] >= e), lambda x: run(x, x["till"] - x["from"])), ""))).otherwise(""))
    cut_off = F.transform(F.filter("spans", lambda x: x["part"] > 0), lambda x: F.rtrim(run(x, x["part"])))
    texts = F.concat(F.array_repeat(F.col("doc.text"), F.col("full")), F.when(open_, F.concat(once_more, cut_off)).otherwise(F.array().cast("array<string>")))
    joined = joined.select("doc", F.array_join(F.filter(texts, lambda x: x != ""), "\n").alias("text"))
    kind = dict(docs.dtypes)
    fresh = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(kind["n_chars"])} if "n_chars" in kind else {})
    return joined.select(*[fresh.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
