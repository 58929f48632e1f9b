"""Exact deduplication by a heavy-hitter split.

Spark's `approx_top_k` keeps a frequent-items sketch, a Misra-Gries summary with purges: every digest above n / tracked
rows is in it. Its winners are counted exactly and broadcast (at most HEAVY rows), so their copies are settled on the
map side; all other digests, whose groups are small, are shuffled.

Null text counts as empty. doc_id is the identity of a row: rows that repeat both id and text share one verdict. A null
doc_id sorts below every other. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.common import cut, small

HEAVY, TRACKED = 1000, 20_000


def verdicts(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs."""
    rows = cut(docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest")).withColumn("h", F.xxhash64("digest")))
    top = rows.agg(F.expr(f"approx_top_k(h, {heavy}, {tracked})").alias("top")).select(F.explode("top").alias("x"))
    frequent = top.where(F.col("x.count") > 1).select(F.col("x.item").alias("h"))  # at most `heavy` rows
    winners = rows.join(F.broadcast(frequent), "h", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = cut(winners.orderBy(F.desc("group_size")).limit(heavy))
    hot = rows.join(F.broadcast(winners), "digest").select("doc_id", "keep_id", "group_size", "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    cold = rest.select("doc_id", F.max("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"), "digest")
    return hot.unionByName(cold).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each text, also where ids are null or repeat."""
    seen = verdicts(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    seen = cut(seen.where(~F.col("kept") | (F.col("n") > 1)).select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("h"), "kept"))
    # The documents travel as one struct, so no helper column meets one of theirs.
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sha") == F.col("h"))
    once = keyed.join(small(seen), same, "left_anti").select("doc.*")
    repeated = seen.where("kept")
    if repeated.isEmpty():
        return once
    return once.unionByName(keyed.join(small(repeated), same).groupBy("sha").agg(F.first("doc").alias("doc")).select("doc.*"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
