"""Queries through the data sources: blobs written once and read back, page words written as files and read in ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quaestor.plans.binding import table
from quaestor.plans.registry import query
from quaestor.plans.saving import shared_dir
from quaestor.sources import formats


@query("""SELECT o_orderpriority AS subject, md5(CAST(o_orderkey AS VARCHAR)) AS hash, (CASE WHEN o_orderkey % 5 = 0 THEN 'first ' ELSE 'second ' END) || o_orderkey AS content FROM orders""", bound=False)
def stored_papers(spark, sf_dir):
    """What a sink holds after a first writer brought every fifth blob, a second one all, and a third one all again."""
    folder = f"{shared_dir(spark)}/papers-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders")
    blobs = lambda who: orders.select(F.col("o_orderpriority").alias("subject"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("hash"), F.concat(F.lit(who + " "), "o_orderkey").cast("binary").alias("content"))
    formats.write_absent(blobs("first").where(orders["o_orderkey"] % 5 == 0), folder)
    formats.write_absent(blobs("second"), folder)
    formats.write_absent(blobs("third"), folder)
    return spark.read.format("papers").load(folder).withColumn("content", F.col("content").cast("string"))


@query("""SELECT CAST(l_orderkey AS INT) AS page_no, 600.0 + l_orderkey % 7 AS page_width, count(*) * 4 AS words, string_agg('Explain item ' || l_partkey || ' twice', ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS text,
round(sum(50 + 86.8 + 109.8 + 109.8 + 4.6 * (length(CAST(l_partkey AS VARCHAR)) + 1)), 1) AS places, CAST(max(8 + l_linenumber) AS DOUBLE) AS tallest FROM lineitem GROUP BY l_orderkey""", bound=False)
def page_items(spark, sf_dir):
    """Orders set as pages of fixture files, whose words are read back in ranges of 16 KB."""
    folder = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    line = F.format_string("50 | %d | Explain item %d twice |h=%d", 700 - F.col("l_linenumber") * 15, F.col("l_partkey"), 8 + F.col("l_linenumber"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line")))), lambda x: x["line"])
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(lines, "\n").alias("body"))
    head = F.format_string("# a page\n@page %d width=%d height=800\n", F.col("l_orderkey"), 600 + F.col("l_orderkey") % 7)
    pages.select(F.concat(head, "body").alias("value")).write.text(folder)
    items = formats.registered(spark).read.format("paper_items").option("bytes", 16 << 10).load(folder)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "str"))), lambda x: x["str"]), " ")
    return items.groupBy("page_no", "page_width").agg(F.count("*").alias("words"), ordered.alias("text"), F.round(F.sum("x"), 1).alias("places"), F.max("height").alias("tallest"))
