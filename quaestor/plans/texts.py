"""Queries over texts: hashes, the quality gate, routing, first arrivals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestor.functions import text
from quaestor.operators import tables
from quaestor.plans.binding import table
from quaestor.plans.registry import query

_NORMAL = "lower(text)"
for _p in text.FURNITURE:
    _NORMAL = f"regexp_replace({_NORMAL}, '{_p.replace('{s}', '[\\s\\x0B]')}', ' ', 'g')"
_NORMAL = f"trim(regexp_replace(translate({_NORMAL}, '‘’“”', '''''\"\"'), '[\\s\\x0B]+', ' ', 'g'))"

_HASHED = f"WITH hashed AS (SELECT doc_id, source, sha256({_NORMAL}) AS hash FROM documents) "


def uploads(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("upload_id"), F.col("source").alias("subject"), (F.col("doc_id") % 20).alias("user"), text.content_hash(F.col("text")).alias("hash"))


@query(_HASHED + "SELECT doc_id AS upload_id, hash, min(doc_id) OVER w AS paper_id, doc_id = min(doc_id) OVER w AS created FROM hashed WINDOW w AS (PARTITION BY source, hash)", bound=False)
def content_hash_dedup(spark, sf_dir):
    return tables.arrivals(uploads(spark, sf_dir), "upload_id").select("upload_id", "hash", "paper_id", "created")


@query(_HASHED + 'SELECT DISTINCT paper_id, doc_id % 20 AS "user" FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY source, hash) AS paper_id FROM hashed) WHERE doc_id <> paper_id', bound=False)
def contribution_credits(spark, sf_dir):
    return tables.credits(tables.arrivals(uploads(spark, sf_dir), "upload_id"))


_GATE = f"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS t FROM documents),
w AS (SELECT doc_id, t, string_split_regex(t, '[\\s\\x0B]+') AS words FROM t),
m AS (SELECT doc_id, length(t) AS size, len(words) AS n,
  coalesce(CAST(length(regexp_replace(t, '[^a-zA-Z]', '', 'g')) AS DOUBLE) / nullif(length(regexp_replace(t, '[\\s\\x0B]', '', 'g')), 0), 0) AS alpha,
  CAST(len(regexp_extract_all(t, '[^\\w\\s]{{4,}}')) AS DOUBLE) / len(words) AS punct,
  CAST(len(list_filter(words, lambda x: regexp_matches(x, '[a-zA-Z]') AND regexp_matches(x, '[0-9~^|]'))) AS DOUBLE) / len(words) AS garbled,
  len(list_intersect(string_split_regex(regexp_replace(lower(t), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), {list(text.COMMON)})) / 20.0 AS common FROM w),
gate AS (SELECT doc_id, size, CASE WHEN size < 200 THEN 'short' WHEN n < 50 THEN 'few words' WHEN alpha < 0.7 THEN 'letters' WHEN punct > 0.008 THEN 'punctuation' WHEN common < 0.45 THEN 'stop words' WHEN garbled > 0.15 THEN 'garbled' END AS reason,
  CASE WHEN size < 200 OR n < 50 THEN 0.0 ELSE 0.30 * least(alpha / 0.9, 1.0) + 0.35 * (1 - least(punct / 0.013, 1.0)) + 0.10 * (1 - least(garbled / 0.2, 1.0)) + 0.25 * common END AS score FROM m)
"""


@query(_GATE + "SELECT doc_id, reason IS NULL AS usable, reason, round(CAST(score AS DOUBLE), 6) AS score FROM gate", bound=False)
def text_quality_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(text.quality(F.col("text")))))  # one row, worked out once for its three columns
    return rows.select("doc_id", "usable", "reason", F.round("score", 6).alias("score"))


@query(_GATE + ", r AS (SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) < 40 THEN 'vision' END AS bare FROM documents) SELECT doc_id, coalesce(bare, CASE WHEN reason IS NULL THEN 'digital' ELSE 'dirty_ocr_recovered' END) AS text_source FROM gate JOIN r USING (doc_id)", bound=False)
def s1_routing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.route(F.col("text")).alias("text_source"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 = 2 THEN p_name || ' (0)' WHEN l_linenumber % 4 = 3 THEN '(5) ' || p_name ELSE p_name END AS clean,
CASE WHEN l_linenumber % 4 < 2 AND l_quantity > 0 THEN CAST(l_quantity AS INT) END AS marks FROM lineitem JOIN part ON l_partkey = p_partkey""", bound=False)
def strip_trailing_marks(spark, sf_dir):
    """Question texts that end in (n) or [n marks], in (0), or begin with (5)."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").join(part, "l_partkey")
    n, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 4
    printed = F.when(k == 0, F.concat("p_name", F.lit(" ("), n, F.lit(")"))).when(k == 1, F.concat("p_name", F.lit(" ["), n, F.lit(" Marks] "))).when(k == 2, F.concat("p_name", F.lit(" (0)"))).otherwise(F.concat(F.lit("(5) "), "p_name"))
    got = rows.select("l_orderkey", "l_linenumber", "l_partkey", text.trailing_marks(printed).alias("x"))
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "x.clean", "x.marks")


@query(_GATE + f""", n AS (SELECT doc_id, sha256({_NORMAL}) AS by_text, sha256('provisional:' || 'bytes ' || CAST(doc_id AS VARCHAR)) AS by_bytes FROM documents)
SELECT doc_id, CASE WHEN reason IS NULL THEN by_text ELSE by_bytes END AS hash, reason IS NOT NULL AS provisional FROM gate JOIN n USING (doc_id)""", bound=False)
def paper_hashes(spark, sf_dir):
    """Papers by their text where it is readable, else by their bytes, in hash families of their own."""
    content = F.concat(F.lit("bytes "), F.col("doc_id").cast("string")).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", text.paper_hash(F.col("text"), content).alias("h")).select("doc_id", "h.hash", "h.provisional")


@query("""SELECT o_orderkey AS paper_id, CASE WHEN o_totalprice > 1000 OR o_totalprice < 0 THEN 'total' ELSE '' END AS violations FROM orders""", bound=False)
def row_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("exam_year"), F.col("o_totalprice").alias("total"))
    return rows.select("paper_id", F.array_join(text.violations(rows.columns), ",").alias("violations"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, [2, 5, 8, 13, 15][1 + (l_quantity > 3)::INT + (l_quantity > 6)::INT + (l_quantity > 10)::INT + (l_quantity > 14)::INT] AS band FROM lineitem", bound=False)
def marks_band(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", text.band(F.col("l_quantity").cast("int")).alias("band"))
