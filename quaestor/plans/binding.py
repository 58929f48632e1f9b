"""The domain's tables over the order tables: papers, questions, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, subject_id, exam_year, exam_type, college."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*map(F.lit, ("endsem", "assessment", "quiz", "supplementary", "retest"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    college = F.when(F.col("o_orderstatus") == "F", "CEG").when(F.col("o_orderstatus") == "P", "MIT")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(F.col("o_orderkey").alias("paper_id"), F.col("c_nationkey").alias("subject_id"), F.year("o_orderdate").cast("long").alias("exam_year"), kind.alias("exam_type"), college.alias("college"), F.when(F.month("o_orderdate") <= 6, "apr-may").otherwise("nov-dec").alias("session"))


def questions(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """paper_id, part_id, number, marks, subject_id, exam_year, exam_type, college (and extra): a row for each question."""
    marks = F.element_at(F.array(*map(F.lit, (2, 5, 8, 13, 15))), (F.col("l_quantity").cast("int") % 5 + 1)).cast("long")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("part_id"), F.col("l_linenumber").alias("number"), marks.alias("marks"), *extra)
    return lines.join(papers(spark, sf_dir), "paper_id")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """questions with nth among those of one number, label (a, b, ..., null when alone) and or_group (the number of alternatives)."""
    order = ("part_id", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    same = Window.partitionBy("paper_id", "number")
    rows = questions(spark, sf_dir, order[1:]).withColumn("nth", F.row_number().over(same.orderBy(*order))).withColumn("alike", F.count("*").over(same))
    some = F.col("alike") > 1
    return rows.withColumn("label", F.when(some, F.char(96 + F.col("nth")))).withColumn("or_group", F.when(some, F.col("number"))).drop(*order[1:])


LABELLED = """, labelled AS (
  SELECT paper_id, number, part_id, marks, subject_id, exam_year, exam_type, college, session, nth, CASE WHEN alike > 1 THEN chr(CAST(96 + nth AS INT)) END AS label, CASE WHEN alike > 1 THEN number END AS or_group
  FROM (SELECT l_orderkey AS paper_id, l_linenumber AS number, l_partkey AS part_id, papers.subject_id, exam_year, exam_type, college,
      CAST(CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 8 WHEN 3 THEN 13 ELSE 15 END AS BIGINT) AS marks,
      CASE WHEN month(o_orderdate) <= 6 THEN 'apr-may' ELSE 'nov-dec' END AS session,
      row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS nth,
      count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS alike
    FROM lineitem JOIN papers ON l_orderkey = paper_id JOIN orders ON l_orderkey = o_orderkey))
"""

#: The same in SQL.
SQL = """
WITH papers AS (
  SELECT o_orderkey AS paper_id, c_nationkey AS subject_id, CAST(year(o_orderdate) AS BIGINT) AS exam_year,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'endsem' WHEN '2' THEN 'assessment' WHEN '3' THEN 'quiz' WHEN '4' THEN 'supplementary' ELSE 'retest' END AS exam_type,
    CASE o_orderstatus WHEN 'F' THEN 'CEG' WHEN 'P' THEN 'MIT' END AS college
  FROM orders JOIN customer ON o_custkey = c_custkey),
questions AS (
  SELECT l_orderkey AS paper_id, l_partkey AS part_id, l_linenumber AS number,
    CAST(CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 8 WHEN 3 THEN 13 ELSE 15 END AS BIGINT) AS marks,
    subject_id, exam_year, exam_type, college
  FROM lineitem JOIN papers ON l_orderkey = paper_id),
clusters AS (
  SELECT subject_id, part_id, count(*) AS n, min(exam_year) AS first_year, max(exam_year) AS last_year, count(DISTINCT exam_year) AS years, max(marks) AS marks,
    sum(pow(0.75, greatest(0, 2002 - exam_year))) * CASE WHEN max(exam_year) < 1998 THEN 0.5 ELSE 1.0 END AS freq,
    CASE WHEN count(*) = 1 THEN least(greatest(0, 2002 - max(exam_year)), 3.0)
         WHEN max(exam_year) = min(exam_year) THEN 1.0
         ELSE least(greatest(0, 2002 - max(exam_year)) * (count(*) - 1.0) / nullif(max(exam_year) - min(exam_year), 0), 3.0) END AS overdue
  FROM questions GROUP BY 1, 2),
united AS (SELECT clusters.*, (p_size - 1) % 5 + 1 AS unit_no FROM clusters JOIN part ON part_id = p_partkey),
scored AS (
  SELECT *, least(2.0 / count(*) OVER (PARTITION BY subject_id, unit_no), 1.0) AS quota,
    0.45 * freq + 0.25 * overdue + 0.15 * least(2.0 / count(*) OVER (PARTITION BY subject_id, unit_no), 1.0)
      + 0.15 * marks / greatest(1, max(marks) OVER (PARTITION BY subject_id)) AS score
  FROM united),
expected AS (SELECT *, score / sum(score) OVER (PARTITION BY subject_id) * marks AS expected_marks FROM scored)
"""
