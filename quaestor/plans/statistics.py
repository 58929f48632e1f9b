"""Queries of the recurrence and concept families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaestor.operators import concepts, planner, recurrence
from quaestor.plans import binding, registry
from quaestor.plans.registry import query

_REGIME = "CASE WHEN papers < 3 THEN 'low' WHEN rate >= 0.25 THEN 'high' WHEN rate >= 0.1 THEN 'medium' ELSE 'low' END"
CONCEPTS = """, linked AS (
  SELECT e.*, p_type AS concept_id, 1.0 AS weight FROM expected e JOIN part ON p_partkey = part_id
  UNION ALL SELECT e.*, 'size ' || CAST((p_size - 1) // 10 AS VARCHAR), 0.4 FROM expected e JOIN part ON p_partkey = part_id),
concept_rows AS (
  SELECT subject_id, concept_id, sum(CAST(expected_marks AS DOUBLE) * weight) AS corpus, count(*) AS evidence, length(concept_id) % 5 AS depth,
    CASE WHEN count(*) >= 3 THEN avg(CASE WHEN marks = 15 THEN 1.0 ELSE 0.0 END) END AS rate,
    coalesce(list_sort(list_distinct(list(unit_no) FILTER (n >= 3))), []) AS units
  FROM linked GROUP BY 1, 2),
concept_costs AS (
  SELECT *, CASE WHEN len(units) = 0 THEN 0.0 ELSE list_sum(list_transform(units, lambda u: 20.0 * [8, 9, 10, 10, 8][CAST(u AS INT)] / 45.0)) / len(units) END AS prior,
    CAST(CASE WHEN rate IS NULL THEN floor(12.0 + 6.0 * depth + 0.5) ELSE greatest(5, floor(CAST(12 + 6 * depth AS DOUBLE) * (0.85 + 1.15 * CAST(rate AS DOUBLE)) + 0.5)) END AS BIGINT) AS cost
  FROM concept_rows),
regimes AS (
  SELECT c.subject_id, CASE WHEN papers < 3 THEN 'low' WHEN rate >= 0.25 THEN 'high' WHEN rate >= 0.1 THEN 'medium' ELSE 'low' END AS regime
  FROM (SELECT subject_id, avg(CASE WHEN years >= 2 THEN 1.0 ELSE 0.0 END) AS rate FROM clusters GROUP BY 1) c
  JOIN (SELECT subject_id, count(*) AS papers FROM papers GROUP BY 1) p USING (subject_id)),
weighed AS (
  SELECT r.*, CASE regime WHEN 'high' THEN 0.85 WHEN 'medium' THEN 0.6 ELSE 0.35 END * corpus + CASE regime WHEN 'high' THEN 0.15 WHEN 'medium' THEN 0.4 ELSE 0.65 END * prior AS em
  FROM concept_costs r JOIN regimes USING (subject_id)),
ranked AS (
  SELECT *, em / cost AS roi, row_number() OVER (PARTITION BY subject_id ORDER BY round(em / cost, 9) DESC, round(em, 9) DESC, concept_id) AS place FROM weighed)
"""


def evidence(spark, sf_dir):
    part = binding.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), "p_type", "p_size", ((F.col("p_size") - 1) % 5 + 1).alias("unit_no"))
    return recurrence.scored(registry.clusters(spark, sf_dir).join(part, "part_id"))


def concept_rows(spark, sf_dir):
    return concepts.concept_rows(concepts.linked(evidence(spark, sf_dir)))


def ranked(spark, sf_dir):
    return concepts.scored(concept_rows(spark, sf_dir), registry.subject_regime(spark, sf_dir))


@query("SELECT subject_id, part_id, CASE WHEN last_year < 1998 THEN 0.5 ELSE 1.0 END AS discount FROM clusters")
def cluster_lineage_discount(spark, sf_dir):
    return registry.clusters(spark, sf_dir).select("subject_id", "part_id", F.when(F.col("last_year") < 1998, 0.5).otherwise(1.0).alias("discount"))


@query("""SELECT subject_id, part_id, round(avg(gap), 6) AS mean_gap FROM (
  SELECT subject_id, part_id, exam_year - lag(exam_year) OVER (PARTITION BY subject_id, part_id ORDER BY exam_year) AS gap FROM questions) GROUP BY 1, 2""")
def cluster_gap_lag_check(spark, sf_dir):
    lag = F.lag("exam_year").over(Window.partitionBy("subject_id", "part_id").orderBy("exam_year"))
    gaps = binding.questions(spark, sf_dir).select("subject_id", "part_id", (F.col("exam_year") - lag).alias("gap"))
    return gaps.groupBy("subject_id", "part_id").agg(F.round(F.avg("gap"), 6).alias("mean_gap"))


def _regime(subject: str, cluster: str, name: str):
    """Regime by other notions of subject and cluster, to meet every band."""

    def run(spark, sf_dir):
        part = binding.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), "p_brand")
        keys = [F.col(c.strip()) for c in cluster.split(",")]
        rows = binding.questions(spark, sf_dir, extra=("l_suppkey",)).join(part, "part_id").select(F.col(subject).cast("string").alias("subject"), *keys, "paper_id", "exam_year")
        seen = rows.groupBy("subject", *keys).agg((F.min("exam_year") < F.max("exam_year")).cast("double").alias("again"))
        rate = seen.groupBy("subject").agg(F.avg("again").alias("rate"))
        papers = rows.groupBy("subject").agg(F.countDistinct("paper_id").alias("papers"))
        regime = F.when(F.col("papers") < 3, "low").when(F.col("rate") >= 0.25, "high").when(F.col("rate") >= 0.1, "medium").otherwise("low")
        return rate.join(papers, "subject").select("subject", F.round("rate", 6).alias("repetition_rate"), regime.alias("regime"))

    run.__name__ = name
    sql = f"""SELECT subject, round(rate, 6) AS repetition_rate, {_REGIME} AS regime FROM
(SELECT subject, avg(again) AS rate FROM (SELECT CAST({subject} AS VARCHAR) AS subject, {cluster}, CASE WHEN count(DISTINCT exam_year) > 1 THEN 1.0 ELSE 0.0 END AS again FROM q GROUP BY ALL) GROUP BY 1)
JOIN (SELECT CAST({subject} AS VARCHAR) AS subject, count(DISTINCT paper_id) AS papers FROM q GROUP BY 1) USING (subject)"""
    return query(", q AS (SELECT paper_id, part_id, l_suppkey, subject_id, exam_year, p_brand FROM (SELECT l_orderkey AS paper_id, l_partkey AS part_id, l_suppkey FROM lineitem) JOIN papers USING (paper_id) JOIN part ON p_partkey = part_id) " + sql)(run)


subject_regime_coarse = _regime("subject_id", "p_brand", "subject_regime_coarse")
subject_regime_fine = _regime("subject_id", "part_id, l_suppkey", "subject_regime_fine")
subject_regime_medium = _regime("p_brand", "part_id, l_suppkey", "subject_regime_medium")


@query(CONCEPTS + "SELECT subject_id, concept_id, round(corpus, 6) AS corpus_marks, evidence FROM concept_rows")
def concept_expected_marks(spark, sf_dir):
    return concept_rows(spark, sf_dir).select("subject_id", "concept_id", F.round("corpus", 6).alias("corpus_marks"), "evidence")


@query(CONCEPTS + "SELECT subject_id, concept_id, len(units) AS units, round(CAST(prior AS DOUBLE), 6) AS prior_marks FROM concept_costs")
def concept_syllabus_prior(spark, sf_dir):
    return concept_rows(spark, sf_dir).select("subject_id", "concept_id", F.size("units").cast("long").alias("units"), F.round("prior", 6).alias("prior_marks"))


@query(CONCEPTS + "SELECT subject_id, concept_id, cost AS study_cost_min FROM concept_costs")
def concept_study_cost(spark, sf_dir):
    return concept_rows(spark, sf_dir).select("subject_id", "concept_id", F.col("cost").alias("study_cost_min"))


@query(CONCEPTS + "SELECT subject_id, concept_id, round(CAST(em AS DOUBLE), 6) AS expected_marks, round(CAST(roi AS DOUBLE), 6) AS roi, place FROM ranked")
def concept_roi_rank(spark, sf_dir):
    return ranked(spark, sf_dir).select("subject_id", "concept_id", F.round("expected_marks", 6).alias("expected_marks"), F.round("roi", 6).alias("roi"), "place")


@query(CONCEPTS + """, bucketed AS (SELECT CASE WHEN len(units) > 0 THEN 'in' ELSE 'out' END AS syllabus, CASE WHEN evidence >= 40 THEN 'often' ELSE 'rarely' END AS asked FROM concept_rows)
SELECT syllabus, count(*) FILTER (asked = 'often') AS often, count(*) FILTER (asked = 'rarely') AS rarely FROM bucketed GROUP BY 1""")
def coverage_matrix(spark, sf_dir):
    rows = concept_rows(spark, sf_dir).groupBy(F.when(F.size("units") > 0, "in").otherwise("out").alias("syllabus"))
    return rows.agg(F.count_if(F.col("evidence") >= 40).alias("often"), F.count_if(F.col("evidence") < 40).alias("rarely"))


def night_before_plan(spark, sf_dir):
    return planner.planned(ranked(spark, sf_dir).select(F.col("subject_id").cast("int").alias("subject_id"), "concept_id", "units", "cost", "expected_marks", "place"))


registry.QUERIES["night_before_plan"] = night_before_plan

_HELD = """, train AS (SELECT subject_id, part_id, round(sum(pow(0.75, 2001 - exam_year)), 9) AS f FROM questions WHERE exam_year < 2001 GROUP BY 1, 2),
test AS (SELECT subject_id, part_id, sum(marks) AS m FROM questions WHERE exam_year = 2001 GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY f DESC, part_id) AS place, max(f) OVER (PARTITION BY subject_id) AS top FROM train)
"""


def _held_out(spark, sf_dir):
    """(train, test marks): the years before 2001 and 2001."""
    rows = binding.questions(spark, sf_dir)
    train = rows.where("exam_year < 2001").groupBy("subject_id", "part_id").agg(F.round(F.sum(F.pow(F.lit(0.75), (2001 - F.col("exam_year")).cast("double"))), 9).alias("f"))
    return train, rows.where("exam_year = 2001").groupBy("subject_id", "part_id").agg(F.sum("marks").alias("m"))


@query(_HELD + """SELECT t.subject_id, round(coalesce(sum(m) FILTER (place <= 5), 0) / sum(m), 6) AS at_5, round(coalesce(sum(m) FILTER (place <= 10), 0) / sum(m), 6) AS at_10,
round(coalesce(sum(m) FILTER (place <= 20), 0) / sum(m), 6) AS at_20 FROM test t LEFT JOIN placed p ON p.subject_id = t.subject_id AND p.part_id = t.part_id GROUP BY 1""")
def topk_marks_coverage(spark, sf_dir):
    train, test = _held_out(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("f"), "part_id"))
    best = train.withColumn("place", place).where("place <= 20").select("subject_id", "part_id", "place")  # each task keeps twenty of a subject
    share = lambda k: F.round(F.sum(F.when(F.col("place") <= k, F.col("m")).otherwise(0)) / F.sum("m"), 6).alias(f"at_{k}")
    return test.join(best, ["subject_id", "part_id"], "left").groupBy("subject_id").agg(share(5), share(10), share(20))


@query(_HELD + """SELECT CAST(least(4, floor(round(f / top, 9) * 5)) AS BIGINT) AS bin, count(*) AS n, round(avg(f / top), 6) AS predicted, round(avg(CASE WHEN t.m IS NULL THEN 0.0 ELSE 1.0 END), 6) AS observed,
round(avg(pow(f / top - CASE WHEN t.m IS NULL THEN 0.0 ELSE 1.0 END, 2)), 6) AS brier
FROM placed p LEFT JOIN test t ON p.subject_id = t.subject_id AND p.part_id = t.part_id GROUP BY 1""")
def calibration_bins(spark, sf_dir):
    train, test = _held_out(spark, sf_dir)
    p, hit = F.col("f") / F.col("top"), F.col("m").isNotNull().cast("double")
    top = train.groupBy("subject_id").agg(F.max("f").alias("top"))
    rows = train.join(top, "subject_id").join(test, ["subject_id", "part_id"], "left").select(p.alias("p"), hit.alias("hit"))
    bin_ = F.least(F.lit(4).cast("long"), F.floor(F.round("p", 9) * 5)).alias("bin")
    return rows.groupBy(bin_).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg("hit"), 6).alias("observed"), F.round(F.avg(F.pow(F.col("p") - F.col("hit"), F.lit(2.0))), 6).alias("brier"))
