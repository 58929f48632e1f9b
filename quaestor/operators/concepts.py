"""Scores of concepts: what a minute of study is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The syllabus prior (hours and marks by unit) and the weight of corpus evidence by regime.
HOURS = {1: 8, 2: 9, 3: 10, 4: 10, 5: 8}
UNIT_MARKS = 20
EVIDENCE = {"high": 0.85, "medium": 0.60, "low": 0.35}


def linked(clusters: DataFrame) -> DataFrame:
    """A row for each cluster and concept: the cluster's type weighs 1, its size class 0.4."""
    size_class = F.concat(F.lit("size "), F.floor((F.col("p_size") - 1) / 10).cast("string"))
    both = F.array(F.struct(F.col("p_type").alias("concept_id"), F.lit(1.0).alias("weight")), F.struct(size_class.alias("concept_id"), F.lit(0.4).alias("weight")))
    return clusters.withColumn("_link", F.explode(both)).select("*", "_link.concept_id", "_link.weight").drop("_link")


def prior(units: Column) -> Column:
    """Marks that the syllabus expects of a concept of these units; none for no units."""
    total = sum(HOURS.values())
    marks = F.create_map(*[x for u, h in HOURS.items() for x in (F.lit(u), F.lit(UNIT_MARKS * h / total))])
    return F.coalesce(F.try_divide(F.aggregate(units, F.lit(0.0), lambda a, u: a + F.coalesce(F.try_element_at(marks, u.cast("int")), F.lit(0.0))), F.size(units)), F.lit(0.0))


def study_cost(depth: Column, rate: Column) -> Column:
    """Whole minutes: by depth alone where no escalation is known, else scaled and at least five."""
    base = 12.0 + 6.0 * depth
    return F.when(rate.isNull(), F.floor(base + 0.5)).otherwise(F.greatest(F.lit(5).cast("long"), F.floor(base * (0.85 + 1.15 * rate) + 0.5)))


def concept_rows(links: DataFrame) -> DataFrame:
    """One aggregate over the links: corpus marks, evidence, units, escalation rate, depth, prior and cost."""
    rows = links.groupBy("subject_id", "concept_id").agg(
        F.sum(F.col("expected_marks") * F.col("weight")).alias("corpus"), F.count("*").alias("evidence"),
        F.array_sort(F.collect_set(F.when(F.col("n") >= 3, F.col("unit_no")))).alias("units"), F.avg((F.col("marks") == 15).cast("double")).alias("hard"),
    )
    rows = rows.withColumn("rate", F.when(F.col("evidence") >= 3, F.col("hard"))).withColumn("depth", F.length("concept_id") % 5)
    return rows.withColumn("prior", prior(F.col("units"))).withColumn("cost", study_cost(F.col("depth"), F.col("rate"))).drop("hard")


def scored(rows: DataFrame, regimes: DataFrame) -> DataFrame:
    """rows with expected_marks, roi and place (by roi, marks, id; rounded so that engines agree on ties)."""
    corpus = F.element_at(F.create_map(*[x for k, v in EVIDENCE.items() for x in (F.lit(k), F.lit(v))]), F.col("regime"))
    rows = rows.join(regimes.select("subject_id", "regime"), "subject_id").withColumn("expected_marks", corpus * F.col("corpus") + (1 - corpus) * F.col("prior"))
    rows = rows.withColumn("roi", F.when(F.col("cost") > 0, F.col("expected_marks") / F.col("cost")).otherwise(0.0))
    order = Window.partitionBy("subject_id").orderBy(F.round("roi", 9).desc(), F.round("expected_marks", 9).desc(), "concept_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long"))
