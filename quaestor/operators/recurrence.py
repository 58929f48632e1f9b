"""Recurrence statistics of clusters and subjects, as columns that Catalyst can fuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEAR, DECAY, SLOTS = 2002, 0.75, 2.0
# What decayed frequency, overdue ratio, unit quota and marks weigh in a cluster's score.
WEIGHTS = (0.45, 0.25, 0.15, 0.15)


def sliced(questions: DataFrame, exam_types: tuple[str, ...] = (), college: str | None = None) -> DataFrame:
    """The questions of these kinds of exam (none: all) and of this college (none: all)."""
    rows = questions.where(F.col("exam_type").isin(*exam_types)) if exam_types else questions
    return rows if college is None else rows.where(F.col("college") == college)


def cluster_stats(questions: DataFrame, year: int = YEAR, decay: float = DECAY, discount: Column | None = None) -> DataFrame:
    """One aggregate, combined on the map side: n, first and last year, years, marks, decayed frequency, overdue ratio.

    discount: what the frequency is multiplied by, from the columns of the aggregate; 1 where there is none.
    """
    decay = F.pow(F.lit(decay), F.greatest(F.lit(0), F.lit(year) - F.col("exam_year")).cast("double"))
    rows = questions.groupBy("subject_id", "part_id").agg(F.count("*").alias("n"), F.min("exam_year").alias("first_year"), F.max("exam_year").alias("last_year"), F.size(F.collect_set("exam_year")).cast("long").alias("years"), F.max("marks").alias("marks"), F.sum(decay).alias("raw"))
    since = F.greatest(F.lit(0), F.lit(year) - F.col("last_year")).cast("double")
    span = (F.col("last_year") - F.col("first_year")).cast("double")
    overdue = F.when(F.col("n") == 1, F.least(since, F.lit(3.0))).when(span == 0, F.lit(1.0)).otherwise(F.least(F.try_divide(since * (F.col("n") - 1), span), F.lit(3.0)))
    return rows.withColumn("freq", F.col("raw") * (F.lit(1.0) if discount is None else discount)).withColumn("overdue", overdue).drop("raw")


def scored(clusters: DataFrame, weights: tuple[float, float, float, float] = WEIGHTS) -> DataFrame:
    """clusters (with unit_no) with quota, score and expected_marks; a cluster without a unit competes for no slots, so its quota is 0.

    What a subject or a unit has in all is an aggregate, combined on the map side, that is joined back (by broadcast where
    it turns out small): no task holds a subject's clusters.
    """
    frequent, overdue, slots, worth = weights
    crowd = clusters.where("unit_no is not null").groupBy("subject_id", "unit_no").agg(F.count("*").alias("_competitors"))
    top = clusters.groupBy("subject_id").agg(F.max("marks").alias("_top"))
    quota = F.when(F.col("_competitors").isNull(), 0.0).otherwise(F.least(F.lit(SLOTS) / F.col("_competitors"), F.lit(1.0)))
    rows = clusters.join(crowd, ["subject_id", "unit_no"], "left").join(top, "subject_id").withColumn("quota", quota)
    score = frequent * F.col("freq") + overdue * F.coalesce("overdue", F.lit(0.0)) + slots * F.col("quota") + worth * F.col("marks") / F.greatest(F.lit(1), F.col("_top"))
    rows = rows.withColumn("score", score).drop("_competitors", "_top")
    total = rows.groupBy("subject_id").agg(F.sum("score").alias("_total"))
    share = F.when(F.col("_total") > 0, F.col("score") / F.col("_total")).otherwise(0.0)
    return rows.join(total, "subject_id").withColumn("expected_marks", share * F.col("marks")).drop("_total")


def pressure(clusters: DataFrame, slots: DataFrame) -> DataFrame:
    """clusters with quota: the slots (subject_id, unit_no, slots) of its unit for each competitor, at most 1; 0 without a unit or without slots."""
    crowd = clusters.where("unit_no is not null").groupBy("subject_id", "unit_no").agg(F.count("*").alias("_competitors"))
    rows = clusters.join(crowd, ["subject_id", "unit_no"], "left").join(slots, ["subject_id", "unit_no"], "left")
    quota = F.coalesce(F.least(F.try_divide(F.coalesce("slots", F.lit(0)).cast("double"), F.col("_competitors")), F.lit(1.0)), F.lit(0.0))
    return rows.withColumn("quota", F.when(F.col("unit_no").isNull(), 0.0).otherwise(quota)).drop("_competitors", "slots")


def inherited(clusters: DataFrame, lineage: DataFrame) -> DataFrame:
    """clusters (subject_id, raw) with freq: raw times the discount of the lineage (subject_id, discount), 1 where it has none."""
    return clusters.join(lineage, "subject_id", "left").withColumn("freq", F.col("raw") * F.coalesce("discount", F.lit(1.0))).drop("discount")


def lineages(edges: DataFrame, saved) -> DataFrame:
    """subject_id, ancestor, weight: every ancestor along edges (subject_id, ancestor, discount), with the greatest product of discounts.

    A round extends the paths found new or better in the one before by an edge. Discounts are at most 1 (greater ones count as
    1), so going round a cycle never gains, and the rounds end with the longest path worth taking. A null discount is 1.
    """
    rate = F.least(F.coalesce(F.col("discount").cast("double"), F.lit(1.0)), F.lit(1.0))
    up = saved(edges.where("subject_id is not null and ancestor is not null and subject_id <> ancestor").groupBy("subject_id", "ancestor").agg(F.max(rate).alias("weight")))
    best, fresh = up, up
    step = up.select(F.col("subject_id").alias("_a"), F.col("ancestor").alias("_up"), F.col("weight").alias("_w"))
    while True:
        far = fresh.join(step, F.col("ancestor") == F.col("_a")).where("subject_id <> _up").groupBy("subject_id", F.col("_up").alias("ancestor")).agg(F.max(F.col("weight") * F.col("_w")).alias("weight"))
        known = best.select("subject_id", "ancestor", F.col("weight").alias("_was"))
        fresh = saved(far.join(known, ["subject_id", "ancestor"], "left").where("_was is null or weight > _was").drop("_was"))
        if not fresh.take(1):
            return best
        best = saved(best.unionByName(fresh).groupBy("subject_id", "ancestor").agg(F.max("weight").alias("weight")))


def with_ancestors(clusters: DataFrame, paths: DataFrame) -> DataFrame:
    """subject_id, part_id, raw, freq: a cluster's own evidence (subject_id, part_id, raw) and that of the subject's ancestors, each by its weight.

    raw is the subject's own evidence, 0 for a cluster that only ancestors have.
    """
    own = clusters.select("subject_id", "part_id", F.col("raw").alias("own"), F.col("raw").alias("part"))
    theirs = clusters.select(F.col("subject_id").alias("ancestor"), "part_id", "raw").join(paths, "ancestor")
    both = own.unionByName(theirs.select("subject_id", "part_id", F.lit(0.0).alias("own"), (F.col("raw") * F.col("weight")).alias("part")))
    return both.groupBy("subject_id", "part_id").agg(F.sum("own").alias("raw"), F.sum("part").alias("freq"))
