"""Reads that serve people: lookups, scopes, queues, sweeps, gaps, folds of evaluation, and retries around a commit."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class NotFound(LookupError):
    """No row has the id asked for."""


class VersionConflict(RuntimeError):
    """Another writer changed the row since it was read."""


def lookup(table: DataFrame, key: str, raw: str) -> DataFrame:
    """The row of an id given as digits: a ValueError for anything else, NotFound where no row has it."""
    if not re.fullmatch(r"[0-9]+", raw):
        raise ValueError(f"{raw!r} is no id")
    found = table.where(F.col(key) == int(raw))
    if found.isEmpty():
        raise NotFound(f"{key} {raw}")
    return found


class Private:
    """A table that is read and written for one user at a time; rows without a user cannot be put in."""

    def __init__(self, table: DataFrame, user: str = "user_id"):
        if user not in table.columns:
            raise ValueError(f"a private table needs the column {user}")
        self._table, self._user = table, user

    def of(self, user) -> DataFrame:
        if user is None:
            raise ValueError("a private table is read for a user")
        return self._table.where(F.col(self._user) == user)

    def latest(self, user, at: str, tie: str, most: int) -> DataFrame:
        """The newest rows of a user."""
        return self.of(user).orderBy(F.desc(at), F.desc(tie)).limit(most)

    def added(self, rows: DataFrame, user) -> Private:
        return Private(self._table.unionByName(rows.withColumn(self._user, F.lit(user)).select(*self._table.columns)), self._user)


def retried(commit: Callable[[], object], attempts: int = 4, base_s: float = 0.02, sleep: Callable[[float], None] = time.sleep):
    """commit(), again after a VersionConflict only, each time later and not in step with others."""
    for n in range(attempts):
        try:
            return commit()
        except VersionConflict:
            if n + 1 == attempts:
                raise
            sleep(base_s * 2**n * (0.5 + random.random()))


def retry_after_ms(attempt: Column, key: Column, base_ms: int = 2000, jitter: float = 0.5) -> Column:
    """When a job's attempt (from 1) is tried again: twice as late each time, off by up to half, the same on every run."""
    share = F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(1000)) / 1000.0
    return F.floor(base_ms * F.pow(F.lit(2.0), (attempt - 1).cast("double")) * (1 - jitter + 2 * jitter * share)).cast("long")


def attributed(jobs: DataFrame, papers: DataFrame, questions: DataFrame, clusters: DataFrame) -> DataFrame:
    """jobs (subject_id, paper_id, question_id, question_ids, cluster_ids) with subject: of the first of these that a job names."""
    subject, paper = F.col("subject_id").isNull(), F.col("paper_id").isNull()
    question = F.coalesce("question_id", F.get("question_ids", F.lit(0)))
    asked = jobs.withColumns({"_p": F.when(subject, F.col("paper_id")), "_q": F.when(subject & paper, question), "_c": F.when(subject & paper & question.isNull(), F.get("cluster_ids", F.lit(0)))})
    for key, table in (("_p", papers.select("paper_id", "subject_id")), ("_q", questions.select("question_id", "subject_id")), ("_c", clusters.select("cluster_id", "subject_id"))):
        other = table.toDF(f"{key}_id", f"{key}_subject")
        asked = asked.join(other, F.col(key) == F.col(f"{key}_id"), "left").drop(f"{key}_id")
    return asked.withColumn("subject", F.coalesce("subject_id", "_p_subject", "_q_subject", "_c_subject")).drop("_p", "_q", "_c", "_p_subject", "_q_subject", "_c_subject")


def gate(confidence: Column) -> Column:
    """What happens to a proposed merge: above 0.85 it is made, from 0.60 a person looks at it, below it is dropped."""
    return F.when(confidence > 0.85, "auto").when(confidence >= 0.60, "review").otherwise("reject")


def moved(members: DataFrame, survivors: DataFrame, decided_by: str, confidence: float) -> DataFrame:
    """members (question_id, cluster_id, decided_by, confidence) after merges (cluster, survivor): only those of absorbed clusters change."""
    absorbed = survivors.where("cluster <> survivor").select(F.col("cluster").alias("cluster_id"), "survivor")
    out, gone = members.join(absorbed, "cluster_id", "left"), F.col("survivor").isNotNull()
    return out.select("question_id", F.coalesce("survivor", "cluster_id").alias("cluster_id"), F.when(gone, F.lit(decided_by)).otherwise(F.col("decided_by")).alias("decided_by"), F.when(gone, F.lit(confidence)).otherwise(F.col("confidence")).alias("confidence"))


def after_merges(clusters: DataFrame, survivors: DataFrame) -> DataFrame:
    """clusters (cluster_id, version, ...): absorbed ones go, those that absorb get the next version and keep all else."""
    gone = survivors.where("cluster <> survivor")
    grown = gone.select(F.col("survivor").alias("cluster_id")).distinct().withColumn("_grown", F.lit(1))
    rest = clusters.join(gone.select(F.col("cluster").alias("cluster_id")), "cluster_id", "left_anti").join(grown, "cluster_id", "left")
    return rest.withColumn("version", F.col("version") + F.coalesce("_grown", F.lit(0))).drop("_grown")


def split(members: DataFrame, clusters: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, clusters) after questions (mapping: question_id, to_cluster) leave their clusters, whose versions grow by one."""
    out = members.join(mapping, "question_id", "left").withColumn("_from", F.when(F.col("to_cluster").isNotNull(), F.col("cluster_id")))
    left = out.where("_from is not null").select(F.col("_from").alias("cluster_id")).distinct().withColumn("_left", F.lit(1))
    bumped = clusters.join(left, "cluster_id", "left").withColumn("version", F.col("version") + F.coalesce("_left", F.lit(0))).drop("_left")
    return out.withColumn("cluster_id", F.coalesce("to_cluster", "cluster_id")).drop("to_cluster", "_from"), bumped


def rehashed(contributions: DataFrame, winners: DataFrame) -> DataFrame:
    """contributions (paper_id, user_id) after provisional papers (loser, winner) turn out to be others: credits move, once each."""
    return contributions.join(winners.select(F.col("loser").alias("paper_id"), "winner"), "paper_id", "left").select(F.coalesce("winner", "paper_id").alias("paper_id"), "user_id").distinct()


def due(mastery: DataFrame, as_of: Column) -> DataFrame:
    """The rows whose time to be seen again has come."""
    return mastery.where(F.col("due_at") <= as_of)


def coverage(ranked: DataFrame, test: DataFrame, group: list[str], key: str, most: int) -> DataFrame:
    """For each group, the share of the test's marks (key, m) in the first `most` places of ranked (key, place)."""
    best = ranked.where(F.col("place") <= most).select(*group, key, F.lit(1).alias("_hit"))
    return test.join(best, [*group, key], "left").groupBy(*group).agg(F.round(F.sum(F.when(F.col("_hit") == 1, F.col("m")).otherwise(0)) / F.sum("m"), 6).alias("coverage"))


def pair_quality(rows: DataFrame, predicted: list[str], true: list[str]) -> DataFrame:
    """precision and recall of pairs put together, from group sizes alone: no pair is made."""
    pairs = lambda name, keys: rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("p")).select(F.lit(name).alias("kind"), "p")
    three = pairs("both", [*predicted, *true]).unionByName(pairs("said", predicted)).unionByName(pairs("there", true))
    both, said, there = (F.max(F.when(F.col("kind") == k, F.col("p"))) for k in ("both", "said", "there"))
    return three.agg(F.round(F.try_divide(both, said), 6).alias("precision"), F.round(F.try_divide(both, there), 6).alias("recall"))


def sampled(slots: DataFrame, pool: DataFrame, group: list[str], uniform: Column) -> DataFrame:
    """pool rows of each group (with slots) drawn without replacement, by weight p: the least -ln(u) / p win."""
    key = -F.log(uniform) / F.col("p")
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.round(key, 9), "id"))
    return pool.join(slots, group).where("p > 0").withColumn("place", place.cast("long")).where(F.col("place") <= F.col("slots"))
