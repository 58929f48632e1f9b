"""Ranks within groups of any size: a range sort, a count of each sorted run, and the counts before it.

A window ranks a group in one task. Here the rows are dealt by ranges of (group, order), so a group that holds all rows is
sorted by many tasks; a row's rank is its place in its run, plus the rows of the runs before, minus those of the groups
before. Only one count a run and one number a group are gathered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = 33  # monotonically_increasing_id numbers rows from 2^33 times the partition


def runs(rows: DataFrame, group: list[str], order: list[Column], saved: Callable[[DataFrame], DataFrame], parts: int) -> DataFrame:
    """rows with _run and _nth, sorted by group and order over all runs; order should tell all rows of a group apart."""
    keys = [*map(F.col, group), *order]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    numbered = dealt.withColumn("_id", F.monotonically_increasing_id())
    return saved(numbered.withColumns({"_run": F.shiftright("_id", RUN), "_nth": F.col("_id").bitwiseAND((1 << RUN) - 1)}).drop("_id"))


def ranked(rows: DataFrame, group: list[str], order: list[Column], saved: Callable[[DataFrame], DataFrame], name: str = "place", parts: int = 200) -> DataFrame:
    """rows with `name`, their rank (from 1) in their group by order; no group columns: among all rows. Null groups are one group."""
    sorted_ = runs(rows, group, order, saved, parts)
    counts = sorted_.groupBy("_run").agg(F.count("*").alias("_n"))  # at most `parts` rows, so one task may add them up
    before = counts.select(F.col("_run"), F.coalesce(F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = sorted_.join(F.broadcast(before), "_run").withColumn("_all", F.col("_before") + F.col("_nth") + 1).drop("_run", "_nth", "_before")
    if not group:
        return placed.withColumnRenamed("_all", name)
    first = placed.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg(F.min("_all").alias("_first"))
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = placed.join(first, same).withColumn(name, F.col("_all") - F.col("_first") + 1)
    return out.drop("_all", "_first", *[f"_g{i}" for i in range(len(group))])
