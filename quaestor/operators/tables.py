"""Table operators: upsert, first writer wins, credits, cascades, dead letters, and folds over ordered keys."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows in the place of those of equal keys; rows must be unique by keys."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def absent(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys the table lacks, the first writer's only: what a put-if-absent sink has to write."""
    return rows.join(table.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def arrivals(uploads: DataFrame, order: str) -> DataFrame:
    """uploads (subject, user, hash, upload_id) with paper_id (the first arrival's upload_id) and created.

    The first by column `order` is an aggregate that is joined back, so a hash that many send fills no task.
    """
    first = uploads.groupBy("subject", "hash").agg(F.min_by("upload_id", F.struct(F.col(order).alias("at"), F.col("upload_id").alias("id"))).alias("paper_id"))
    return uploads.join(first, ["subject", "hash"]).withColumn("created", F.col("upload_id") == F.col("paper_id"))


def credits(arrived: DataFrame) -> DataFrame:
    """paper_id, user: those who sent what was there already, once each."""
    return arrived.where(~F.col("created")).select("paper_id", "user").distinct()


def cascade(child: DataFrame, key: str, deleted: DataFrame) -> DataFrame:
    return child.join(deleted.select(key), key, "left_anti")


def dead_letters(failures: DataFrame, attempts: int = 5) -> DataFrame:
    """The failure with which a job (job_id) used up its attempts: one row for each such job."""
    order = Window.partitionBy("job_id").orderBy("ts", "event_id")
    return failures.withColumn("attempt", F.row_number().over(order)).where(F.col("attempt") == attempts)


def folded(rows: DataFrame, key: str, order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """step(state, row) -> (state, output row or None) over each key's rows in order.

    Keys are dealt out by hash and sorted on the JVM, which spills; batches are streamed with the state carried along, so
    a key of any length takes the memory of one batch.
    """

    def run(batches):
        at, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if state is None or getattr(row, key) != at:
                    at, state = getattr(row, key), start(getattr(row, key))
                state, got = step(state, row)
                if got is not None:
                    out.append(got)
            names = [x.split()[0] for x in schema.split(",")]
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(run, schema)
