"""Shared helpers of the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the cluster names; survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getConf().get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))  # one machine, as in tests
    return df.checkpoint()


@contextmanager
def batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that run inside hand Python at most `most` rows at a time. A batch stands in the executor twice, in buffers
    that double, and in the worker once more, so whole texts should come in short ones. The session's own value comes back."""
    before = spark.conf.get(ARROW_ROWS)
    if not 0 < int(before) <= most:
        spark.conf.set(ARROW_ROWS, most)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df, for a broadcast if it is counted to hold at most `most` rows; beyond, joins shuffle it. For narrow rows only."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def buckets_for(rows: int) -> int:
    """Buckets of about 250,000 rows each; at least 64."""
    return max(64, rows // 250_000)


def numbered(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str, buckets: int) -> DataFrame:
    """Exclusive running sum of `value` within `group`, as column `name`.

    A group of any size is dealt over `buckets` by a hash of its order keys, so no task sees a whole hot group: each
    (group, bucket) gets a window of its own, and the sums of the buckets before it come from a small aggregate.
    The order within a group is by bucket, then by `order`.
    """
    keyed = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")).withColumn("_v", value.cast("long"))
    within = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(*group, "_b").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_gb"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    on = F.col("_b") == F.col("_gb")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = keyed.withColumn("_in", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    return out.join(sums, on, "left").withColumn(name, F.col("_in") + F.col("_before")).drop("_b", "_v", "_in", "_gb", "_before", *[f"_g{i}" for i in range(len(group))])
