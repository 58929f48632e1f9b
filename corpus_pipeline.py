"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing; each stage is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm import exact_dedup, mixing, neardup, packing, toxicity
from quaestor.llm.common import batches_of, cut, table
from quaestor.llm.queries import word_bpe

#: Texts that a stage hands Python at a time.
TEXTS = 500
ORACLE_SQL = None  # a learned grammar, MinHash links and a tokenizer are beyond SQL


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go; it learns from the labelled rows outside the held-out fold."""
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "text")  # so that no helper column meets one of theirs
    with batches_of(spark, TEXTS):
        scored = toxicity.scored(whole, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
        return cut(scored.where("predicted = 0").select("doc.*"))  # scored while the batches are short


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with batches_of(spark, TEXTS):  # what is left for later runs no Python
        return neardup.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.materialised(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with batches_of(spark, TEXTS):  # as above
        return packing.packed(docs, word_bpe)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut(spark.range(0))  # sets the shared folder where the cluster names none
    shared = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{name}")
        docs = spark.read.parquet(f"{shared}/{name}")
    return docs
