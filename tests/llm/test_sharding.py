"""Shards: near equal bytes, equal texts together, gapless slots, whatever the rows."""

import random
import zlib
from collections import Counter

import pytest

from quaestor.llm import sharding


def check(rows, got, shards, near):
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    by_text, slots, sizes = {}, {}, Counter()
    for r in got:
        by_text.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in by_text.values()) and all(0 <= s < shards for s in slots)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(slots) == shards and max(sizes.values()) <= near * sum(sizes.values()) / shards


@pytest.mark.parametrize("hot", [0, 400])
def test_laws(spark, hot):
    rng = random.Random(hot)
    rows = [(i, "".join(rng.choice("ab cé") for _ in range(int(rng.paretovariate(1.2) * 20) % 900)), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3"]), "x") for i in range(1500)]
    rows += [(2000 + i, "one text that many rows have", "en", "s1", "y") for i in range(hot)] + [(1, None, None, None, None), (2, "", "en", "s9", ""), (5, rows[5][1], "fr", "s5", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, h string").repartition(5)
    check(rows, sharding.sharded(docs, 12).collect(), 12, 1.25)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(rows, sharding.sharded(docs).collect(), 24, 1.35)


def test_one_row_and_no_metadata(spark):
    assert sharding.sharded(spark.createDataFrame([(1, "a")], "doc_id long, text string")).count() == 1
