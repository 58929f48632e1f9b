"""Deduplication keeps one row for each text, whatever the ids."""

from quaestor.llm import exact_dedup


def test_null_and_repeated_ids(spark):
    rows = [(None, "a", 1), (None, "b", 2), (3, "a", 3), (4, "c", 4), (4, "d", 5), (5, "c", 6), (6, "e", 7), (6, "e", 7), (None, None, 8), (None, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int")
    got = sorted((r["text"] or "", r["doc_id"] or 0) for r in exact_dedup.deduplicate(docs).collect())
    assert got == [("", 0), ("a", 3), ("b", 0), ("c", 5), ("d", 4), ("e", 6)]
