"""Mixing: targets to the word, caps, order and white space of what is taken, odd rows."""

import re
from collections import Counter

import pytest

from quaestor.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_chars int, size string, doc string"


def rows():
    out = [(i, " ".join(f"w{i}_{j}" for j in range(20 + i * 7 % 150)), f"s{i % 5}", 0, "x", "y") for i in range(120)]
    out += [(500, "only four words\n here", "tiny", 0, None, None), (501, None, "tiny", None, "", ""), (502, "", None, 0, "", ""), (503, "a\tb  c\n\nd", None, 0, "", "")]
    return [*out, (7, "another text of the same id", "s1", 0, "p", "q"), (8, "twice the same", "pair", 0, "1", "q"), (8, "twice the same", "pair", 0, "2", "q"), (None, "no id here", "s3", 0, "", "")]


def wanted(data):
    """Target of each source by filling up round after round."""
    size = Counter()
    for r in data:
        size[r[2]] += len(WORDS.findall(r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 3 * size[s]}
        if not full:
            return size, target | {s: weight[s] * level for s in open_}
        target |= {s: 3.0 * size[s] for s in full}
        left -= sum(3.0 * size[s] for s in full)
        open_ -= full
    return size, target


def test_targets_and_caps(spark):
    data = rows()
    got = mixing.mixed(spark.createDataFrame(data, SCHEMA)).collect()
    size, target = wanted(data)
    assert len(got) == len(data)
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in data)
    assert all(0 <= r["taken"] <= 3 * r["size"] and (r["shards"] > 0) == (r["taken"] > 0) for r in got)
    taken = Counter()
    for r in got:
        taken[(r["source_size"], round(r["target"], 6))] += r["taken"]
    for s in size:
        key = next(k for k in taken if k[0] == size[s] and abs(k[1] - target[s]) < 1e-4)
        assert sum(1 for x in size if size[x] == size[s]) > 1 or abs(taken[key] - target[s]) <= 0.5
    again = mixing.mixed(spark.createDataFrame(data, SCHEMA).repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_materialised_agrees_with_counts(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    counts = Counter()
    for r in mixing.mixed(docs).collect():
        counts[r["doc_id"]] += r["taken"]
    out = mixing.materialised(docs)
    assert out.columns == docs.columns
    texts = {}
    for r in out.collect():
        texts.setdefault(r["doc_id"], []).append(r)
        assert r["n_chars"] == len(r["text"])
    assert {d: sum(len(WORDS.findall(r["text"])) for r in x) for d, x in texts.items()} == {d: n for d, n in counts.items() if n}
    # Tiny sources at their cap are repeated whole, with their white space.
    assert texts[500][0]["text"] == "\n".join(["only four words\n here"] * 3)
    assert {("1", "\n".join(["twice the same"] * 3)), ("2", "\n".join(["twice the same"] * 3))} <= {(r["size"], r["text"]) for r in texts[8]}
    source = {}
    for r in data:
        source.setdefault(r[0], set()).update(WORDS.findall(r[1] or ""))
    assert all(set(WORDS.findall(r["text"])) <= source[d] for d, x in texts.items() for r in x)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("x")).collect()
    order = [r["x"] for r in got]
    assert sorted(order) == list(range(n)) and (n < 64 or sum(i == x for i, x in enumerate(order)) < 10)


def test_single_short_document_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "one two three four", "a", 1)], "doc_id long, text string, source string, n_chars long")
    assert [r["text"] for r in mixing.materialised(docs).collect()] == ["one two three four"]
    assert mixing.materialised(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
