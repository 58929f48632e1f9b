"""Periodic runs against the definition: every period, every stretch."""

import hashlib
import random
import re
import zlib

import pytest

from quaestor.llm import periodicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, repeats=4):
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, repeats * q):
                smallest = next(p for p in range(1, q + 1) if all(words[x] == words[x + p] for x in range(i, i + length - p)))
                if smallest == q:
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def drawn(rng):
    kind = rng.randrange(4)
    k = rng.randint(1, 4)
    words = [rng.randrange(k) for _ in range(rng.randint(0, 60))]
    if kind == 1:  # one long repetition amid others
        part = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
        words = words[:10] + (part * 30)[: rng.randint(1, 150)] + words[10:]
    if kind == 2:  # repetitions of repetitions
        part = [0] * rng.randint(1, 7) + [1]
        words = (part * rng.randint(1, 8) + [2]) * rng.randint(1, 6)
    if kind == 3:  # Fibonacci words are full of runs
        a, b = [0], [0, 1]
        for _ in range(rng.randint(1, 8)):
            a, b = b, b + a
        words = b
    return words


@pytest.mark.parametrize(("least", "repeats"), [(6, 4), (2, 2), (3, 3)])
def test_runs_by_definition(least, repeats):
    rng = random.Random(repeats)
    for _ in range(1500):
        words = drawn(rng)
        assert periodicity.runs(words, least, repeats) == brute(words, least, repeats), words


def test_collisions_of_the_hash_are_noticed(monkeypatch):
    monkeypatch.setattr(periodicity, "MODULUS", 3)
    rng = random.Random(9)
    for _ in range(600):
        words = drawn(rng)
        found = set(periodicity.runs(words, 2, 2))
        assert all(words[x] == words[x + p] for s, m, p in found for x in range(s, s + m - p))  # nothing that is not there


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    assert periodicity.scanned("a " * 300_000)[1] == [(0, 300_000, 1)]
    block = " ".join(f"w{i}" for i in range(50_000))
    assert periodicity.scanned(" ".join([block] * 5))[1] == [(0, 250_000, 50_000)]
    assert periodicity.scanned(f"{'a ' * 40_000} b {'a b ' * 40_000}")[1] == [(0, 40_000, 1), (39_999, 80_002, 2)]
    assert time.time() - began < 60


def want(doc_id, text):
    words = WORDS.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    drop = {i for s, m, p in found for i in range(s + p, s + m)}
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def answered(docs):
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    rows = periodicity.digests(periodicity.periodic_runs(periodicity.with_periodic_tails(docs))).select(*names).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_query_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 3000 or text is null")
    assert docs.count() > 100
    rng = random.Random(3)
    ten = [i for i in range(100_000) if zlib.crc32(str(i).encode()) % 10 == 0]
    edge = [(None, "a b"), (None, "x " * 9), (ten[0], None), (ten[1], ""), (ten[2], " \t\n"), (ten[3], "one"), (1, "  \x1c 　 " * 4), (1, "  \x1c 　 " * 4), (ten[4], "é\x0bß\x0c" * 30)]
    edge += [(rng.choice(ten), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))) for _ in range(200)]
    docs = docs.unionByName(spark.createDataFrame(edge, "doc_id long, text string"))
    assert answered(docs) == sorted((want(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, runs string, collapsed int")
    assert answered(docs) == []
    docs = spark.createDataFrame([(7, "a " * 8, "x", 1)], "doc_id int, text string, runs string, _w int")
    row = periodicity.periodic_runs(docs).first()
    assert (row["n_words"], row["collapsed"], [tuple(r) for r in row["runs"]]) == (8, "a", [(0, 8, 1)])
