"""Near duplicates against brute force: crowded groups around the threshold, a common passage, repeated ids, odd texts."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quaestor.llm import neardup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows):
    """[(doc_id, n_shingles, component_id)] sorted, by comparing all pairs that share a shingle."""
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    seen = set()
    for held in holders.values():
        for x in range(len(held)):
            for y in range(x):
                a, b = held[y], held[x]
                if (a, b) not in seen and rows[a][0] is not None and rows[b][0] is not None:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        parent[root(b)] = root(a)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        if rng.random() < 0.5:
            out.insert(at, f"new{rng.randrange(10**6)}")
        elif len(out) > 10:
            del out[at]
    return out


def corpus():
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    base, passage = fresh(150), fresh(60)
    rows = [" ".join(edited(rng, base, rng.randrange(0, 14))) for _ in range(260)]
    rows += [" ".join(passage + fresh(rng.randrange(1, 60))) for _ in range(120)]
    rows += [" ".join(fresh(rng.randrange(1, 400))) for _ in range(60)]
    rows += [rows[0]] * 30 + [rows[0].upper()] * 3 + [None, "", " \n\t", "one two", "One\ttwo", "one two three", "word " * 3000]
    rng.shuffle(rows)
    out = [(i + 1, t) for i, t in enumerate(rows)]
    other = " ".join(fresh(80))
    # Ids that repeat with another text, rows that repeat both, and a null id.
    return [*out, (1, other), (5000, other + " more"), (2, "alone here with its own few words"), out[5], (None, rows[3])]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0.0, 1) for r in rows], "doc_id long, text string, sig double, id int")
    got = neardup.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    stays = neardup.deduplicate(docs).collect()
    texts = {(r["doc_id"], r["text"]) for r in stays}
    assert len([r for r in stays if r["doc_id"] is None]) == 1
    # One document of each component: as many as brute force has components over (doc_id, text).
    distinct = sorted({r for r in rows if r[0] is not None}, key=repr)
    renamed = {i: r for i, r in enumerate(distinct)}
    parts = {c for _, _, c in brute([(i, r[1]) for i, r in renamed.items()])}
    assert len({t for t in texts if t[0] is not None}) == len(parts)


def test_sf_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("piece", [16, 200, 1 << 20])
def test_shingle_sets_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(neardup, "PIECE", piece)
    rng = random.Random(2)
    texts = ["", None, "a", " a", "A b", "é ß x y z q", "x" * 400, "tail space "] + ["".join(rng.choice("ab \n\tÄ\x0b") for _ in range(rng.randrange(900))) for _ in range(60)]
    got = list(neardup.shingle_sets(pa.chunked_array([texts]).combine_chunks()))
    assert [len(s) for s in got] == [len(brute_set(t)) for t in texts]
    memo = {}
    for s, t in zip(got, texts):
        for g in s.tolist():
            memo.setdefault(g, set()).add(t)
    whole = list(neardup.shingle_sets(pa.array(texts + texts)[len(texts) :]))
    assert all(np.array_equal(a, b) for a, b in zip(got, whole))


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert neardup.deduplicate(spark.createDataFrame([], "doc_id long, text string, x int")).columns == ["doc_id", "text", "x"]
