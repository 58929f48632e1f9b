"""Top-k against brute force: clusters, ties, repeated ids, several lengths, many chunks and blocks."""

import numpy as np
import pytest

from quaestor.llm import topk

SCHEMA = "vec_id long, embedding array<float>, worst string, chunk int"


def brute(rows, k=5):
    e = {}
    fine = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    for i, v in fine:
        if i % 50 == 0:
            e[i] = min(e.get(i, tuple(v)), tuple(v))
    out = set()
    for q, v in e.items():
        best = sorted((-int(np.dot(v, x)), j) for j, x in fine if j != q and len(x) == len(v))[:k]
        out |= {(q, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("chunk,block", [(4096, 2048), (150, 3)])
def test_against_brute_force(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.2).tolist()) for i in range(900)]
    rows += [(900 + i, rows[50][1]) for i in range(9)]  # ties
    rows += [(1000 + i, rng.normal(size=3).tolist()) for i in range(60)]  # another length
    rows += [(7, [1.0] * 16), (50, [0.5] * 16), (2000, None), (2050, []), (2100, [float("nan")] * 16), (2150, [1.0, None]), (None, [1.0] * 16), (2200, [float("inf")] * 16), (2250, [1.0, 2.0])]
    docs = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    got = {tuple(r) for r in topk.top_k(docs).collect()}
    assert got == brute(rows)


def test_trees_cover_and_separate():
    x = np.random.default_rng(2).normal(size=(700, 8))
    stack, seen = [topk.cover_tree(x)], 0
    while stack:
        n = stack.pop()
        assert np.sqrt(((x[n.rows] - x[n.centre]) ** 2).sum(1)).max() <= n.radius + 1e-9
        if n.children:
            c = x[[m.centre for m in n.children]]
            d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
            assert d[np.triu_indices(len(c), 1)].min() > n.radius / topk.BASE - 1e-9 and sorted(np.concatenate([m.rows for m in n.children])) == sorted(n.rows)
            stack += n.children
            seen += 1
    assert seen


def test_empty_and_inexact(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(Exception, match="not exact"):
        topk.top_k(spark.createDataFrame([(50, [1e9, 1e9], "", 1), (51, [1e9, 1e9], "", 1)], SCHEMA)).collect()
