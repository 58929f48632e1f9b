"""Merges under the OR rule against taking the pairs one by one."""

import hashlib
import random

import pytest

from quaestor.operators import merging
from quaestor.plans.saving import tabled as saved


def one_by_one(pairs, apart):
    """The group of each cluster and the pairs made, by falling confidence, then digest."""
    group = {c: {c} for p in pairs for c in p[:2]}
    wall = {frozenset(p) for p in apart}
    best = {}
    for a, b, w in pairs:
        if a != b and w is not None:
            best[min(a, b), max(a, b)] = max(w, best.get((min(a, b), max(a, b)), w))
    order = sorted(((w, hashlib.md5(f"{a},{b}".encode()).hexdigest(), a, b) for (a, b), w in best.items()), reverse=True)
    made = []
    for w, _, a, b in order:
        x, y = group[a], group[b]
        if x is y or any(frozenset((i, j)) in wall for i in x for j in y):
            continue
        x |= y
        for c in y:
            group[c] = x
        made.append((a, b, w))
    return {c: min(g) for c, g in group.items()}, made


@pytest.mark.parametrize("seed", range(4))
def test_forest(spark, seed):
    rng = random.Random(seed)
    n = (30, 60, 40, 50)[seed]
    level = (100, 3, 1, 20)[seed]  # from many levels of confidence to one
    pairs = [(rng.randrange(n), rng.randrange(n), rng.randrange(level) / 100) for _ in range(3 * n)]
    if seed == 2:
        pairs = [(i, i + 1, 0.9) for i in range(n)]  # one chain of equal pairs
    apart = [(rng.randrange(n), rng.randrange(n)) for _ in range((20, 90, 6, 0)[seed])]
    labels, made = merging.forest(spark.createDataFrame(pairs, "a long, b long, confidence double"), spark.createDataFrame(apart, "a long, b long"), saved)
    got = {r["cluster"]: r["component"] for r in labels.collect()}
    want, steps = one_by_one(pairs, apart)
    assert got == {c: g for c, g in want.items() if c in got} and all(want[c] == c for c in want if c not in got)
    # other pairs may have joined the same groups, but their least confidence is the same
    weakest = lambda rows: {g: min(w for a, _, w in rows if want[a] == g) for g in {want[a] for a, _, _ in rows}}
    assert weakest([tuple(r) for r in made.select("a", "b", "confidence").collect()]) == weakest(steps)


def test_nothing_to_merge(spark):
    labels, made = merging.forest(spark.createDataFrame([(1, 1, 0.9), (2, 3, None)], "a long, b long, confidence double"), spark.createDataFrame([], "a long, b long"), saved)
    assert labels.count() == 0 and made.count() == 0


def test_flow(spark):
    pairs = [(1, 2, 0.95, 1, None), (2, 3, 0.90, None, None), (3, 4, 0.99, None, 7), (5, 5, 0.99, None, None), (5, 6, 0.85, None, None), (6, 7, 0.5, None, None), (7, 99, 0.9, None, None), (7, 8, 0.9, 1, 1), (8, 9, None, None, None)]
    clusters = [(c, 1, f"text {c}") for c in range(1, 10)]
    members = [(10 * c, c, 100 + c, None, "rule", 1.0) for c in range(1, 10)] + [(11, 1, 500, 2, "human", 0.7), (31, 3, 500, 2, "rule", 1.0)]
    schema = "question_id long, cluster_id long, paper_id long, or_group int, decided_by string, confidence double"
    verdicts, after, moved = merging.merges(spark.createDataFrame(pairs, "a long, b long, confidence double, version_a long, version_b long"), spark.createDataFrame(clusters, "cluster_id long, version long, canonical string"), spark.createDataFrame(members, schema), saved)
    assert {(r["a"], r["b"]): r["verdict"] for r in verdicts.collect()} == {(1, 2): "merged", (2, 3): "refused", (3, 4): "stale", (5, 5): "self", (5, 6): "review", (6, 7): "reject", (7, 99): "gone", (7, 8): "merged", (8, 9): "reject"}
    assert {(r["cluster_id"], r["version"], r["canonical"]) for r in after.collect()} == {(1, 2, "text 1"), (3, 1, "text 3"), (4, 1, "text 4"), (5, 1, "text 5"), (6, 1, "text 6"), (7, 2, "text 7"), (9, 1, "text 9")}
    rows = {r["question_id"]: (r["cluster_id"], r["decided_by"], r["confidence"]) for r in moved.collect()}
    assert rows[20] == (1, "agent", 0.95) and rows[80] == (7, "agent", 0.9) and rows[11] == (1, "human", 0.7) and rows[31] == (3, "rule", 1.0) and len(rows) == len(members)
