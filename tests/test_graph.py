"""Cycles, peeling and lineages on drawn graphs, against reachability by hand."""

import random

import pytest

from quaestor.operators import graph, planner, recurrence
from quaestor.plans.saving import tabled

EDGES = "upper long, lower long"


def reach(edges):
    out = {}
    for u, w in edges:
        out.setdefault(u, set()).add(w)
    far = {}
    for n in {n for e in edges for n in e}:
        seen, todo = set(), [n]
        while todo:
            for m in out.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        far[n] = seen
    return far


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 30, 32), (2, 25, 50), (3, 12, 6)])
def test_cycles_and_layers(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    far = reach(edges)
    components = {a: min(b for b in far[a] if a in far[b]) for a in far if a in far[a]}
    frame = spark.createDataFrame([*edges, (None, 1), (2, None)], EDGES)
    assert {r["node"]: r["component"] for r in graph.cycles(frame, tabled).collect()} == components
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
    layers, rest = graph.peeled(frame, nodes, tabled)
    below = {b for a in components for b in far[a]}
    depth = {}

    def longest(node):
        if node not in depth:
            depth[node] = max((1 + longest(u) for u, w in edges if w == node), default=0)
        return depth[node]

    assert {r["node"]: r["depth"] for r in layers.collect()} == {i: longest(i) for i in range(n) if i not in below}
    assert {r["lower"] for r in rest.collect()} == below
    if below:
        with pytest.raises(ValueError, match="cycle"):
            graph.depths(frame, nodes, tabled)


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert graph.cycles(none, tabled).count() == 0
    layers, rest = graph.peeled(none, spark.createDataFrame([(4,)], "node long"), tabled)
    assert [tuple(r) for r in layers.collect()] == [(4, 0)] and rest.count() == 0


def test_lineages_take_the_best_path(spark):
    edges = [(3, 2, 0.5), (2, 1, 0.5), (3, 1, 0.2), (1, 0, None), (0, 3, 0.9), (5, 4, 2.0), (6, None, 0.5), (7, 7, 0.5)]
    paths = recurrence.lineages(spark.createDataFrame(edges, "subject_id long, ancestor long, discount double"), tabled)
    got = {(r["subject_id"], r["ancestor"]): round(r["weight"], 6) for r in paths.collect()}
    assert got == {(3, 2): 0.5, (3, 1): 0.25, (3, 0): 0.25, (2, 1): 0.5, (2, 0): 0.5, (2, 3): 0.45, (1, 0): 1.0, (1, 3): 0.9, (1, 2): 0.45, (0, 3): 0.9, (0, 2): 0.45, (0, 1): 0.225, (5, 4): 1.0}
    clusters = spark.createDataFrame([(4, 1, 2.0), (5, 1, 1.0), (4, 2, 3.0)], "subject_id long, part_id long, raw double")
    rows = {(r["subject_id"], r["part_id"]): (r["raw"], r["freq"]) for r in recurrence.with_ancestors(clusters, paths).collect()}
    assert rows == {(4, 1): (2.0, 2.0), (4, 2): (3.0, 3.0), (5, 1): (1.0, 3.0), (5, 2): (0.0, 3.0)}


def test_clusters_without_a_unit_stay(spark):
    rows = [("s", 1, None, 1.0, 0.0, 10), ("s", 2, 3, 1.0, 1.0, 10)]
    out = {r["part_id"]: (r["quota"], round(r["score"], 6)) for r in recurrence.scored(spark.createDataFrame(rows, "subject_id string, part_id long, unit_no int, freq double, overdue double, marks long")).collect()}
    assert out == {1: (0.0, 0.6), 2: (1.0, 1.0)}


def test_uncovered_units_are_those_with_too_few_minutes(spark):
    rows = [(1, "a", [1], 30, 5.0, 1), (1, "b", [2], 10, 4.0, 2)]
    got = planner.planned(spark.createDataFrame(rows, "subject_id int, concept_id string, units array<int>, cost long, expected_marks double, place long"), units=(1, 2, 3)).collect()
    assert all(r["uncovered"] == [2, 3] and r["unit_minutes"] == [30, 10, 0] for r in got)


@pytest.mark.parametrize("size", [12, 6])
def test_dependents(spark, size):
    rng = random.Random(5)
    edges = [(i, i + rng.randint(1, 9)) for i in range(400) for _ in range(2)] + [(50, 20), (None, 3)]
    far = reach([e for e in edges if None not in e])
    nodes = spark.createDataFrame([(i,) for i in range(420)], "node long")
    rows = {r["node"]: (r["dependents"], r["exact"]) for r in graph.dependents(spark.createDataFrame(edges, EDGES), nodes, tabled, size).collect()}
    want = {i: len(far.get(i, set()) - {i}) for i in range(420)}
    assert all(rows[i][0] == want[i] for i in range(420) if rows[i][1]) and len(rows) == 420
    assert all(rows[i][1] for i in range(420)) if size == 12 else not all(rows[i][1] for i in range(420))
    assert all(abs(rows[i][0] - want[i]) <= 4 / 2 ** (size / 2) * want[i] for i in range(420))  # four standard errors
