"""The inverted-list index against comparing all pairs."""

import numpy as np
import pytest

from quaestor.operators import neighbours
from quaestor.plans import relations
from quaestor.plans.saving import saved

SCHEMA = "id long, grp string, apart long, e array<double>"


def brute(rows, asked, k):
    fit = [r for r in rows if None not in r and all(c is not None and np.isfinite(c) for c in r[3])]
    out = set()
    for q in (r for r in asked if r in fit):
        best = sorted((-round(float(np.dot(q[3], r[3])), 6), r[0]) for r in fit if r[1] == q[1] and r[2] != q[2])[:k]
        out |= {(q[0], place + 1, other, -s) for place, (s, other) in enumerate(best)}
    return out


def drawn(n=900, groups=3, seed=4):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(20, 16))
    x = middles[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, 16))
    x[::7] = x[0]  # ties
    hot = lambda i: 0 if i % 3 else i % groups
    return [(i, f"g{hot(i)}", i // 3, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("tile", [16, 4096])
def test_exact_form(spark, tile):
    rows = [*drawn(), (1000, None, 1, [1.0] * 16), (1001, "g0", None, [1.0] * 16), (1002, "g0", 5, None), (1003, "g0", 5, [float("nan")] * 16), (1004, "alone", 9, [1.0] * 16), (1005, "two", 9, [1.0] * 16), (1006, "two", 10, [0.0] * 16)]
    asked = rows[::40] + rows[-7:]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, SCHEMA), 5, saved, exact=True, tile=tile)
    assert {(r["q"], r["place"], r["other"], r["similarity"]) for r in got.collect()} == brute(rows, asked, 5)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest(none, none, 5, saved, exact=True).count() == 0


def test_recall_and_probed_lists(spark):
    rows = drawn(3000, seed=6)
    frame = spark.createDataFrame(rows, SCHEMA)
    asked = rows[::30]
    got = neighbours.nearest(frame, spark.createDataFrame(asked, SCHEMA), 5, saved)
    want = {(q, other) for q, _, other, _ in brute(rows, asked, 5)}
    found = {(r["q"], r["other"]) for r in got.collect()}
    print("recall", len(want & found) / len(want))
    assert len(want & found) >= 0.9 * len(want)
    sample = neighbours.sampled(neighbours.sound(frame), 3000)
    centres = neighbours.fitted(sample, 3000)
    probes = neighbours.probes_for(sample, centres, 5, 0.95)
    assert probes < len(centres) / 3  # most lists stay unread
    at = {r[0]: r for r in rows}
    for q, other in found:  # no pair outside the probed lists
        near = np.argsort(-(centres @ np.array(at[q][3])), kind="stable")[:probes]
        assert (neighbours.unit(np.array([at[other][3]])) @ centres.T).argmax() in near


def test_recall_on_the_given_vectors(spark):
    row = relations.vector_recall(spark, "/root/testdata/sf0.01").first()
    assert row["wanted"] > 0 and row["enough"]
