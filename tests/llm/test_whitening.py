"""Whitening against numpy's own eigenvectors and Python's whole numbers."""

import numpy as np
import pytest

from quaestor.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=4):
    x = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - np.array(sums) / n
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    deviation = {i: sum((n * int(c) - s) ** 2 for c, s in zip(r, sums)) for i, r in x.items()}
    return n, deviation, {i: (r - np.array(sums) / n) @ q / np.sqrt(e) for i, r in x.items()}, e / np.trace(v)


def agrees(rows, got, k=4):
    n, deviation, want, shares = brute(rows, k)
    assert sorted({(r["vec_id"], r["component"]) for r in got}) == sorted((i, c + 1) for i in deviation for c in range(k))
    signs = {}
    for r in got:
        i, c = r["vec_id"], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[i]
        assert r["explained"] == pytest.approx(shares[c], rel=1e-9) and r["identity_error"] < 1e-9
        assert abs(r["whitened"]) == pytest.approx(abs(want[i][c]), rel=1e-6, abs=1e-7)
        if abs(want[i][c]) > 1e-3:
            signs.setdefault(c, set()).add(np.sign(r["whitened"] * want[i][c]))
    assert all(len(s) == 1 for s in signs.values())


def test_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    agrees([tuple(r) for r in rows.collect()], whitening.whitened(rows).collect())


@pytest.mark.parametrize("width", [2, 4, 16])
def test_narrow_blocks_iterate_to_the_same(spark, width):
    rng = np.random.default_rng(width)
    x = rng.standard_normal((900, 96)) * 4 * 0.85 ** np.arange(96) @ np.linalg.qr(rng.standard_normal((96, 96)))[0]
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    frame = spark.createDataFrame(rows, SCHEMA)
    agrees(rows, whitening.whitened(frame, width=width).collect())
    fit = whitening.integers(frame).select("x").distinct()
    passes = whitening.fitted(fit, width=width).passes
    assert passes > 2 and (width > 2 or passes > 8)


def test_nulls_repeats_and_other_lengths(spark):
    rng = np.random.default_rng(5)
    good = [(i, v) for i, v in enumerate(rng.standard_normal((60, 5)).astype(np.float32).tolist())]
    rows = [*good, (60, good[0][1]), (61, good[0][1]), (62, None), (63, [1.0, None, 0.0, 0.0, 0.0]), (64, [float("nan")] * 5), (65, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([*rows, (66, []), (67, [1.0, 2.0])], SCHEMA)
    agrees(rows, whitening.whitened(frame).collect())
    again = spark.createDataFrame([(7, v, "c", 1) for _, v in good] * 2 + [(None, good[3][1], None, None)], SCHEMA + ", component string, n int")
    got = whitening.whitened(again).collect()
    assert len(got) == 4 * 121 and {r["n"] for r in got} == {60} and sum(r["vec_id"] is None for r in got) == 4


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.5])] * 3])
def test_no_variance_gives_no_rows(spark, rows):
    out = whitening.whitened(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_fewer_dimensions_than_components(spark):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(40)]
    agrees(rows, whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect(), 2)
    flat = [(i, [float(i % 7), 2.0, 2.0 * (i % 7)]) for i in range(40)]  # all on one line
    got = whitening.whitened(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)


def test_sums_of_squares_beyond_half_a_long(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(a * 30_000)), float(np.float32(b * 1000))]) for i, (a, b) in enumerate(rng.uniform(-1, 1, (300, 2)))]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    agrees(rows, got, 2)
    assert max(r["deviation"] for r in got) > 1 << 61
