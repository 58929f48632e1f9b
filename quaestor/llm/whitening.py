"""Whitening of embeddings: leading components by matrix-free block subspace iteration, one Spark pass a step.

The fit list holds each distinct integer vector once, as a table in the shared folder. A pass sends the block Q (dimensions
x columns) to the tasks, each centres its rows X and adds up X^T (X Q) over them; the sums of the tasks meet in an
aggregate by cell. The d x d covariance is never formed. Rayleigh-Ritz on the block gives values and components, QR the
next block, until |V q - e q| of all wanted components is at most RESIDUAL of the greatest value; residuals come from the
same pass. The block has WIDTH columns a component, at most one for each dimension: one as wide as the vectors settles at
the first pass, narrower ones take as many as the spectrum asks for (see README).

Only a block, a sum for each dimension and counts reach the driver, whatever the number of rows.

Rows with a null vector or with null or non-finite entries are dropped, and so are vectors of another length than the
commonest (ties: the greatest). A null vec_id stays; repeated rows are each whitened and count once in the fit. Entries beyond
2^63 / 256 are held at the ends of long. Directions without variance are no components: one vector alone, or an empty
table, gives no rows. Equal eigenvalues leave a choice of components; it is the same for all rows. `deviation` is exact
modulo 2^64, so exact wherever a long can hold it. Other columns of the input are passed over, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import cut

WIDTH, RESIDUAL, FLOOR, PASSES = 16, 1e-12, 1e-13, 2000
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, x: the vectors whose entries are all finite, each entry c as floor(256 c)."""
    entries = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("_e")).where("_e is not null")
    sound = F.forall("_e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(sound).select("vec_id", F.transform("_e", lambda c: F.floor(F.lit(256.0) * c) + F.lit(0).cast("long")).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as rows; all have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def shared_table(df: DataFrame) -> DataFrame:
    """df as a table in the folder that all executors share."""
    spark = df.sparkSession
    cut(spark.range(0))  # sets the folder where the cluster names none
    path = f"{spark.sparkContext.getCheckpointDir()}/fit-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def totals(fit: DataFrame, width: int, part) -> np.ndarray:
    """The sum over tasks of part(rows X) -> array (d, width), as doubles, by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                own = part(matrix(batch.column(0)))
                total = own if total is None else total + own
        if total is not None:
            flat = np.ascontiguousarray(total, dtype=float).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["cell", "value"])

    cells = fit.select("x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # d x width rows
    out = np.zeros(len(cells))
    for r in cells:
        out[r["cell"]] = r["value"]
    return out.reshape(-1, width)


@dataclass(frozen=True)
class Fit:
    """n distinct vectors with exact sums by dimension; values and components (columns) by falling value; the trace; passes made."""

    n: int
    sums: tuple
    values: np.ndarray
    components: np.ndarray
    trace: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def block_pass(fit: DataFrame, mean: np.ndarray, block: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """(V block, trace of V) from one reading of the centred rows."""

    def part(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return np.column_stack([centred.T @ (centred @ block), np.einsum("ij,ij->j", centred, centred)])

    both = totals(fit, block.shape[1] + 1, part) / n
    return both[:, :-1], float(both[:, -1].sum())


def fitted(fit: DataFrame, components: int = 4, width: int = WIDTH) -> Fit | None:
    """The leading components of a table of distinct vectors x of one length; None if it is empty or has no dimension."""
    sizes = fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).collect()  # one row
    if not sizes or not sizes[0]["d"]:
        return None
    d, n = sizes[0]["d"], sizes[0]["n"]
    sums = tuple(r["s"] for r in fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(28,0)")).alias("s")).orderBy("pos").collect())
    sums = tuple(int(s) for s in sums)
    mean = np.array([s / n for s in sums])
    columns = min(d, max(components * width, components))
    block = np.linalg.qr(np.random.default_rng(0).standard_normal((d, columns)))[0]
    wanted = min(components, d)
    for passes in range(1, PASSES + 1):
        image, trace = block_pass(fit, mean, block, n)
        if trace <= 0:
            return Fit(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0, passes)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = block @ turn, image @ turn
        residuals = np.linalg.norm(image - ritz * values, axis=0)[:wanted]
        if (residuals <= RESIDUAL * values[0]).all():
            real = values[:wanted] > FLOOR * trace
            return Fit(n, sums, values[:wanted][real], ritz[:, :wanted][:, real], trace, passes)
        block = np.linalg.qr(image)[0]
    raise RuntimeError(f"residuals {residuals.tolist()} after {PASSES} passes; a wider block needs fewer")


def identity_error(fit: DataFrame, found: Fit) -> float:
    """The largest absolute entry of the covariance of the whitened fit list, centred anew, minus the identity."""
    mean, scaled = found.mean, found.components / np.sqrt(found.values)
    k = len(found.values)
    middle = totals(fit, 1, lambda x: ((x - mean) @ scaled).sum(axis=0)[:, None])[:, 0] / found.n

    def part(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ scaled - middle
        return w.T @ w

    return float(np.abs(totals(fit, k, part) / found.n - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = 4, width: int = WIDTH) -> DataFrame:
    """OUT: for each sound row and component its whitened value, with its share of the variance; see the module."""
    rows = integers(vectors)
    every = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if every is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    rows = rows.where(F.size("x") == every["d"])
    fit = shared_table(rows.select("x").distinct())
    found = fitted(fit, components, width)
    if found is None or not len(found.values):
        return vectors.sparkSession.createDataFrame([], OUT)
    n, k, mean = found.n, len(found.values), found.mean
    scaled, shares, error = found.components / np.sqrt(found.values), found.values / found.trace, identity_error(fit, found)
    sums = np.array([s % (1 << 64) for s in found.sums], dtype=np.uint64).astype(np.int64)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = len(batch)
            if not m:
                continue
            x = matrix(batch.column(1))
            off = x * np.int64(n) - sums  # wraps, and the sum of squares wraps back
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, dtype=np.int64)), pa.array(np.repeat((off * off).sum(axis=1), k)), pa.array(((x - mean) @ scaled).ravel()),
                pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])

    return rows.mapInArrow(project, OUT)
