"""Whitening components of embeddings by shifted CholeskyQR.

Each entry c becomes the integer x = floor(64 * c) + 1000000. A pass over the table gives n and the exact sums S. The
centred rows A = x - S / n are then made orthonormal in place of being written: a pass solves the triangular systems of
all factors found so far, row by row, and adds up the Gram matrix; its Cholesky factor joins the list. While the Gram
matrix is far from well conditioned its diagonal is shifted, so that the factor exists; each pass mends what the shift
left. Passes end when all eigenvalues of the Gram matrix are 1, or 0 in directions without variance; its symmetric root
is the last factor. With A = Q R, R the product of the factors, the SVD of R gives the components, the variances
(squared singular values over n) and, with Q, the whitened rows. A last pass measures the covariance of what is
returned.

Only Gram matrices (dim x dim) reach the driver, and only factors and means go back. Every pass reads the table anew:
store the frame first where it is dear to compute.

Rules: vectors that are null or empty, or hold null or non-finite entries, are dropped, as are vectors whose length is
not the most frequent one (the longer of a tie) and vectors with integers of 2^62 and more. Rows without an id or with a repeated one are rows like all others.
Components without variance can't be whitened and don't come out: equal vectors, or a single one, give no rows, nor does
an empty table. `deviation` is null where it exceeds a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.vectors import only_length, taken, usual_length

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Passes at most; eigenvalues of a finished Gram matrix are this close to 1, or this small.
PASSES, FINISHED, NONE = 10, 1e-11, 1e-13
EPS = np.finfo(np.float64).eps
LONG, LARGEST = 2**63 - 1, 2.0**62


def _scaled(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, floor(64 c) as int64) of the usable vectors of a batch."""
    rows, c = only_length(column, dim)
    with np.errstate(over="ignore"):
        low = np.floor(SCALE * c)
    fits = (np.abs(low) < LARGEST).all(axis=1)
    return rows[fits], low[fits].astype(np.int64)


def _summed(parts: DataFrame) -> dict[tuple[int, int], float]:
    """parts (i, v array) -> sums over all tasks by (i, position): as many rows as the matrix has entries."""
    flat = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r.i, r.j): r.v for r in flat.collect()}


def moments(embeddings: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(n, S): the number of usable vectors and the exact sums of their integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            _, low = _scaled(batch.column(0), dim)
            n += len(low)
            if int(np.abs(low).max(initial=0)) * len(low) <= LONG:
                total = [a + int(b) for a, b in zip(total, low.sum(axis=0), strict=True)]
            else:
                total = [a + sum(map(int, c)) for a, c in zip(total, low.T, strict=True)]
        sums = pa.array([[n, *total]], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), sums], names=["i", "v"])

    found = _summed(embeddings.select("embedding").mapInArrow(run, "i int, v array<decimal(38,0)>"))
    n = int(found.get((0, 0), 0))
    return n, [int(found[0, j + 1]) + OFFSET * n for j in range(dim)] if n else []


@dataclass
class Centre:
    """The mean S / n as an integer and a fraction below 1, so that centring rounds once."""

    n: int
    sums: list[int]
    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        whole = [s // n for s in sums]
        return cls(n, sums, np.array(whole, dtype=np.int64), np.array([(s - n * w) / n for s, w in zip(sums, whole, strict=True)]))

    def centred(self, low: np.ndarray) -> np.ndarray:
        return ((low + OFFSET) - self.whole).astype(np.float64) - self.rest


def solved(a: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """A R1^-1 R2^-1 ... by forward substitution over the columns, all rows at once."""
    for r in factors:
        q = np.empty_like(a)
        for j in range(a.shape[1]):
            q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        a = q
    return a


def gram(embeddings: DataFrame, centre: Centre, factors: list[np.ndarray], last: np.ndarray | None = None) -> np.ndarray:
    """Gram matrix of the centred rows behind the factors (and a last matrix): one pass."""
    dim = len(centre.rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            _, low = _scaled(batch.column(0), dim)
            q = solved(centre.centred(low), factors)
            q = q if last is None else q @ last
            total = total + q.T @ q
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    found = _summed(embeddings.select("embedding").mapInArrow(run, "i int, v array<double>"))
    size = dim if last is None else last.shape[1]
    out = np.zeros((size, size))
    for (i, j), v in found.items():
        out[i, j] = v
    return (out + out.T) / 2


def _factor(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor of the shifted matrix; rounding below zero raises the shift."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(100 * shift, EPS * np.trace(g))


@dataclass
class Whitening:
    """Components (rows) with their variances and share of the trace, and the maps that whiten centred rows."""

    centre: Centre
    factors: list[np.ndarray]
    last: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def whitened(self, low: np.ndarray) -> np.ndarray:
        return solved(self.centre.centred(low), self.factors) @ self.last


def fit(embeddings: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The leading components with variance, by shifted CholeskyQR; None where there is no variance."""
    dim = usual_length(embeddings)
    n, sums = moments(embeddings, dim) if dim else (0, [])
    if not n:
        return None
    centre = Centre.of(n, sums)
    factors: list[np.ndarray] = []
    g = gram(embeddings, centre, factors)
    trace = float(np.trace(g))
    if trace == 0:
        return None
    g, unit = g / trace, np.sqrt(trace)
    factors.append(np.eye(dim) * unit)
    for _ in range(PASSES):
        values, axes = np.linalg.eigh(g)
        if ((np.abs(values - 1) < FINISHED) | (np.abs(values) < NONE)).all() and values[-1] > 0.5:
            break
        # the shift that bounds the rounding of a Gram matrix of n rows
        shift = 0.0 if values[0] > 0.1 * values[-1] else 11 * dim * (np.sqrt(n) + dim) * EPS * values[-1]
        factors.append(_factor(g, shift))
        g = gram(embeddings, centre, factors)
    values, axes = np.linalg.eigh(g)
    root = np.sqrt(np.maximum(values, 0))
    r = np.eye(dim)
    for f in factors:
        r = f @ r
    # A'A = R'GR: the SVD of root(G) R holds the components, and Q behind its left vectors the whitened rows
    left, sizes, right = np.linalg.svd((root[:, None] * axes.T) @ r)
    kept = min(most, int((sizes > sizes[0] * dim * EPS).sum()))
    sign = np.sign(right[np.arange(kept), np.abs(right[:kept]).argmax(axis=1)])
    inverse = np.divide(1.0, root, out=np.zeros_like(root), where=root > np.sqrt(NONE))
    last = (axes * inverse) @ left[:, :kept] * sign * np.sqrt(n)
    return Whitening(centre, factors, last, right[:kept] * sign[:, None], sizes[:kept] ** 2 / n, sizes[:kept] ** 2 / (sizes**2).sum())


def _deviation(low: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum((n x - S)^2) exactly; in 64 bits where that is known to hold it, in Python's integers elsewhere."""
    shifted = [s - OFFSET * n for s in sums]
    largest = int(np.abs(low).max(initial=0)) * n + max(map(abs, shifted))
    if largest * largest * low.shape[1] <= LONG:
        d = n * low.astype(np.int64) - np.array(shifted, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, shifted, strict=True)) for row in low]
    return [d if d <= LONG else None for d in exact]


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """embeddings (vec_id, embedding) -> (vec_id, component, n, deviation, whitened, explained, identity_error), one row per
    usable vector and component, numbered from 1."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(embeddings, most)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    dim, n = len(model.centre.rest), model.centre.n
    measured = gram(embeddings, model.centre, model.factors, model.last) / n
    error = float(np.abs(measured - np.eye(len(measured))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, low = _scaled(batch.column("embedding"), dim)
            values = pa.array(model.whitened(low).reshape(-1))
            ends = pa.array(np.arange(len(low) + 1) * len(model.variances), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*taken(batch, ["vec_id"], rows), pa.array(_deviation(low, n, model.centre.sums), pa.int64()), pa.ListArray.from_arrays(ends, values)],
                names=["vec_id", "deviation", "whitened"])

    source = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    wide = source.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")
    share = F.array(*[F.lit(float(v)) for v in model.explained])
    return wide.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
