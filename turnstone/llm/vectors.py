"""Vectors of Arrow batches as matrices, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix in double) for each length of vector in a list column; only rows whose entries are all
    finite. Null and empty vectors and vectors with null, infinite or NaN entries are in none."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        entries = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        x = entries.astype(np.float64, copy=False).reshape(-1, dim)  # a null entry becomes NaN
        fine = np.isfinite(x).all(axis=1)
        if fine.any():
            yield rows[fine], x[fine]


def only_length(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the usable vectors of one length."""
    for rows, x in matrices(column):
        if x.shape[1] == dim:
            return rows, x
    return np.zeros(0, dtype=np.int64), np.zeros((0, dim))


def taken(batch: pa.RecordBatch, names: list[str], rows: np.ndarray) -> list[pa.Array]:
    at = pa.array(rows)
    return [batch.column(n).take(at) for n in names]


def usual_length(embeddings: DataFrame) -> int:
    """The most frequent length among usable vectors (the longer one of a tie); 0 where there is none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(x.shape[1], len(x)) for _, x in matrices(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int64())],
                                             names=["dim", "n"])

    sizes = embeddings.select("embedding").mapInArrow(count, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    return top[0].dim if top else 0
