"""Product codes of integer vectors, with exact distances from limb-split matrix products.

Components become integers floor(1024 x); vectors are cut into equal parts, each with its codebook. The nearest entry of
a part minimises |c|^2 - 2 x.c, and x.c must be exact, for ties go to the lower index. Integers are split into limbs so
short that a float64 matrix product of two limbs stays below 2^53, where it is exact in any order of summation; the
products are put together in int64. Small integers are one limb: one BLAS call.

Codebooks start as the vectors with the smallest ids. A round is one pass: every task assigns its parts and adds up the
components by (part, entry); the sums of all tasks are added in Spark; the driver divides them (entries x length numbers,
whatever the table's size).

Rules: vectors that are null or empty, or hold null or non-finite components, are dropped, as are vectors whose length is
not the most frequent one (the longer of a tie), and vectors with integers so large that squared distances leave a long.
A length that is no multiple of the number of parts is cut at floor(k * length / parts). Rows that repeat an id are rows
like all others, in the order of their components; rows without an id come last in the order of ids. Fewer vectors than
entries make a smaller codebook. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import stored
from turnstone.llm.vectors import only_length, taken, usual_length

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
EXACT_BITS, LONG_BITS = 53, 63


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """x = sum(limb[k] * 2^(bits k)): all limbs but the last in 0 .. 2^bits - 1, the last keeps the sign."""
    out = []
    while np.abs(x).max(initial=0) >= 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exactly, where the products fit in int64."""
    bits = (EXACT_BITS - max(a.shape[1], 1).bit_length()) // 2
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(limbs(b, bits)):
            out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the lower one of a tie; squared distance) for each row of x."""
    score = (entries * entries).sum(axis=1) - 2 * exact_products(x, entries)
    best = score.argmin(axis=1)  # the first of equal ones
    return best, score[np.arange(len(x)), best] + (x * x).sum(axis=1)


def borders(dim: int) -> list[int]:
    return [k * dim // PARTS for k in range(PARTS + 1)]


def largest_integer(dim: int) -> int:
    """Integers up to this keep |c|^2 - 2 x.c and squared distances of a vector in a long."""
    return math.isqrt(((1 << LONG_BITS) - 1) // (4 * dim))


def _integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rows, x = only_length(column, dim)
    x = np.floor(SCALE * x)
    fits = (np.abs(x) <= largest_integer(dim)).all(axis=1)
    return rows[fits], x[fits].astype(np.int64)


def _first(source: DataFrame, dim: int) -> np.ndarray:
    """The integer vectors with the smallest ids: at most ENTRIES rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _integers(batch.column("embedding"), dim)
            yield pa.RecordBatch.from_arrays([*taken(batch, ["vec_id"], rows), pa.array(x.tolist(), pa.list_(pa.int64()))],
                                             names=["vec_id", "x"])

    kept = source.mapInArrow(run, "vec_id long, x array<long>")
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).collect()
    return np.array([r.x for r in rows], dtype=np.int64).reshape(-1, dim)


def _round(source: DataFrame, books: list[np.ndarray], cuts: list[int]) -> list[np.ndarray]:
    """One pass: parts go to their nearest entries, which become the floors of their means."""
    dim, longest = cuts[-1], max(b - a for a, b in zip(cuts, cuts[1:], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        total = [np.zeros(b.shape, dtype=np.int64) for b in books]
        for batch in batches:
            _, x = _integers(batch.column("embedding"), dim)
            for k, book in enumerate(books):
                part = x[:, cuts[k] : cuts[k + 1]]
                best, _ = nearest(part, book)
                count[k] += np.bincount(best, minlength=len(book))
                np.add.at(total[k], best, part)
        used = [(k, e) for k in range(PARTS) for e in np.flatnonzero(count[k])]
        sums = [[*total[k][e].tolist(), *[0] * (longest - total[k].shape[1])] for k, e in used]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in used], pa.int32()), pa.array([int(e) for _, e in used], pa.int32()),
             pa.array([int(count[k][e]) for k, e in used], pa.int64()), pa.array(sums, pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"])

    found = source.select("embedding").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    added = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(longest)]).alias("sums"))
    new = [b.copy() for b in books]
    for r in added.collect():  # PARTS x ENTRIES rows at most
        new[r.part][r.entry] = [s // r.n for s in r.sums[: new[r.part].shape[1]]]
    return new


def train(source: DataFrame, dim: int, rounds: int = ROUNDS) -> tuple[list[np.ndarray], list[int]]:
    """(codebooks, cuts) after the given rounds."""
    first, cuts = _first(source, dim), borders(dim)
    books = [first[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for _ in range(rounds if len(first) else 0):
        books = _round(source, books, cuts)
    return books, cuts


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """embeddings (vec_id, embedding, label) -> (vec_id, label, code, error, codebooks_sha256), a row per usable vector."""
    source = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    dim = usual_length(source)
    books, cuts = train(source, dim, rounds) if dim else ([], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if books and len(books[0]) else ():
            rows, x = _integers(batch.column("embedding"), dim)
            found = [nearest(x[:, a:b], book) for a, b, book in zip(cuts, cuts[1:], books, strict=False)]
            codes = ["".join(f"{e:02x}" for e in row) for row in zip(*(f[0].tolist() for f in found), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*taken(batch, ["vec_id", "label"], rows), pa.array(codes, pa.string()), pa.array(sum(f[1] for f in found), pa.int64())],
                names=["vec_id", "label", "code", "error"])

    coded = source.mapInArrow(run, "vec_id long, label long, code string, error long")
    return coded.withColumn("codebooks_sha256", F.lit(digest(books)))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the errors of equal labels summed, nulls together; the groups are summed before they meet rows."""
    kept = stored(coded, "codes")
    sums = kept.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    return kept.join(sums, F.col("label").eqNullSafe(F.col("l"))).drop("l")
