"""Near-duplicate embeddings by a pivot-permutation index.

Index: a bounded sample of vectors are the pivots (4 * sqrt(n) of them, those with the smallest hashes of their ids, but
none near another).
Every vector is described by its 10 nearest pivots. The inverted lists are kept by pairs of pivots, label and length, so
that two vectors meet in a list exactly if they share two pivots or more. Inside a list, shared pivots are counted, each
pair is settled in the list of its two smallest shared pivots alone, and verified by the cosine in double precision.
A list writes one row per vector (the weight of its links, the smallest vector of its local component) and never its
pairs; a long list is split into cells of two parts of bounded size.

Exact copies are one class; only classes are compared, and copies count as links. Recall against brute force is
measured in the tests; no link below the bound comes out.

Rules: vectors that are null, zero or hold null or non-finite values, and vectors without a label, link with nothing:
n_links 0, their own component. Vectors of different length link with nothing. A vec_id names one vector; rows that
repeat a row are copies. Null ids stay null and never name a component with ids. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import grid_parts, key_runs, stored
from turnstone.llm.components import components

NEAREST, CELL, ROWS_AT_ONCE = 10, 1024, 64
#: Pivots are less alike than this.
APART = 0.8
DESCRIBED = "vec_id long, label long, high long, low long, dim int, vector binary"


def _usable(values) -> bytes | None:
    if values is None or any(v is None for v in values):
        return None
    x = np.array(values, dtype=np.float64)
    return x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels = batch.column("vec_id"), batch.column("label").to_pylist()
        raw = [None if k is None else _usable(v) for k, v in zip(labels, batch.column("embedding").to_pylist(), strict=True)]
        digests = [np.frombuffer(xxhash.xxh3_128_digest(x + str(k).encode()), dtype="<i8").tolist() if x else (None, None)
                   for x, k in zip(raw, labels, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(labels, pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
             pa.array([len(x) // 8 if x else 0 for x in raw], pa.int32()), pa.array(raw, pa.binary())],
            names=["vec_id", "label", "high", "low", "dim", "vector"])


def _unit(vectors: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _listed(pivots: dict[int, np.ndarray]):
    """(node, pivots): numbers of the nearest pivots, ascending; as many as there are of the vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vectors = batch.column("dim").to_numpy(), batch.column("vector").to_pylist()
            lists: list[list[int]] = [[0, 1]] * len(vectors)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                known = pivots.get(int(dim))
                if known is not None and len(known) > NEAREST:
                    near = _unit([vectors[k] for k in own], int(dim)) @ known.T
                    top = np.sort(np.argpartition(-near, NEAREST - 1, axis=1)[:, :NEAREST], axis=1)
                    for k, row in zip(own, top.tolist(), strict=True):
                        lists[k] = row
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(lists, pa.list_(pa.int32()))], names=["node", "pivots"])

    return run


def _thinned(pivots: np.ndarray) -> np.ndarray:
    """Pivots in turn, without those near an earlier one: a dense group must not take up all places of its members' lists."""
    kept = np.zeros((0, pivots.shape[1]))
    for p in pivots:
        if not len(kept) or (kept @ p).max() < APART:
            kept = np.vstack([kept, p])
    return kept


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each one's component, of n numbered vectors with links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low), np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _linked(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["key", "i", "j"]
        for rows, starts in key_runs(batches, keys):
            node, copies, side, p, q, dims, ids_i, ids_j = (
                rows.column(k).to_numpy() for k in ("node", "copies", "side", "p", "q", "dim", "i", "j"))
            vectors = rows.column("vector").to_pylist()
            lists = rows.column("pivots").to_pylist()
            out = [], [], []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if hi - lo < 2:
                    continue
                order = lo + np.argsort(node[lo:hi], kind="stable")
                x = _unit([vectors[k] for k in order], int(dims[lo]))
                own = np.array([lists[k] for k in order])
                a, b = _pairs(x, own, side[order], int(p[lo]), int(q[lo]), ids_i[lo] == ids_j[lo], least)
                if len(a):
                    weight = np.bincount(a, weights=copies[order][b], minlength=hi - lo) + np.bincount(b, weights=copies[order][a], minlength=hi - lo)
                    root = _roots(a, b, hi - lo)
                    hit = np.flatnonzero(weight)
                    out[0].append(node[order][hit]), out[1].append(weight[hit].astype(np.int64)), out[2].append(node[order][root[hit]])
            none = np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x])) for x in out], names=["node", "links", "root"])

    return run


def _pairs(x, own, side, p: int, q: int, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of one cell that are settled here: p and q are the two smallest pivots that both share."""
    found_a, found_b = [], []
    for at in range(0, len(x), ROWS_AT_ONCE):
        a, b = np.nonzero(x[at : at + ROWS_AT_ONCE] @ x.T >= least)
        a = a + at
        keep = (a < b) & (same | (side[a] != side[b]))
        a, b = a[keep], b[keep]
        if len(a):
            shared = (own[a][:, :, None] == own[b][:, None, :]).any(axis=2)
            count = shared.sum(axis=1)
            first = shared.argmax(axis=1)
            rest = shared.copy()
            rest[np.arange(len(a)), first] = False
            second = rest.argmax(axis=1)
            here = (count >= 2) & (own[a, first] == p) & (own[a, second] == q)
            found_a.append(a[here]), found_b.append(b[here])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def near_vectors(embeddings: DataFrame, least: float = 0.93) -> DataFrame:
    """embeddings (vec_id, embedding, label) -> (vec_id, n_links, component_id, kept), one row per row."""
    source = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                               F.col("embedding").cast("array<double>").alias("embedding"))
    all_rows = stored(source.mapInArrow(_described, DESCRIBED), "vectors")
    valid = all_rows.where("vector is not null")
    by_class = valid.groupBy("high", "low").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    named = by_class.withColumn("node", F.coalesce("first", -1 - F.abs(F.shiftright("high", 1))))
    named = stored(named, "classes")
    heads = valid.join(named, ["high", "low"]).where("vec_id <=> first").dropDuplicates(["high", "low"])
    nodes = stored(heads.select("node", "copies", "label", "dim", "vector"), "nodes")
    pivots: dict[int, list[bytes]] = {}
    wanted = 4 * math.isqrt(nodes.count()) + NEAREST + 1
    for row in nodes.orderBy(F.xxhash64("node"), "node").limit(wanted).select("dim", "vector").collect():  # the bounded sample
        pivots.setdefault(row.dim, []).append(row.vector)
    known = {dim: _thinned(_unit([bytes(v) for v in vectors], dim)) for dim, vectors in pivots.items()}
    lists = stored(nodes.mapInArrow(_listed(known), "node long, pivots array<int>"), "lists")
    # every pair of a vector's pivots, ascending
    two = "flatten(transform(pivots, (p, i) -> transform(slice(pivots, i + 2, size(pivots)), q -> named_struct('p', p, 'q', q))))"
    flat = nodes.select("node", "label", "dim").join(lists, "node").select("node", "label", "dim", F.explode(F.expr(two)).alias("two"))
    keyed = flat.select("node", F.col("two.p").alias("p"), F.col("two.q").alias("q"), F.xxhash64("label", "dim", "two").alias("key"))
    keyed = stored(keyed, "keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    parts, own = grid_parts(F.col("size"), F.col("node"), CELL)
    met = keyed.join(sizes, "key").withColumn("parts", parts).withColumn("own", own)
    cells = met.select("key", "node", "p", "q", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "key", "node", "p", "q", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"))
    full = cells.join(nodes.select("node", "copies", "dim", "vector"), "node").join(lists, "node")
    spread = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = stored(spread.mapInArrow(_linked(least), "node long, links long, root long"), "links")
    found = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()).toDF("node", "component")
    totals = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = named.join(totals, "node", "left").join(found, "node", "left").select(
        "high", "low", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component"))
    names = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = joined.join(names, "component").select("high", "low", "n_links", "component_id")
    lone = all_rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = valid.select("vec_id", "high", "low").join(by_class, ["high", "low"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
