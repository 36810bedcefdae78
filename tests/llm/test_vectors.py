"""Whitening and product codes against numpy and plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnstone.llm.queries import op11_whitening, op12_vector_codes
from turnstone.llm.vector_codes import compress, exact_products, nearest, with_label_errors
from turnstone.llm.whitening import fit, solved, whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, n int, code string, dim int, i int, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, 1, "x", 2, 3, "y") for i, v, k in rows], SCHEMA)


def usable(rows):
    return [(i, v, k) for i, v, k in rows if v and all(x is not None and math.isfinite(x) for x in v)]


def edge_rows(n=90, dim=8, seed=5):
    draw = random.Random(seed)
    rows = [(k, [draw.gauss(0, 1 + d) for d in range(dim)], draw.choice([1, 2, None])) for k in range(n)]
    rows += [(7, rows[7 % n][1], 1), (None, rows[3 % n][1], None), (200, None, 1), (201, [], 1), (202, [None] * dim, 1),
             (203, [math.nan] + [0.0] * (dim - 1), 2), (204, [math.inf] * dim, 2), (205, [0.0] * dim, 2), (206, [1.0] * (dim + 1), 1),
             (-4, [-0.001] * dim, None)]
    return rows


def brute_whitening(vectors, most=32):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    a = (x * n - sums) / n
    e, v = np.linalg.eigh(a.T @ a / n)
    e, v = e[::-1], v[:, ::-1]
    kept = min(most, int((e > e[0] * 1e-12).sum()))
    return n, deviation, a @ v[:, :kept] / np.sqrt(e[:kept]), e[:kept] / e.sum()


def compare_whitening(got, ids, vectors, most=32):
    n, deviation, white, explained = brute_whitening(vectors, most)
    kept = white.shape[1]
    assert len(got) == len(ids) * kept and {r.n for r in got} == {n}
    by = {(r.vec_id, r.deviation): {} for r in got}
    for r in got:
        by[r.vec_id, r.deviation][r.component] = r
    want = {(i, d): w for i, d, w in zip(ids, deviation, white, strict=True)}
    assert by.keys() == want.keys()
    sign = None
    for key, w in want.items():
        assert sorted(by[key]) == list(range(1, kept + 1))
        row = np.array([by[key][c].whitened for c in range(1, kept + 1)])
        sign = np.sign(row * w) if sign is None else sign
        # components with close variances are told apart less exactly
        assert np.allclose(row, np.where(sign == 0, 1, sign) * w, atol=1e-6)
        assert np.allclose([by[key][c].explained for c in range(1, kept + 1)], explained, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_edges(spark):
    rows = edge_rows()
    kept = [(i, v) for i, v, _ in usable(rows) if len(v) == 8]
    compare_whitening(whiten(frame(spark, rows).repartition(3)).collect(), [i for i, _ in kept], [v for _, v in kept])
    assert whiten(frame(spark, rows), most=3).agg(F.max("component")).first()[0] == 3


def test_whitening_without_variance(spark):
    for rows in ([], [(1, [0.5, 0.5], 1)], [(k, [1.0, 2.0], 1) for k in range(5)], [(1, None, 1), (2, [], None)]):
        assert whiten(frame(spark, rows)).collect() == []


def test_whitening_dependent_and_ill_conditioned(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(400, 3)) * [1e6, 1.0, 1e3]
    tiny = draw.integers(0, 2, size=400) / 64
    rows = [(k, [float(x) for x in (*b, b[0] + b[1], 5.0, b[0] + t)], 1) for k, (b, t) in enumerate(zip(np.floor(base * 64) / 64, tiny, strict=True))]
    model = fit(frame(spark, rows).repartition(4))
    # one column depends on others and one is constant; the one that differs by 1 / 64 in some rows still counts
    assert len(model.variances) == 4 and model.variances[-1] < 1e-13 * model.variances[0]
    white = model.whitened(np.floor(64 * np.array([v for _, v, _ in rows])).astype(np.int64))
    assert np.abs(white.T @ white / len(rows) - np.eye(4)).max() < 1e-4


def test_triangular_solve():
    draw = np.random.default_rng(1)
    a, r = draw.normal(size=(20, 6)), np.triu(draw.normal(size=(6, 6))) + 4 * np.eye(6)
    assert np.allclose(solved(a, [r, r]), a @ np.linalg.inv(r) @ np.linalg.inv(r))


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    kept = usable(rows)
    got = op11_whitening(spark, SF).collect()
    n, deviation, white, explained = brute_whitening([v for _, v, _ in kept])
    assert len(got) == 32 * len(kept) and {(r.vec_id, r.deviation) for r in got} == {(i, d) for (i, _, _), d in zip(kept, deviation, strict=True)}
    whitened = np.array([[r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component)) if r.component == c] for c in (1, 2, 32)])
    order = np.argsort([i for i, _, _ in kept], kind="stable")
    for w, c in zip(whitened, (1, 2, 32), strict=True):
        assert np.allclose(np.abs(w), np.abs(white[order, c - 1]), atol=1e-6)
    assert np.allclose([r.explained for r in got], explained[[r.component - 1 for r in got]], rtol=1e-9)
    assert got[0].identity_error < 1e-9


def brute_codes(rows, dim, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], k) for i, v, k in usable(rows) if len(v) == dim]
    cuts = [k * dim // 4 for k in range(5)]
    first = [v for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]]
    books = [[v[a:b] for v in first] for a, b in zip(cuts, cuts[1:], strict=False)]

    def near(part, book):
        return min(((sum((x - c) ** 2 for x, c in zip(part, entry, strict=True)), e) for e, entry in enumerate(book)))

    for _ in range(rounds):
        for k, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                part = v[cuts[k] : cuts[k + 1]]
                groups.setdefault(near(part, book)[1], []).append(part)
            for e, parts in groups.items():
                book[e] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
    out = []
    for i, v, label in kept:
        found = [near(v[a:b], book) for a, b, book in zip(cuts, cuts[1:], books, strict=False)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    totals = {}
    for _, label, _, error in out:
        totals[label] = totals.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted((repr(i), code, error, totals[label], sha) for i, label, code, error in out)


@pytest.mark.parametrize(("n", "dim"), [(90, 8), (300, 6), (3, 4), (2, 3)])
def test_codes_edges(spark, n, dim):
    rows = edge_rows(n, dim)
    if n > 3:  # ties: equal distances to two entries
        rows += [(300 + k, [float(k % 3)] * dim, 1) for k in range(12)]
    got = with_label_errors(compress(frame(spark, rows).repartition(3))).collect()
    want = brute_codes(rows, dim)
    assert sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == want


def test_codes_of_nothing(spark):
    for rows in ([], [(1, None, 1), (2, [], None), (3, [math.nan], 1)]):
        assert with_label_errors(compress(frame(spark, rows))).collect() == []


def test_codes_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(120).collect()]
    got = with_label_errors(compress(frame(spark, rows))).collect()
    assert sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute_codes(rows, 64)
    assert op12_vector_codes(spark, SF).count() == 500


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(0, 27), st.integers(0, 27), st.randoms(use_true_random=False))
def test_limb_products_are_exact(dim, bits_a, bits_b, draw):
    a = np.array([[draw.randint(-(1 << bits_a), 1 << bits_a) for _ in range(dim)] for _ in range(3)], dtype=np.int64)
    b = np.array([[draw.randint(-(1 << bits_b), 1 << bits_b) for _ in range(dim)] for _ in range(4)], dtype=np.int64)
    want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    assert exact_products(a, b).tolist() == want


def test_first_of_equal_entries():
    best, d = nearest(np.array([[1 << 26, 0]]), np.array([[0, 0], [(1 << 26) + 1, 0], [(1 << 26) - 1, 0]]))
    assert best.tolist() == [1] and d.tolist() == [1]
