"""Near duplicates, line dedup, embeddings and decontamination against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from turnstone.llm.common import shingle_set, word_hashes, words_of
from turnstone.llm.components import components
from turnstone.llm.decontaminate import MASKS, SUBSTITUTIONS, WINDOW, leaks, without_leaks
from turnstone.llm.embedding_dedup import near_vectors
from turnstone.llm.line_dedup import dedup_lines
from turnstone.llm.near_dedup import keep_one, near_duplicates

LOW = {k: k + 32 for k in range(65, 91)}
SF = "/root/testdata/sf0.001"


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if w]


def shingles(text, width):
    w = words(text)
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_near(rows, width):
    """Component per row number; rows of one id are one document."""
    parent = list(range(len(rows)))
    sets = [shingles(t, width) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            both = len(sets[i] & sets[j])
            if same or both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    return [find(parent, k) for k in range(len(rows))], sets


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, edge_docs, edge_texts, width):
    roots, sets = brute_near(edge_texts, width)
    least = defaultdict(list)
    for (doc, _), root in zip(edge_texts, roots, strict=True):
        if doc is not None:
            least[root].append(doc)
    want = sorted((repr(d), len(s), repr(min(least[r]) if s and least[r] else d)) for (d, _), r, s in zip(edge_texts, roots, sets, strict=True))
    got = near_duplicates(edge_docs, width=width).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_family_and_tables(spark):
    draw = random.Random(5)
    base = [f"w{draw.randint(0, 900)}" for _ in range(150)]
    rows = []
    for k in range(160):  # variants around the bound, so that some link only through others
        own = base[:]
        for _ in range(draw.randint(0, 14)):
            own[draw.randrange(150)] = f"x{draw.randint(0, 10**6)}"
        rows.append((k, " ".join(own)))
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for table in (rows, given):
        roots, _ = brute_near(table, 4)
        want = {d: table[r][0] for (d, _), r in zip(table, roots, strict=True)}
        low = defaultdict(lambda: 10**9)
        for d, r in want.items():
            low[r] = min(low[r], d)
        got = near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), width=4).collect()
        assert {r.doc_id: r.component_id for r in got} == {d: low[r] for d, r in want.items()}


def test_keep_one_and_empty(spark, edge_docs, no_docs):
    kept = keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(None) == 2 and 1 not in ids and -3 in ids and 2 not in ids and 3 in ids and 4 in ids
    assert near_duplicates(no_docs).count() == 0 and keep_one(no_docs).count() == 0


def test_keep_one_of_repeated_and_unnamed_rows(spark):
    a, b, c = "one two three four five six seven", "red green blue black white", "north south east west up down"
    rows = [(7, a), (7, a), (9, a + " "), (None, a), (None, b), (None, b), (None, c), (3, c.upper()), (None, None), (None, ""), (5, " ")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(7, a), (None, b), (3, c.upper()), (None, None), (None, ""), (5, " ")]
    assert sorted(repr((r.doc_id, r.text)) for r in kept) == sorted(map(repr, want))


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        p, q = find(parent, a), find(parent, b)
        parent[max(p, q)] = min(p, q)
    want = {x: find(parent, x) for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows, least=1):
    order = sorted({d for d, _ in rows}, key=lambda d: (d is not None, d or 0))
    removed, earlier = defaultdict(set), []
    for doc in order:
        own = []
        for d, text in rows:
            if d == doc:
                for k, line in enumerate((text or "").split("\n")):
                    s = frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w)
                    if len(s) >= least:
                        own.append((k, s))
        for k, s in sorted(own, key=lambda x: x[0]):
            if any(at < (doc is not None, doc or 0, k) and 5 * len(s & o) >= 4 * len(s | o) for at, o in earlier):
                removed[doc].add(k)
        earlier += [((doc is not None, doc or 0, k), s) for k, s in own]
        for k, s in sorted(own, key=lambda x: x[0]):
            if any(at < (doc is not None, doc or 0, k) and 5 * len(s & o) >= 4 * len(s | o) for at, o in earlier):
                removed[doc].add(k)
    return removed


def test_line_dedup(spark, edge_docs, edge_texts, no_docs):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for docs, rows in ((edge_docs, edge_texts), (spark.createDataFrame(given, "doc_id long, text string"), given)):
        removed = brute_lines(rows)
        want = sorted((repr(d), repr(None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in removed[d]))) for d, t in rows)
        got = dedup_lines(docs)
        assert got.columns == docs.columns
        assert sorted((repr(r.doc_id), repr(r.text)) for r in got.collect()) == want
    assert dedup_lines(no_docs, count="n_gone").count() == 0


def test_line_dedup_of_short_lines(spark):
    texts = [(1, "Les.\none two\na b c"), (2, "les.\ntwo one two\na b c d"), (3, "\n \nLes.\nla la la la\nc b a"), (4, "\n \nla\none"), (None, "one")]
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for rows in (texts, given):
        got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), count="n_gone").collect()
        removed = brute_lines(rows, least=1)
        assert {r.doc_id: (r.text, r.n_gone) for r in got} == {
            d: ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in removed[d]), len(removed[d])) for d, t in rows}
    assert brute_lines(texts, least=1)[2] == {0, 1} and brute_lines(texts, least=1)[4] == {2, 3}


def test_line_dedup_plan_is_native(spark, edge_docs):
    plan = dedup_lines(edge_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_masks_find_all_allowed_alignments():
    from itertools import combinations

    for size, allowed in [(WINDOW, SUBSTITUTIONS)] + [(n, n * SUBSTITUTIONS // WINDOW) for n in range(8, WINDOW)]:
        for wrong in combinations(range(size), allowed):
            assert any(all(at + m not in wrong for m in mask) for mask in MASKS for at in range(size - mask[-1]))


def brute_leaks(docs, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW)) if w]
    found = set()
    for doc, text in docs:
        d = split(text)
        for item, it in items:
            b = split(it)
            if len(b) < 8:
                continue
            size = min(len(b), 13)
            allowed = 2 if len(b) >= 13 else len(b) * 2 // 13
            for shift in range(-len(b) + size, len(d) - size + 1):
                if any(sum(d[shift + j + u] == b[j + u] for u in range(size)) >= size - allowed
                       for j in range(max(0, -shift), min(len(b), len(d) - shift) - size + 1)):
                    found.add((doc, item, shift))
    return {(d, i) for d, i, _ in found}


def test_leaks(spark, edge_docs, no_docs):
    draw = random.Random(9)
    word = lambda: f"v{draw.randint(0, 60)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([30, 14, 13, 12, 9, 8, 7, 3])] + [(None, "Null id: but nine words, all of them, here."), (20, None), (21, "")]
    docs = [(1, "")]
    for k in range(60):
        item = items[k % 8][1].split()
        for _ in range(draw.randint(0, 3)):
            item[draw.randrange(len(item))] = "zz"
        docs.append((k + 2, " ".join([word() for _ in range(draw.randint(0, 20))] + item + [word() for _ in range(draw.randint(0, 9))])))
    docs += [(None, items[0][1].upper().replace(" ", ", ")), (90, None), (2, docs[1][1])]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    assert len(want) > 20
    assert {(r.doc_id, r.item_id) for r in leaks(frame, bench).collect()} == want
    left = without_leaks(frame, bench).collect()
    gone = {d for d, _ in want}
    assert sorted(repr(r.doc_id) for r in left) == sorted(repr(d) for d, _ in docs if d not in gone)
    assert leaks(no_docs, bench).count() == 0 and leaks(frame, bench.limit(0)).count() == 0
    assert without_leaks(edge_docs, bench).columns == edge_docs.columns
    plan = without_leaks(frame, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_near_vectors(spark):
    draw = np.random.default_rng(4)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(60):
            center = draw.normal(size=16)
            for _ in range(int(draw.integers(1, 6))):
                rows.append((k, (center + draw.normal(size=16) * 0.12).tolist(), label))
                k += 1
    hub = draw.normal(size=16)
    rows += [(k + j, (hub + draw.normal(size=16) * 0.1).tolist(), 1) for j in range(300)]
    k += 300
    rows += [(k, rows[0][1], 0), (k + 1, [x * 4 for x in rows[0][1]], 0), (k + 2, None, 0), (k + 3, [0.0] * 16, 0), (k + 4, [float("nan")] * 16, 0),
             (k + 5, [1.0, None] * 8, 0), (k + 6, [1.0, 2.0], 0), (k + 7, [2.0, 4.0], 0), (k + 8, [], 0), (None, rows[0][1], 0), (5, rows[5][1], rows[5][2])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows)
    parent, links = {}, defaultdict(int)
    good = [(j, np.array(v, float)) for j, (_, v, y) in enumerate(rows) if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    parent = {j: j for j in range(len(rows))}
    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and rows[i][2] == rows[j][2] and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[i] += 1
                links[j] += 1
                p, q = find(parent, i), find(parent, j)
                parent[max(p, q)] = min(p, q)
    want = defaultdict(list)
    for j, (v, _, _) in enumerate(rows):
        want[find(parent, j)].append(v)
    low = {r: min((v for v in vs if v is not None), default=None) for r, vs in want.items()}
    expected = {v: (links[j], low[find(parent, j)]) for j, (v, _, _) in enumerate(rows) if v is not None}
    found = {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None}
    assert sum(n for n, _ in found.values()) >= 0.9 * sum(n for n, _ in expected.values())
    assert all(found[v][0] <= expected[v][0] for v in found)
    assert sum(found[v][1] == expected[v][1] for v in found) >= 0.97 * len(found)
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_shingles():
    for text, n in (("a b c d e", 2), ("a b", 1), ("", 0), ("a a a a a a a", 1)):
        assert len(shingle_set(word_hashes(words_of(text)), 4)) == n
