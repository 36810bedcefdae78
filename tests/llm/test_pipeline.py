"""Each stage of the corpus pipeline against a brute-force version of it, on the stage's own input."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_dedup import brute_leaks, brute_lines, brute_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    """(name, rows before, rows after) of all stages."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == before.columns
        out.append((name, before.collect(), docs.collect()))
    return {name: (a, b) for name, a, b in out}


def test_quality_stage(spark, staged):
    before, after = staged["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    wrong = [d for d in labels if (labels[d] == 0) != (d in gone)]
    assert len(wrong) <= 0.05 * len(labels)


def test_line_stage(staged):
    before, after = staged["line_dedup"]
    removed = brute_lines([(r.doc_id, r.text) for r in before])
    want = {r.doc_id: "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in removed[r.doc_id]) for r in before}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)


def test_line_stage_of_short_lines(spark):
    rows = [(1, "Les.\none two", 12), (2, "les.\n\ntwo one two", 18)]
    after = corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars int"), SF).collect()
    assert {(r.doc_id, r.text, r.n_chars) for r in after} == {(1, "Les.\none two", 12), (2, "", 0)}


def test_near_stage(staged):
    before, after = staged["near_dedup"]
    roots, _ = brute_near([(r.doc_id, r.text) for r in before], 5)
    groups = {}
    for r, root in zip(before, roots, strict=True):
        groups.setdefault(root, []).append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(min(g) for g in groups.values())


def test_leak_stage(spark, staged):
    before, after = staged["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {d for d, _ in brute_leaks([(r.doc_id, r.text) for r in before], items)}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - gone


def test_packing_stage(staged):
    before, after = staged["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    total = Counter()
    for r in after:
        total[r.doc_id] += r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in after)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_entry_without_the_subpackage(monkeypatch):
    import importlib.util

    import __spark_entry__

    find = importlib.util.find_spec
    assert "pipeline" in __spark_entry__.queries()
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "turnstone.llm" else find(name, *a))
    assert "pipeline" not in __spark_entry__.queries() and not any(k.startswith("op") for k in __spark_entry__.oracle_sql())
