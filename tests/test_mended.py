"""Cases of the second round: deep payloads, labels cut by position, white space before a cut."""

import json
import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from turnstone.functions.text import truncate
from turnstone.operators import matching
from turnstone.operators.layout import line_ids
from turnstone.operators.matching import contained_names
from turnstone.operators.payload import leaves, nesting

SMALL = "/root/testdata/sf0.001"


def test_payload_of_any_depth(spark):
    deep, width = "end", 20
    for k in reversed(range(width)):
        deep = {f"k{k}": deep} if k % 3 else [deep, {"side": k}]
    rows = [(1, json.dumps({"a": deep, "text": "brackets [[[{{ and \" quotes"})), (2, None), (3, "{}"), (4, "plain"), (5, json.dumps({"x" * 10_500: 1, "b": 2}))]
    docs = spark.createDataFrame(rows, "doc_id long, data string")
    depths = {r.doc_id: r.d for r in docs.select("doc_id", nesting(F.col("data")).alias("d")).collect()}
    assert {k: v for k, v in depths.items() if k > 1} == {2: 0, 3: 1, 4: 0, 5: 1} and depths[1] >= width
    found = [(r.doc_id, r.path, r.value) for r in leaves(docs).collect()]
    assert ("end" in {v for _, _, v in found}) and sum(d == 1 for d, _, _ in found) == 2 + sum(k % 3 == 0 for k in range(width))
    assert not any(v.startswith(("{", "[")) for d, _, v in found if d == 1)
    order = [r.value for r in leaves(docs).where("doc_id = 5").orderBy("sort").collect()]
    assert order == ["2", "1"]


def test_truncate_drops_all_white_space(spark):
    text = spark.createDataFrame([("ab \t cdef",)], "t string")
    assert text.select(truncate(F.col("t"), 5, "+").alias("x")).first().x == "ab+"


def _joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(Broadcast\w*Join|SortMergeJoin) \[.*?(Inner|LeftOuter|LeftSemi|LeftAnti)", plan)


@pytest.mark.parametrize("key", ["doc_qa_lookup", "doc_qa_normalize"])
def test_answers_gather_nothing_on_the_driver(spark, key):
    assert {kind for kind, _ in _joins(queries()[key](spark, SMALL))} == {"SortMergeJoin"}


def test_review_boxes_gather_documents_only(spark):
    found = _joins(queries()["doc_review_bbox_merge"](spark, SMALL))
    assert found and {how for kind, how in found if kind != "SortMergeJoin"} <= {"LeftSemi"}


@pytest.mark.parametrize("key", ["win_table_rows", "win_column_ranges"])
def test_columns_gather_nothing_on_the_driver(spark, key):
    assert {kind for kind, _ in _joins(queries()[key](spark, SMALL))} == {"SortMergeJoin"}


def test_clusters_need_no_join(spark):
    assert _joins(queries()["win_cluster_y_mean"](spark, SMALL)) == []


def test_field_to_line_moves_every_line_once(spark):
    plan = queries()["jn_field_to_line"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "BroadcastHashJoin" not in plan


def test_line_ids_share_a_first_place(spark):
    rows = [(1, 1, 5, "a", 1, 0, 0), (1, 1, 5, "b", 1, 0, 1), (1, 1, 9, "c", 1, 0, 2)]
    found = line_ids(spark.createDataFrame(rows, "doc_id long, page int, seq int, text string, block_num int, par_num int, line_num int"))
    assert {r.text: r.line_id for r in found.collect()} == {"a": 1, "b": 1, "c": 2}


@pytest.mark.parametrize("key", ["win_line_ids", "win_line_offset"])
def test_lines_gather_nothing_on_the_driver(spark, key):
    assert {kind for kind, _ in _joins(queries()[key](spark, SMALL))} == {"SortMergeJoin"}


def test_names_of_any_length(spark):
    names = ["Al", "Customer#000000017", "Customer#000000018", "Customer#0000000", "x" * 700, "Sales", "Unseen name"]
    texts = {1: "ou est customer#000000018 ?", 2: "al et sales", 3: "x" * 701, 4: "customer#00000001", 5: "", 6: "rien"}
    found = contained_names(spark.createDataFrame(list(texts.items()), "k long, norm string"), spark.createDataFrame([(n,) for n in names], "name string"), "k")
    assert {r.k: r.name for r in found.collect()} == {1: "Customer#000000018", 2: "Sales", 3: "x" * 700, 4: "Customer#0000000"}
    nothing = contained_names(spark.createDataFrame([(1, "a")], "k long, norm string"), spark.createDataFrame([], "name string"), "k")
    assert nothing.collect() == []


@pytest.mark.parametrize("few", [0, 10_000])
def test_a_text_meets_few_names(spark, monkeypatch, few):
    monkeypatch.setattr(matching, "FEW_NAMES", few)
    names = spark.range(3000).select(F.format_string("Customer#%09d", "id").alias("name"))
    texts = spark.range(3000).select("id", F.format_string("qui est customer#%09d ?", "id").alias("norm"))
    found = contained_names(texts, names, "id")
    assert found.filter(F.col("name") == F.format_string("Customer#%09d", "id")).count() == 3000
    plan = found._jdf.queryExecution().executedPlan()
    assert ("BroadcastHashJoin" in plan.toString()) == (few > 0)


def test_documents_are_routed_once(spark):
    plan = queries()["src_documents"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "routed-" in plan


def test_anchors_fold_a_line_once(spark):
    plan = queries()["fn_looks_like_anchor"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("com.ibm.icu.text.Normalizer") <= 3
