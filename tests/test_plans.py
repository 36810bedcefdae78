"""Promises on plans: no cross join, filters at the scan, no Python where it is not named."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import compare, connect

SMALL = "/root/testdata/sf0.001"
QUICK = ("q_present_on", "q_absent_on", "win_multi_scans", "fn_normalize_plate", "jn_directory_merge", "doc_invoice_items",
         "jn_field_to_line", "fn_flatten_json", "agg_batch_summary", "sql_audit", "st_sessions", "flt_generated_on")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    assert entry(spark).columns[:2] == ["id", "plate_number"]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 200


@pytest.mark.parametrize("key", ["q_present_on", "q_stats_snapshot", "jn_right_of_label", "jn_nearest_asset", "jn_fuzzy_reference", "nlq_entities"])
def test_no_cross_join(spark, key):
    text = plan(queries()[key](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("key", ["win_pair_sessions", "doc_route", "doc_extract_fields", "q_present_on"])
def test_no_python_in_plan(spark, key):
    text = plan(queries()[key](spark, SMALL))
    assert "Python" not in text and "Pandas" not in text


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    employees = plan(queries()["src_employees"](spark, SMALL))
    assert "LessThan(c_acctbal,9000.0)" in employees and "c_nationkey" not in employees
    history = plan(queries()["flt_generated_on"](spark, SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in history


@pytest.mark.parametrize("key", QUICK)
def test_quick_oracles(spark, key):
    state, rows, detail = compare(spark, connect(SMALL), key, SMALL)
    assert state == "ok", detail
