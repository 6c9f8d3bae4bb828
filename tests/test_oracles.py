"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from tallyloom.plans.catalog import REGISTRY
from tallyloom.plans.oracles import ORACLES
from tests.oracle_check import compare, connect

ROWS_ONLY = {"input_size", "input_files", "rf_search", "rf_anneal", "rf_learning_curve"}


@pytest.fixture(scope="module")
def connection(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, connection, name):
    assert compare(REGISTRY[name](spark, data), connection, ORACLES[name]) == []


def test_only_file_and_forest_queries_lack_sql():
    assert set(REGISTRY) - set(ORACLES) == ROWS_ONLY
    assert set(REGISTRY) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_file_queries_list_what_is_there(spark, data):
    import os

    files = {n: os.path.getsize(os.path.join(data, n)) for n in os.listdir(data) if n.endswith(".parquet")}
    listed = REGISTRY["input_files"](spark, data).collect()
    assert [os.path.basename(r.source_file) for r in listed] == sorted(files)
    assert tuple(REGISTRY["input_size"](spark, data).first()) == (len(files), sum(files.values()))


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["word", "n"] and not frame.isEmpty()


SIZED = [
    "wc_words", "runs_enriched", "runs_numbered", "run_stats", "log_stats", "agg_rows", "speedup_top20", "dummy_metrics",
    "metrics_wide", "best_so_far", "eventlog_rollup", "resource_competition",
]


@pytest.mark.parametrize("name", SIZED)
def test_large_input_form_equals_sql(spark, data, connection, name, monkeypatch):
    """The forms chosen for inputs beyond one task, without broadcasts."""
    monkeypatch.setattr("tallyloom.session.ONE_TASK_ROWS", -1)
    monkeypatch.setattr("tallyloom.session.PERCENTILE_ROWS", -1)
    monkeypatch.setattr("tallyloom.session.SCAN_SPLIT_BYTES", 0)
    monkeypatch.setattr("tallyloom.session.BROADCAST_ROWS", 0)
    monkeypatch.setattr("tallyloom.operators.stats.SLOT_ROWS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert compare(REGISTRY[name](spark, data), connection, ORACLES[name]) == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
