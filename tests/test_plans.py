"""Physical plans: no Python workers, map-side combine, pruned scans, no product joins."""

import pytest

from tallyloom.operators import collect, features, ordered, speedup, stats
from tallyloom.plans import fixtures
from tallyloom.plans.catalog import REGISTRY

BATCH = [q for q in REGISTRY if q.split("_")[0] not in ("rf", "stream", "input") and not q.endswith("_stream")]


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_python_worker_and_no_product(spark, data, name):
    text = plan(REGISTRY[name](spark, data))
    for operator in ("BatchEvalPython", "ArrowEvalPython", "PythonRDD", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in text


def test_word_count_combines_before_the_shuffle(spark, data):
    text = plan(REGISTRY["wc_words"](spark, data))
    assert text.index("partial_count") > text.index("Exchange hashpartitioning(word")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_large_scans_are_not_dealt_out(spark, data, monkeypatch):
    monkeypatch.setattr("tallyloom.session.SCAN_SPLIT_BYTES", 0)
    text = plan(REGISTRY["wc_words"](spark, data))
    assert text.count("Exchange") == 1 and "ReadSchema: struct<text:string>" in text


def test_best_row_is_limited_per_task_before_the_shuffle(spark, data):
    items = spark.read.parquet(f"{data}/lineitem.parquet")
    best = collect.best_per_key(items, ["l_orderkey"], "l_extendedprice", ["l_partkey"])
    assert "WindowGroupLimit" in plan(best) and "Partial" in plan(best)


def test_top_speedups_do_not_sort_everything(spark, data):
    rows = fixtures.configurations(spark, data)
    keys = [c for c in rows.columns if c != "seconds"]
    top = speedup.top_speedups(stats.exact_percentiles(rows, "seconds", {"median_sec": 0.5}, keys))
    assert "TakeOrderedAndProject" in plan(top)


def test_last_record_is_an_aggregate(spark, data):
    text = plan(ordered.last_record(fixtures.event_runs(spark, data), ["seq"], ["scale"]))
    assert "partial_max_by" in text and "Window" not in text


def test_large_percentiles_hold_no_group_in_one_task(spark, data):
    frame = spark.read.parquet(f"{data}/lineitem.parquet")
    text = plan(stats.exact_percentiles(frame, "l_extendedprice", {"m": 0.5}, ["l_returnflag"], one_task=False))
    assert "percentile" not in text and "collect_list" not in text and "partial_count" in text


def test_large_numbering_shuffles_rows_once(spark, data):
    frame = spark.read.parquet(f"{data}/events.parquet").select("event_id", "event_type")
    text = plan(ordered.number_rows(frame, ["event_id"], ["event_type"], one_task=False))
    assert "SinglePartition" not in text


def test_filters_and_columns_reach_the_scan(spark, data):
    runs = spark.read.parquet(f"{data}/orders.parquet").withColumnRenamed("o_totalprice", "median_sec")
    frame = features.regression_inputs(runs).frame.select("label")
    assert "PushedFilters: [IsNotNull(o_totalprice)]" in plan(frame)
    assert "ReadSchema: struct<o_totalprice:double>" in plan(frame)


def test_one_row_sides_are_subqueries(spark, data):
    text = plan(REGISTRY["runs_enriched"](spark, data))
    assert "Subquery" in text and "Join" not in text
