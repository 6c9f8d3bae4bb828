"""Streams give the result of the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import stats
from tallyloom.sources import logs
from tallyloom.operators.collect import collect_dataset
from tallyloom.schemas import AGG, CONFIG_KEYS
from tallyloom.sources import csvs
from tallyloom.streaming import collection, gauges, percentiles, runs


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def write(spark, path, lines):
    logs.append_log(spark.createDataFrame([(line,) for line in lines], "value STRING"), path)


def test_ingest_picks_up_only_new_lines(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("log", "table", "state"))
    write(spark, source, ["WordCount,Spark,tiny,1.0", "bad", "WordCount,Spark,tiny,3.0"])
    runs.ingest_log(spark, source, table, state).awaitTermination()
    write(spark, source, ["WordCount,Spark,small,5.0"])
    for _ in range(2):
        runs.ingest_log(spark, source, table, state).awaitTermination()
    batch = logs.parse_comma_log(logs.read_lines(spark, source))
    assert rows(spark.read.parquet(table)) == rows(batch) and batch.count() == 3


def test_running_stats_in_complete_mode(spark, tmp_path):
    source = str(tmp_path / "log")
    write(spark, source, [f"WordCount,Spark,{s},{d}" for s, d in (("tiny", 1.5), ("tiny", 2.5), ("small", 4.0))])
    query = (
        runs.running_stats(runs.log_stream(spark, source)).writeStream.outputMode("complete").format("memory")
        .queryName("running").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert rows(spark.table("running")) == rows(runs.running_stats(logs.parse_comma_log(logs.read_lines(spark, source))))


def test_gauge_windows_of_stream_and_batch(spark, tmp_path):
    samples = spark.range(100).select(
        F.concat(F.lit("host"), F.col("id") % 2).alias("source"), (F.col("id") * 1.5).alias("value"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"),
    )
    samples.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(samples.schema).parquet(str(tmp_path / "in"))
    closed = gauges.gauge_rollup(stream, late="10 seconds")
    gauges.store_rollup(closed, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    end = 1_700_000_000 + 99 - 10
    batch = gauges.gauge_rollup(samples).where(F.unix_timestamp("window_start") + 5 <= end)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(batch) and batch.count() == 34


def test_statistics_follow_new_lines_only(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("log", "stats", "state"))
    deliveries = [
        ["WordCount,Spark,tiny,1.0", "bad", "WordCount,Spark,tiny,3.5", "WordCount,Spark,huge,9.25"],
        ["WordCount,Spark,tiny,8.0", "WordCount,Spark,small,5.0"],
    ]
    for lines in deliveries:
        write(spark, source, lines)
        query = runs.keep_stats(spark, source, path, state)
        query.awaitTermination()
        # each file is read once: the rows of a run are the lines of its delivery
        assert sum(p["numInputRows"] for p in query.recentProgress) == len(lines)
        batch = runs.running_stats(logs.parse_comma_log(logs.read_lines(spark, source)))
        got = {tuple(r)[:3]: tuple(r)[3:] for r in runs.stored_stats(spark, path).select(batch.columns).collect()}
        want = {tuple(r)[:3]: tuple(r)[3:] for r in batch.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    runs.keep_stats(spark, source, path, state).awaitTermination()  # nothing new
    assert runs.stored_stats(spark, path).count() == 3


def test_open_and_closed_windows_are_all_windows(spark, tmp_path):
    def deliver(first, last):
        spark.range(first, last).select(
            F.concat(F.lit("host"), F.col("id") % 2).alias("source"), (F.col("id") * 1.5).alias("value"),
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"),
        ).write.mode("append").parquet(str(tmp_path / "in"))

    counts = []
    for first, last in ((0, 60), (60, 100)):
        deliver(first, last)
        samples = spark.read.parquet(str(tmp_path / "in"))
        stream = gauges.gauge_rollup(spark.readStream.schema(samples.schema).parquet(str(tmp_path / "in")), late="10 seconds")
        gauges.store_rollup(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        both = gauges.all_windows(spark, str(tmp_path / "out"), str(tmp_path / "state"))
        assert rows(both.drop("open")) == rows(gauges.gauge_rollup(samples))
        counts.append(both.where("open").count())
    assert counts == [6, 6]


PERCENTS = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}


def percentile_batches(seed):
    rng = random.Random(seed)
    kinds = [
        lambda: round(rng.gauss(0, 50), rng.choice([0, 3])), lambda: rng.choice([0.0, 1.0, 1.0, 7.5]), lambda: 10.0 ** rng.randint(-300, 300),
        lambda: rng.choice([None, float("nan"), float("inf"), -2.0]),
    ]
    groups = ["a", "b", None]
    return [[(g, kinds[min(3, groups.index(g) + rng.randrange(2))]()) for g in rng.choices(groups, [6, 2, 1], k=rng.choice([1, 30, 400]))] for _ in range(4)]


@pytest.mark.parametrize("seed", range(2))
def test_stored_percentiles_equal_the_batch_form_after_every_batch(spark, tmp_path, seed):
    store, so_far = str(tmp_path / "store"), []
    for number, batch in enumerate(percentile_batches(seed)):
        frame = spark.createDataFrame(batch, "g STRING, v DOUBLE")
        percentiles.add_batch(frame, number, store, "v", ["g"])
        if number == 1:
            percentiles.add_batch(frame, number, store, "v", ["g"])  # a repeated batch counts once
        so_far += batch
        whole = stats.exact_percentiles(spark.createDataFrame(so_far, "g STRING, v DOUBLE"), "v", PERCENTS, ["g"], one_task=True)
        want = {r.g: tuple(r)[1:] for r in whole.collect()}
        got = {r.g: tuple(r)[2:] for r in percentiles.stored_percentiles(spark, store, PERCENTS, ["g"]).collect()}
        assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)
    percentiles.compact(spark, store, str(tmp_path / "compact"), ["g"])
    again = percentiles.stored_percentiles(spark, str(tmp_path / "compact"), PERCENTS, ["g"])
    assert {r.g: tuple(r)[2:] for r in again.collect()} == got


def test_batches_without_values(spark, tmp_path):
    store, none = str(tmp_path / "store"), spark.createDataFrame([("a", None), ("b", float("nan"))], "g STRING, v DOUBLE")
    percentiles.add_batch(none, 0, store, "v", ["g"])
    assert percentiles.stored_percentiles(spark, store, PERCENTS, ["g"]).count() == 0
    percentiles.add_batch(spark.createDataFrame([("a", 2.0), ("a", 2.5)], "g STRING, v DOUBLE"), 1, store, "v", ["g"])
    percentiles.add_batch(none, 2, store, "v", ["g"])
    assert [tuple(r) for r in percentiles.stored_percentiles(spark, store, {"p50": 0.5}, ["g"]).collect()] == [("a", 2, 2.25)]


def test_rank_queries_open_only_the_octaves_they_need(spark, tmp_path):
    store = str(tmp_path / "store")
    frame = spark.range(4000).select(F.pow(F.lit(2.0), F.col("id") / 200).alias("v"))  # twenty octaves
    percentiles.add_batch(frame, 0, store, "v", [])
    found = percentiles.stored_percentiles(spark, store, {"p50": 0.5}, [])
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line and "octave" in line]
    assert scans and all("octave" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)
    opened = {int(name.split("octave=")[1].split("/")[0]) for name in spark.read.parquet(f"{store}/values").inputFiles()}
    read = {r[0] for r in spark.read.parquet(f"{store}/values").where("_v BETWEEN 1023 AND 1025").select("octave").distinct().collect()}
    assert len(opened) > 15 and len(read) <= 2
    assert found.first().p50 == pytest.approx((2 ** (1999 / 200) + 2 ** (2000 / 200)) / 2)
    assert percentiles.stored_percentiles(spark, store, {"p50": 0.5}, []).count() == 1


def test_a_second_collection_reads_new_files_only(spark, tmp_path):
    folder, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    deliveries = [
        {"a.csv": "executors,scale,median_sec\n1,tiny,5.0\n2,tiny,7.0\n1,tiny,4.0\n,tiny,2.0\n", "b.csv": "scale,executors,n\nhuge,3,9\n"},
        {"c.csv": "median_sec,executors,scale,note\n3.0,1,tiny,x\n9.0,2,tiny,y\n1.5,4,small,z\n,,,\n2.0,,tiny,tie\n", "empty.csv": ""},
        {"d/e.csv": "scale\n"},
    ]
    for files in deliveries:
        for name, text in files.items():
            path = tmp_path / "in" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
        query = collection.keep_collection(spark, folder, store, state)
        query.awaitTermination()
        assert sum(p["numInputRows"] for p in query.recentProgress) == sum(len(t.splitlines()) for t in files.values())
        whole = csvs.collect_csv(spark, folder, "*.csv", AGG)
        lacking = [c for c in (*CONFIG_KEYS, "median_sec") if c not in whole.columns]
        whole = whole.select("*", *[F.lit(None).cast(AGG[c].dataType).alias(c) for c in lacking])
        shown = ["executors", "scale", "median_sec", "source_file", *[c for c in ("n", "note") if c in whole.columns]]
        want = collect_dataset(whole, True).select(shown)
        got = collection.best_rows(spark, store).select(shown)
        order = lambda frame: sorted(frame.collect(), key=str)
        assert order(got) == order(want)
        assert order(collection.collected_rows(spark, store).select(shown)) == order(whole.select(shown))
    scores = [r.median_sec for r in got.collect()]
    assert [x for x in scores if x is not None] == sorted(x for x in scores if x is not None)


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    store = str(tmp_path / "store")
    frame = lambda rows: spark.createDataFrame(rows, "k LONG, median_sec DOUBLE, source_file STRING")
    first, second = frame([(i, float(i % 7), "a") for i in range(300)]), frame([(i, float(i % 5), "b") for i in range(200, 400)])
    for number, rows in ((0, first), (1, second), (1, second)):
        collection.merge_rows(rows, number, store, ["k"])
    want = {r.k: (r.median_sec, r.source_file) for r in collect_dataset(first.unionByName(second), True, ["k"]).collect()}
    assert {r.k: (r.median_sec, r.source_file) for r in collection.best_rows(spark, store).collect()} == want
    assert collection.collected_rows(spark, store).count() == 500
