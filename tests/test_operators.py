"""Operators on small frames: order, skew, ties, missing columns and rows, partitioning."""

import random
import statistics

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallyloom.operators import collect, conf, features, metrics, models, ordered, resources, runs, speedup, stats, wordcount
from tallyloom.plans import catalog
from tallyloom.schemas import AGG, RUNS
from tallyloom.sources import logs, meta
from tallyloom.sources.conf import parse_conf


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def skewed(spark, n=4000, partitions=8):
    """A third of the rows has one key; values have ties, negatives and a heavy tail."""
    rng = random.Random(7)
    data = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        value = rng.choice([rng.expovariate(0.01), 5.0, -rng.random(), 0.0, rng.random() * 1e6])
        data.append((i, key if i % 97 else None, value))
    return data, spark.createDataFrame(data, "seq BIGINT, key STRING, v DOUBLE").repartition(partitions, "v")


def linear(values, p):
    ordered_values = sorted(values)
    k = (len(ordered_values) - 1) * p
    low = int(k)
    high = min(low + 1, len(ordered_values) - 1)
    return ordered_values[low] + (ordered_values[high] - ordered_values[low]) * (k - low)


def groups(data):
    found = {}
    for _, key, value in data:
        found.setdefault(key, []).append(value)
    return found


@pytest.mark.parametrize("one_task", [True, False])
@pytest.mark.parametrize("partitions", [1, 16])
def test_percentiles_are_exact_per_group(spark, one_task, partitions):
    data, frame = skewed(spark, partitions=partitions)
    wanted = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}
    found = stats.exact_percentiles(frame, "v", wanted, ["key"], one_task=one_task)
    by_key = groups(data)
    got = {r.key: r for r in found.collect()}
    assert set(got) == set(by_key)
    for key, values in by_key.items():
        for name, p in wanted.items():
            assert got[key][name] == pytest.approx(linear(values, p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("one_task", [True, False])
def test_percentiles_over_all_rows_skip_missing_values(spark, one_task):
    frame = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (4.0,), (2.0,)], "v DOUBLE")
    assert rows(stats.exact_percentiles(frame, "v", {"m": 0.5, "q": 0.25}, one_task=one_task)) == [(2.0, 1.5)]


@pytest.mark.parametrize("one_task", [True, False])
def test_run_stats_match_python(spark, one_task):
    durations = {"tiny": [1.5], "small": [1.0, 2.0, 4.0, 8.0], "large": [3.25, 1.125, 9.5]}
    data = [("WordCount", "Spark", s, d) for s, ds in durations.items() for d in ds]
    frame = spark.createDataFrame(data, "benchmark STRING, engine STRING, scale STRING, duration_sec DOUBLE")
    for r in stats.run_stats(frame, one_task=one_task).collect():
        ds = durations[r.scale]
        assert (r.n, r.mean_sec, r.median_sec) == (len(ds), round(statistics.mean(ds), 3), round(statistics.median(ds), 3))
        assert (r.p50_sec, r.p90_sec, r.p99_sec) == tuple(pytest.approx(linear(ds, p), abs=6e-4) for p in (0.5, 0.9, 0.99))
        assert r.std_sec == pytest.approx(statistics.pstdev(ds), abs=6e-4)


def test_log_stats_uses_the_first_label_and_skips_an_empty_log(spark):
    data = [(2, "WordCount", "Spark", "b", 3.0), (1, "wordcount", "spark", "a", 1.0)]
    frame = spark.createDataFrame(data, "seq INT, benchmark STRING, engine STRING, scale STRING, duration_sec DOUBLE")
    row = stats.log_stats(frame, ["seq"]).first()
    assert (row.benchmark, row.engine, row.scale, row.n, row.median_sec) == ("wordcount", "spark", "a", 2, 2.0)
    assert rows(stats.log_stats(frame.where("seq > 9"), ["seq"])) == []


@pytest.mark.parametrize("partitions", [1, 64])
@pytest.mark.parametrize("settings", [{"one_task": True}, {"one_task": False, "block_rows": 37}])
def test_numbering_and_running_min(spark, partitions, settings):
    data, frame = skewed(spark, 2000, partitions)
    numbered = {r.seq: r.run_idx for r in ordered.number_rows(frame, ["seq"], ["key"], **settings).collect()}
    lowest = {r.seq: r.best for r in ordered.running_min(frame, "v", ["seq"], ["key"], **settings).collect()}
    count, best = {}, {}
    assert len(numbered) == len(lowest) == len(data)
    for seq, key, value in data:
        count[key] = count.get(key, 0) + 1
        best[key] = min(best.get(key, value), value)
        assert (numbered[seq], lowest[seq]) == (count[key], best[key])
    whole = ordered.number_rows(frame, ["seq"], **settings)
    assert {r.seq: r.run_idx for r in whole.collect()} == {seq: seq + 1 for seq, _, _ in data}


@pytest.mark.parametrize("one_task", [True, False])
def test_log_order_survives_files_and_splits(spark, tmp_path, one_task):
    expected = []
    for part in range(3):
        lines = [f"WordCount,Spark,tiny,{part * 100 + i}.000" for i in range(20)]
        (tmp_path / f"part-{part}.txt").write_text("\n".join(lines) + "\n")
        expected += [part * 100.0 + i for i in range(20)]
    records = logs.parse_comma_log(logs.read_ordered_lines(spark, str(tmp_path)).repartition(7))
    numbered = ordered.number_rows(records, logs.LOG_ORDER, blocks=logs.LOG_BLOCK, one_task=one_task)
    assert [r.duration_sec for r in numbered.orderBy("run_idx").collect()] == expected
    assert [r.run_idx for r in numbered.orderBy("run_idx").collect()] == list(range(1, 61))


def test_last_head_tail(spark):
    frame = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(20)], "seq INT, g STRING").repartition(5)
    assert sorted(rows(ordered.last_record(frame, ["seq"], ["g"]))) == [(18, "b"), (19, "a")]
    assert rows(ordered.last_record(frame.where("seq < 0"), ["seq"])) == []
    assert [r.seq for r in ordered.head(frame, ["seq"], 3).collect()] == [0, 1, 2]
    assert [r.seq for r in ordered.tail(frame, ["seq"], 3).collect()] == [17, 18, 19]


def test_word_counts_on_edge_lines(spark):
    frame = spark.createDataFrame([("",), ("  ",), (" a b  a",), ("a c",)], "value STRING")
    assert sorted(rows(wordcount.word_counts(frame))) == [("a", 3), ("b", 1), ("c", 1)]
    assert rows(wordcount.distinct_words(frame)) == [(3, 5)]
    assert rows(wordcount.distinct_words(frame.where("false"))) == [(0, 0)]
    assert dict(rows(wordcount.space_token_counts(frame)))[""] == 3


def log_frame(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines)), "seq INT, value STRING")


def test_comma_log_rules(spark):
    frame = log_frame(
        spark, "WordCount,Spark,tiny,12.345", " wordcount ,Spark,\ttiny , 1_000", "WordCount,Spark,tiny", "WordCount,Spark,tiny,1,2",
        "Sort,Spark,tiny,1", "", "WORDCOUNTX,a,b,2", "WordCount,Spark,tiny,nan", "WordCount,Spark,tiny,5d", "WordCount,Spark,tiny,1.2s",
    )
    assert [r[0] for r in rows(logs.parse_comma_log(frame))] == [0, 1, 6]


def test_report_rules(spark):
    frame = log_frame(
        spark, "Benchmark\tEngine\tScale\tDuration(s)", "WordCount\tSpark\ttiny\t12.3s", "wordcount spark   tiny 7 extra",
        "WordCount Spark tiny", "WordCount Spark tiny n/a", "  ", "Sort Spark tiny 1",
    )
    assert [(r.seq, r.duration_sec) for r in logs.parse_report(frame).collect()] == [(1, 12.3), (2, 7.0)]


def test_fallback_only_without_preferred_rows(spark):
    a, b = spark.createDataFrame([(1,)], "x INT"), spark.createDataFrame([(2,), (3,)], "x INT")
    assert rows(logs.first_nonempty(a, b)) == [(1,)]
    assert sorted(rows(logs.first_nonempty(a.where("x > 5"), b))) == [(2,), (3,)]


def test_runs_and_aggregates_with_and_without_metadata(spark):
    records = logs.parse_comma_log(log_frame(spark, "WordCount,Spark,tiny,2.0006", "WordCount,Spark,tiny,1"))
    table = runs.enriched_runs(records, meta.build_meta(spark, executors=3), ["seq"])
    assert table.columns == RUNS.fieldNames() and table.dtypes == [(f.name, f.dataType.simpleString()) for f in RUNS]
    assert [(r.run_idx, r.duration_sec, r.executors) for r in table.orderBy("run_idx").collect()] == [(1, 2.001, 3), (2, 1.0, 3)]
    bare = runs.enriched_runs(records, meta.read_meta(spark, "/nowhere/meta.json"), ["seq"])
    assert {(r.executors, r.is_default) for r in bare.collect()} == {(None, 0)}
    for by in (None, ("benchmark", "engine", "scale")):
        agg = runs.aggregate_rows(records, meta.build_meta(spark), by, ["seq"])
        assert agg.columns == AGG.fieldNames() and agg.first().n == 2
    assert runs.aggregate_rows(records.where("seq > 9"), meta.build_meta(spark), None, ["seq"]).isEmpty()


def test_best_per_key_breaks_ties_and_groups_nulls(spark):
    data = [("a", 2.0, "f2"), ("a", 1.0, "f3"), ("a", 1.0, "f1"), (None, None, "f4"), (None, 5.0, "f5"), ("b", None, "f6")]
    frame = spark.createDataFrame(data, "k STRING, median_sec DOUBLE, source_file STRING").repartition(4)
    best = collect.collect_dataset(frame, True, ["k"])
    assert rows(best) == [("a", 1.0, "f1"), (None, 5.0, "f5"), ("b", None, "f6")]
    assert collect.collect_dataset(frame).count() == 6


def test_union_by_name(spark):
    a, b = spark.createDataFrame([(1, "x")], "n INT, s STRING"), spark.createDataFrame([("y", 2.5)], "s STRING, d DOUBLE")
    assert sorted(rows(collect.union_by_name([a, b]).select("s", "n", "d"))) == [("x", 1, None), ("y", None, 2.5)]


CONF = ["# note", "", "spark.a   1", "spark.b\tx  y z", "lonely", "  spark.a 2  ", "#spark.c 3"]


def conf_frame(spark):
    return parse_conf(spark.createDataFrame(list(enumerate(CONF)), "line_no INT, value STRING"))


def test_conf_scan(spark):
    assert rows(conf_frame(spark)) == [(2, "spark.a", "1"), (3, "spark.b", "x y z"), (5, "spark.a", "2")]


def test_conf_lookup_order(spark):
    wanted = spark.createDataFrame([("spark.a",), ("spark.b",), ("spark.z",)], "key STRING")
    env = spark.createDataFrame([("spark.b", "env")], "key STRING, value STRING")
    found = dict(rows(conf.lookup(wanted, env, conf_frame(spark), "none")))
    assert found == {"spark.a": "1", "spark.b": "env", "spark.z": "none"}


def test_conf_insert_and_upsert(spark):
    changes = spark.createDataFrame(
        [(1, "spark.a", "9"), (2, "spark.new", "n1"), (3, "spark.new", "n2"), (4, "spark.a", "10")], "line_no INT, key STRING, value STRING"
    )
    inserted = sorted(rows(conf.insert_absent(conf_frame(spark), changes)))
    assert inserted == [("spark.a", "1"), ("spark.a", "2"), ("spark.b", "x y z"), ("spark.new", "n1")]
    upserted = sorted(rows(conf.upsert(conf_frame(spark), changes)))
    assert upserted == [("spark.a", "10"), ("spark.a", "10"), ("spark.b", "x y z"), ("spark.new", "n2")]


def test_preflight(spark):
    request = spark.createDataFrame([(1, 2, 1, 4), (2, 2, 3, 1), (3, 9, 1, 1)], "id INT, executors INT, executor_cores INT, executor_memory_gb INT")
    workers = spark.createDataFrame([(2, "4G"), (2, "4GB")], "cores INT, memory STRING")
    verdicts = {r.id: (r.verdict, r.exact_fit, r.worker_fit) for r in resources.preflight(request, workers).collect()}
    assert verdicts == {1: ("ok", False, False), 2: ("reject", False, False), 3: ("reject", False, False)}
    halves = spark.createDataFrame([(1, 1, 1, 7), (2, 2, 2, 3)], "id INT, executors INT, executor_cores INT, executor_memory_gb INT")
    fits = {r.id: (r.exact_fit, r.worker_fit) for r in resources.preflight(halves, workers).collect()}
    assert fits == {1: (True, False), 2: (True, True)}  # no single worker holds seven gigabytes
    unknown = workers.unionByName(spark.createDataFrame([(1, "4096M")], "cores INT, memory STRING"))
    assert {r.verdict for r in resources.preflight(request, unknown).collect()} == {"unknown"}
    assert {r.verdict for r in resources.preflight(request, workers.where("cores > 9")).collect()} == {"skipped"}


def test_dataset_rules(spark):
    frame = spark.createDataFrame(
        [(1, "True", "lz4", 3.0), (2, None, None, None), (3, "no", "zstd", 1.0)],
        "executors INT, rdd_compress STRING, io_compression_codec STRING, duration_sec DOUBLE",
    )
    data = features.regression_inputs(frame)
    assert (data.numeric, data.categorical, data.target) == (["executors", "rdd_compress"], ["io_compression_codec"], "duration_sec")
    assert rows(data.frame.select("executors", "rdd_compress", "is_default", "label")) == [(1, 1, 0, 3.0), (3, 0, 0, 1.0)]
    both = features.regression_inputs(frame.withColumn("median_sec", F.lit(2)))
    assert both.target == "median_sec" and both.frame.count() == 3


def test_one_hot_unseen_and_missing_are_zero(spark):
    train = spark.createDataFrame([(1, "b"), (2, "a")], "n INT, c STRING")
    test = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, None)], "n INT, c STRING")
    encoded = features.fit_encoder(train, ["n"], ["c"]).transform(test).orderBy("n").collect()
    assert [r.features.toArray().tolist() for r in encoded] == [[1, 1, 0], [2, 0, 1], [3, 0, 0], [4, 0, 0]]


@pytest.mark.parametrize("one_task", [True, False])
def test_competing_requests_against_a_loop(spark, one_task):
    rng = random.Random(9)
    workers = spark.createDataFrame([(c, rng.randint(1, 8), rng.choice(["4G", "8g", "16GB"])) for c in (1, 2) for _ in range(5)] + [(3, 4, "4096M")], "cluster INT, cores INT, memory STRING")
    asked = [(i, rng.choice([1, 1, 2, 3, 4]), rng.randint(1, 4), rng.randint(1, 3), rng.randint(1, 6)) for i in range(120)]
    requests = spark.createDataFrame(asked, "id LONG, cluster INT, executors INT, executor_cores INT, executor_memory_gb INT")
    verdicts = resources.preflight(requests, workers, ["cluster"])
    got = {r.id: r for r in resources.competing_requests(verdicts, "id", ["cluster"], one_task=one_task).collect()}
    alone, granted = {r.id: r for r in verdicts.collect()}, set()
    for cluster in (1, 2, 3, 4):
        cores = gb = 0
        mine = [r for r in alone.values() if r.cluster == cluster and r.verdict == "ok" and r.exact_fit]
        for r in sorted(mine, key=lambda r: (round(max(r.req_cores / r.sum_cores, r.req_mem_gb / r.sum_mem_gb), 9), r.id)):
            cores, gb = cores + r.req_cores, gb + r.req_mem_gb
            if cores <= r.sum_cores and gb <= r.sum_mem_gb + 1e-9:
                granted.add(r.id)
            assert got[r.id].used_cores == cores and abs(got[r.id].used_gb - gb) < 1e-6
    assert {i for i, r in got.items() if r.granted} == granted and 5 < len(granted) < 60 and len(got) == 120


def test_sparse_one_hot_equals_the_encoder(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda n: rng.choice([None, *(f"c{i}" for i in range(n))])
    rows = [(i, rng.choice([None, 0.0, 1.5, float(i)]), rng.randrange(3), word(40), word(3)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id LONG, x DOUBLE, y LONG, c STRING, d STRING")
    train = frame.where("id % 3 <> 0 AND c <> 'c7'")
    want = {r.id: r.features.toArray().tolist() for r in features.fit_encoder(train, ["x", "y"], ["c", "d"]).transform(frame).collect()}
    for limit in (200_000, -1):  # in one task, and dealt by range
        monkeypatch.setattr("tallyloom.session.ONE_TASK_ROWS", limit)
        tables = {c: features.category_table(train, c) for c in ("c", "d")}
        made = features.with_sparse_vectors(features.sparse_one_hot(frame, ["x", "y"], tables))
        assert made.columns == [*frame.columns, "features"]
        got = {r.id: r.features for r in made.collect()}
        assert all(type(v).__name__ == "SparseVector" for v in got.values())
        assert {i: str(v.toArray().tolist()) for i, v in got.items()} == {i: str(v) for i, v in want.items()}
    model = features.fit_encoder(train, ["x"], ["c"])  # the vectors are ordinary ones
    assert len(model.stages) and made.select(features.F.size(vector_to_array("features"))).first()[0] == len(want[0])


def test_split_is_stable_and_fractions_are_nested(spark):
    frame = spark.range(4000)
    split = lambda df: {r.id: r.part for r in features.with_split(df, ["id"]).collect()}
    first = split(frame.repartition(3))
    assert first == split(frame.repartition(50)) and 0.2 < sum(p == "test" for p in first.values()) / 4000 < 0.3
    taken = {}
    for r in features.train_fractions(frame, ["id"]).collect():
        taken.setdefault(r.percent, set()).add(r.id)
    sizes = [len(taken[p]) for p in features.FRACTION_PERCENTS]
    assert sizes[-1] == 4000 and all(taken[a] <= taken[b] for a, b in zip(features.FRACTION_PERCENTS, features.FRACTION_PERCENTS[1:]))


def test_error_metrics_edges(spark):
    data = [("m", 1.0, 2.0), ("m", 3.0, 3.0), ("m", 0.0, 1.0), ("exact", 2.0, 2.0), ("exact", 2.0, 2.0), ("flat", 2.0, 1.0), ("flat", 2.0, 2.0), ("one", 1.0, 1.0)]
    frame = spark.createDataFrame(data, "model STRING, label DOUBLE, prediction DOUBLE")
    got = {r.model: r for r in metrics.error_metrics(frame).collect()}
    assert got["m"].MAE == pytest.approx(2 / 3) and got["m"].RMSE == pytest.approx((2 / 3) ** 0.5)
    assert got["m"].R2 == pytest.approx(1 - 2 / (14 / 3)) and got["m"].MAPE == pytest.approx((1 + 0 + 1e8) / 3 * 100)
    assert (got["exact"].R2, got["flat"].R2, got["one"].R2) == (1.0, 0.0, None)


def test_metric_tables(spark, tmp_path):
    wide = spark.createDataFrame([("A", 1.0, 2.0, 3.0, 4.0), ("B", 5.0, 6.0, None, 8.0)], "model STRING, MAE DOUBLE, RMSE DOUBLE, R2 DOUBLE, MAPE DOUBLE")
    assert sorted(rows(metrics.metrics_wide(metrics.metrics_long(wide)))) == sorted(rows(wide))
    assert dict(rows(metrics.named_metrics(wide)))["B_RMSE"] == 6.0
    assert rows(metrics.metric_series(wide, "MAE")) == [("A", 1.0), ("B", 5.0)]
    for _ in range(2):
        metrics.append_metrics(wide, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 16


def test_speedup_edges(spark):
    ddl = "source_file STRING, executors INT, executor_cores INT, executor_memory_gb INT, parallelism INT, shuffle_partitions INT, is_default INT, median_sec DOUBLE"
    data = [("b", 1, 1, 1, 8, 8, 1, 10.0), ("a", 2, 1, 2, 8, 16, 1, 20.0), ("c", 4, 2, 4, 64, 64, 0, 5.0), ("d", 1, 1, 1, 1, 1, 0, 0.0)]
    top = speedup.top_speedups(spark.createDataFrame(data, ddl)).collect()
    assert [(r.source_file, r.speedup) for r in top] == [("c", 4.0), ("b", 2.0), ("a", 1.0), ("d", None)]
    assert top[0].label == "4x2/4g P64 SP64"
    none = spark.createDataFrame([r[:6] + (0, 1.0) for r in data], ddl)
    assert speedup.top_speedups(none).isEmpty()


def test_anneal_history_equals_a_loop(spark):
    import math

    rng = random.Random(3)
    searches = {s: [(i, rng.randrange(1000) / 100, rng.random()) for i in range(61)] for s in ("x", "y")}
    frame = spark.createDataFrame([(s, *d) for s, ds in searches.items() for d in ds], "s STRING, iter INT, score DOUBLE, u DOUBLE")
    got = {(r.s, r.iter): r.score for r in models.anneal_history(frame.repartition(9), ["s"]).collect()}
    for s, draws in searches.items():
        current, heat = draws[0][1], 3.0
        assert got[s, 0] == current
        for i, score, u in draws[1:]:
            if score < current or u < math.exp((current - score) / max(heat, 1e-8)):
                current = score
            heat *= 0.93
            assert got[s, i] == current
    assert {(r.iter, r.score) for r in models.anneal_history(frame.where("s = 'x'").drop("s")).collect()} == {
        (i, score) for (s, i), score in got.items() if s == "x"
    }
    assert models.anneal_history(frame.where("false"), ["s"]).isEmpty()


def test_long_annealing_traces_take_linear_time(spark):
    import time

    long = spark.range(10_000).select(
        F.col("id").cast("int").alias("iter"), F.rand(1).alias("score"), F.rand(2).alias("u")
    )
    start = time.perf_counter()
    assert models.anneal_history(long).count() == 10_000
    assert time.perf_counter() - start < 15  # a fraction of a second on a machine at rest


def test_forest_searches_beat_the_median(spark):
    frame = spark.range(600).select("id", (F.col("id") % 17).alias("a"), ((F.col("id") * 7) % 13).alias("b")).withColumn("label", F.col("a") * 3.0 + F.col("b"))
    split = features.with_split(frame, ["id"])
    encoder = features.fit_encoder(split, ["a", "b"], [])
    train, test = (encoder.transform(split.where(F.col("part") == p)).select("id", "features", "label") for p in ("train", "test"))
    space = {"trees": [3, 5], "depths": [4, 5]}
    dummy = models.rmse(models.constant_predictions(train, test))
    found = models.random_search(train, ["id"], draws=2, folds=2, **space)
    assert models.rmse(found.model.transform(test)) < dummy and found.trace.count() == 2
    annealed = models.annealed_search(train, F.col("id") % 3 == 0, ["id"], steps=2, **space)
    assert annealed.score < dummy and annealed.trace.count() == 3
    curve = models.learning_curve(train, test, ["id"], {"numTrees": 3, "maxDepth": 4}, [50, 100])
    assert [r.fraction for r in curve.collect()] == [0.5, 1.0]


def test_searches_and_curve_get_all_train_rows(spark, data, monkeypatch):
    searched, curves = [], []
    search, curve = models.random_search, models.learning_curve
    monkeypatch.setattr(models, "random_search", lambda train, key, **space: searched.append(train.count()) or search(train, key, draws=1, folds=2, **space))
    monkeypatch.setattr(models, "learning_curve", lambda train, *more: curves.append(train.count()) or curve(train, *more, percents=[100]))
    _, train, _ = catalog._split_rows(spark, data)
    found = {r["model"]: r.asDict() for r in catalog.rf_search(spark, data).collect()}
    for row in catalog.dummy_metrics(spark, data).collect():
        if row["model"] in found:
            for name, value in row.asDict().items():
                assert found[row["model"]][name] == (pytest.approx(value, abs=1e-3) if isinstance(value, float) else value)
    assert len(found) > 1 and searched == [train.count()]
    assert catalog.rf_learning_curve(spark, data).count() == 1 and curves == [train.count()]


AWKWARD = {
    "missing": [1.0, 2.0, 4.0, float("nan"), None],
    "infinite": [1.0, float("inf"), float("-inf"), 5.0, None],
    "one day": [1_700_000_000.0 + i * 0.25 for i in range(4000)],
    "tiny": [i * 1e-300 for i in range(-700, 2300)],
    "close": [1000.0 + i * 1e-7 for i in range(3000)],
    "equal": [7.25] * 3000,
    "wide": [-1.7e308, -1.0, 0.0, 1e-308, 1.0, 1.7e308],
}


def test_both_percentile_forms_agree_on_any_distribution(spark, monkeypatch):
    """Slots that hold too many rows are cut until they are small; NaN and infinities count nowhere."""
    monkeypatch.setattr(stats, "SLOT_ROWS", 50)
    data = [(key, v) for key, values in AWKWARD.items() for v in values]
    frame = spark.createDataFrame(data, "key STRING, v DOUBLE").repartition(5)
    wanted = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}
    moments = [F.count("v").alias("n"), F.avg("v").alias("mean")]
    small, large = (
        {r.key: r for r in stats.grouped_summary(frame, ["key"], moments, "v", wanted, one_task=form).collect()}
        for form in (True, False)
    )
    assert set(small) == set(large) == set(AWKWARD)
    for key, values in AWKWARD.items():
        finite = sorted(v for v in values if v is not None and abs(v) < float("inf"))
        assert small[key].n == large[key].n == len(finite)
        for name, p in wanted.items():
            assert large[key][name] == pytest.approx(linear(finite, p), rel=1e-12, abs=0)
            assert small[key][name] == pytest.approx(large[key][name], rel=1e-12, abs=0)


@pytest.mark.parametrize("kind", ["bigint", "timestamp", "string", "double"])
def test_numbering_by_any_order_type(spark, kind):
    """Sparse nanosecond values, timestamps, texts: blocks follow rows, not values."""
    ids = spark.range(3000, numPartitions=7)
    order = {
        "bigint": F.col("id") * 5_000_000, "timestamp": F.timestamp_millis(F.col("id") * 5),
        "string": F.lpad(F.col("id").cast("string"), 6, "0"), "double": F.col("id") * 1e-9,
    }[kind]
    frame = ids.select("id", order.alias("at"))
    for settings in ({"one_task": True}, {"one_task": False}, {"one_task": False, "block_rows": 100}):
        got = ordered.number_rows(frame, ["at"], **settings).collect()
        assert all(r.run_idx == r.id + 1 for r in got) and len(got) == 3000
        low = ordered.running_min(frame.withColumn("v", F.abs(F.col("id") - 1500)), "v", ["at"], **settings).collect()
        assert all(r.best == (1500 - r.id if r.id < 1500 else 0) for r in low)
