"""Registered queries: each takes a session and a table folder and returns a DataFrame over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyloom.functions import scalars
from tallyloom.functions.parse import is_measured
from tallyloom.functions.text import call_style_prints, escape_quotes, python3_shebang
from tallyloom.operators import collect, conf, eventlog, features, metrics, models, ordered, resources, runs
from tallyloom.operators import speedup, stats, wordcount
from tallyloom.plans import fixtures
from tallyloom.schemas import AGG, AGG_META, METRICS
from tallyloom.session import scratch_path, stored
from tallyloom.sources import csvs, eventlog as event_logs, files, generate, logs, meta as metas
from tallyloom.sources.conf import parse_conf
from tallyloom.sources.tables import balanced_table, table
from tallyloom.streaming import collection, gauges, percentiles, runs as run_streams

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def registered(query: Query) -> Query:
    REGISTRY[query.__name__] = query
    return query


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return balanced_table(spark, folder, "documents").select(F.col("text").alias("value"))


# Word counts and generated text


@registered
def wc_words(spark, folder):
    return wordcount.word_counts(_texts(spark, folder))


@registered
def wc_single_space(spark, folder):
    return wordcount.space_token_counts(fixtures.spaced_lines(spark, folder))


@registered
def wc_distinct(spark, folder):
    return wordcount.distinct_words(_texts(spark, folder))


@registered
def range_count(spark, folder):
    """One integer per line item, counted."""
    return table(spark, folder, "lineitem").select(generate.row_number().alias("id")).agg(F.count("id").alias("n"))


@registered
def gen_constant_lines(spark, folder):
    """The fixed line once per order, counted."""
    return wordcount.word_counts(table(spark, folder, "orders").select(generate.constant_line().alias("value")))


@registered
def gen_random_text(spark, folder):
    parts = balanced_table(spark, folder, "part").select("p_partkey")
    return parts.select("p_partkey", generate.random_line(F.col("p_partkey")).alias("value"))


@registered
def text_rewrite(spark, folder):
    script = python3_shebang(call_style_prints(F.col("script")))
    return fixtures.scripts(spark, folder).select(
        "conv_id", "turn", script.alias("script"), escape_quotes(F.col("text")).alias("escaped")
    )


# Run logs


@registered
def runs_from_csv_log(spark, folder):
    return logs.parse_comma_log(fixtures.comma_lines(spark, folder))


@registered
def runs_from_report(spark, folder):
    return logs.parse_report(fixtures.report_lines(spark, folder))


@registered
def report_body(spark, folder):
    return logs.body_lines(fixtures.report_lines(spark, folder))


@registered
def runs_fallback(spark, folder):
    """Report lines are no comma log, so the preferred source yields nothing and the report is used."""
    lines = fixtures.report_lines(spark, folder)
    return logs.first_nonempty(logs.parse_comma_log(lines), logs.parse_report(lines))


@registered
def runs_preferred(spark, folder):
    """The comma log yields records, so the report is ignored."""
    return logs.first_nonempty(
        logs.parse_comma_log(fixtures.comma_lines(spark, folder)),
        logs.parse_report(fixtures.report_lines(spark, folder)),
    )


@registered
def runs_enriched(spark, folder):
    path = scratch_path(spark, "meta")
    metas.write_meta(metas.build_meta(spark), path)
    records = logs.parse_comma_log(fixtures.comma_lines(spark, folder))
    return runs.enriched_runs(records, metas.read_meta(spark, path), ["seq"], by=["scale"])


@registered
def runs_numbered(spark, folder):
    """Run number over the whole log."""
    records = logs.parse_comma_log(fixtures.comma_lines(spark, folder))
    return ordered.number_rows(records, ["seq"])


@registered
def run_stats(spark, folder):
    return stats.run_stats(fixtures.event_runs(spark, folder))


@registered
def log_stats(spark, folder):
    """One aggregate row for the whole log, labelled by its first record."""
    return stats.log_stats(logs.parse_comma_log(fixtures.comma_lines(spark, folder)), ["seq"])


@registered
def first_run_labels(spark, folder):
    return stats.first_values(
        logs.parse_report(fixtures.report_lines(spark, folder)), ["benchmark", "engine", "duration_sec"], ["seq"], ["scale"]
    )


@registered
def agg_rows(spark, folder):
    records = logs.parse_report(fixtures.report_lines(spark, folder))
    return runs.aggregate_rows(records, metas.build_meta(spark, is_default=1))


@registered
def last_run_per_scale(spark, folder):
    lines = fixtures.report_lines(spark, folder).where(is_measured(F.col("value")))
    return ordered.last_record(logs.parse_report(lines), ["seq"], ["scale"])


@registered
def log_head_tail(spark, folder):
    records = logs.parse_comma_log(fixtures.comma_lines(spark, folder))
    first = ordered.head(records, ["seq"], 10).withColumn("part", F.lit("head"))
    return first.unionByName(ordered.tail(records, ["seq"], 5).withColumn("part", F.lit("tail")))


@registered
def log_append_roundtrip(spark, folder):
    """Start a report, append two batches of lines, read it back and parse it."""
    records = fixtures.event_runs(spark, folder)
    path = scratch_path(spark, "report")
    logs.create_report(spark, path)
    for half in (0, 1):
        batch = records.where(F.col("seq") % 2 == half)
        logs.append_log(batch.select(logs.report_line().alias("value")), path)
    logs.create_report(spark, path)
    return logs.parse_report(logs.read_lines(spark, path))


@registered
def elapsed_ms(spark, folder):
    """Elapsed seconds between the first and the last event of each user."""
    spans = table(spark, folder, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    start, end = scalars.epoch_ns(F.col("a")), scalars.epoch_ns(F.col("b"))
    return spans.select("user_id", scalars.elapsed_sec(start, end).alias("duration_sec"))


# Collected tables


@registered
def collect_union(spark, folder):
    even, odd = fixtures.agg_layouts(spark, folder)
    return collect.union_by_name([even.withColumn("source", F.lit("even")), odd.withColumn("source", F.lit("odd"))])


@registered
def collect_csv_files(spark, folder):
    """Write both layouts as CSV files, collect the files by column name, and keep which folder a row came from."""
    base = scratch_path(spark, "csv")
    for name, rows in zip(("even", "odd"), fixtures.agg_layouts(spark, folder)):
        csvs.write_csv(rows, f"{base}/{name}")
    collected = csvs.collect_csv(spark, base, "*.csv", AGG)
    source = F.regexp_extract("source_file", r"/(even|odd)/[^/]*$", 1)
    return collected.withColumn("source", source).drop("source_file")


@registered
def collect_dedupe(spark, folder):
    """Cheapest line item per order line, sorted by price."""
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"
    )
    return collect.collect_dataset(
        items, True, ["l_orderkey", "l_linenumber"], "l_extendedprice", ["l_partkey", "l_suppkey"]
    )


@registered
def collect_best_configs(spark, folder):
    """Best row per configuration over the eleven configuration columns."""
    rows = fixtures.agg_like(spark, folder).withColumnRenamed("p_partkey", "source_file")
    return collect.collect_dataset(rows, True)


@registered
def collect_incremental(spark, folder):
    """The same from CSV files in two layouts that arrive one after the other; the second collection reads the new files only."""
    base, store, state = (scratch_path(spark, name) for name in ("csv", "collection", "collection-state"))
    rows, known = fixtures.agg_like(spark, folder), T.StructType([*AGG, T.StructField("p_partkey", T.LongType())])
    for name, part in (("first", rows.where("p_partkey % 3 = 0").select(*reversed(rows.columns))), ("second", rows.where("p_partkey % 3 <> 0"))):
        csvs.write_csv(part, f"{base}/{name}")
        query = collection.keep_collection(spark, base, store, state, known=known, ties=["p_partkey"])
        query.awaitTermination()
    return collection.best_rows(spark, store, ties=["p_partkey"]).drop("source_file")


@registered
def source_counts(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("source").alias("source_file"))
    return collect.source_counts(docs)


@registered
def dataset_build(spark, folder):
    data = features.regression_inputs(fixtures.tuning_rows(spark, folder))
    return data.frame.select("o_orderkey", *data.numeric, *data.categorical, "is_default", "label")


@registered
def speedup_top20(spark, folder):
    rows = fixtures.configurations(spark, folder)
    keys = [c for c in rows.columns if c != "seconds"]
    medians = stats.exact_percentiles(rows, "seconds", {"median_sec": 0.5}, keys)
    top = speedup.top_speedups(medians)
    return top.select(
        "label", "source_file", F.round("median_sec", 4).alias("median_sec"), F.round("speedup", 6).alias("speedup")
    )


# Configuration and resources


@registered
def conf_scan(spark, folder):
    return parse_conf(fixtures.conf_lines(spark, folder))


@registered
def conf_scan_lookup(spark, folder):
    key = lambda column: F.concat(F.lit("cust."), F.col(column).cast("string")).alias("key")
    wanted = table(spark, folder, "customer").select(key("c_custkey"))
    overrides = table(spark, folder, "supplier").select(key("s_suppkey"), F.col("s_name").alias("value"))
    return conf.lookup(wanted, overrides, parse_conf(fixtures.conf_lines(spark, folder)), "none")


@registered
def conf_insert_absent(spark, folder):
    lines = parse_conf(fixtures.conf_lines(spark, folder))
    return conf.insert_absent(lines, fixtures.conf_changes(spark, folder))


@registered
def conf_upsert(spark, folder):
    lines = parse_conf(fixtures.conf_lines(spark, folder))
    return conf.upsert(lines, fixtures.conf_changes(spark, folder))


@registered
def scale_parallelism(spark, folder):
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    scale = (
        F.when(priority == "1-URGENT", "tiny").when(priority == "2-HIGH", "small").when(priority == "3-MEDIUM", "large")
        .when(priority == "5-LOW", "huge").otherwise("custom")
    )
    explicit = F.when(key % 3 == 0, (key % 100).cast("int"))
    return table(spark, folder, "orders").select(
        "o_orderkey", scale.alias("scale"), scalars.parallelism_or_default(explicit, scale).alias("parallelism")
    )


@registered
def prepare_sizing(spark, folder):
    sized = table(spark, folder, "part").select(
        "p_partkey", "p_size", scalars.writers_for((F.col("p_partkey") % 400).cast("int")).alias("writers")
    )
    return sized.withColumn("bytes_per_writer", scalars.bytes_per_writer(F.col("p_size"), F.col("writers")))


@registered
def submit_options(spark, folder):
    rows = fixtures.agg_like(spark, folder)
    return rows.select("p_partkey", scalars.submit_options({c: F.col(c) for c in AGG_META}).alias("spark_conf"))


@registered
def resource_preflight(spark, folder):
    verdicts = resources.preflight(fixtures.requests(spark, folder), fixtures.workers(spark, folder), ["cluster"])
    return verdicts.select(
        "p_partkey", "cluster", "req_cores", F.round("req_mem_gb", 6).alias("req_mem_gb"), "sum_cores", "sum_mem_gb",
        "verdict", "exact_fit", "worker_fit",
    )


@registered
def resource_competition(spark, folder):
    """Which of the requests to a cluster it can serve together."""
    verdicts = resources.preflight(fixtures.requests(spark, folder), fixtures.workers(spark, folder), ["cluster"])
    served = resources.competing_requests(verdicts, "p_partkey", ["cluster"])
    return served.select("p_partkey", "cluster", "share", "used_cores", F.round("used_gb", 3).alias("used_gb"), "granted")


@registered
def resource_totals(spark, folder):
    return resources.worker_totals(fixtures.workers(spark, folder))


@registered
def input_size(spark, folder):
    return files.input_size(spark, folder, "*.parquet")


@registered
def input_files(spark, folder):
    return files.list_files(spark, folder, "*.parquet").orderBy("source_file")


@registered
def written_sizes(spark, folder):
    """Write the texts into a folder per language, then list the files in order and add up their bytes per folder."""
    path = scratch_path(spark, "texts")
    texts = table(spark, folder, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("value"))
    texts.write.partitionBy("lang").text(path)
    lang = F.regexp_extract("source_file", r"/lang=([^/]*)/[^/]*$", 1).alias("lang")
    return files.list_files(spark, path).groupBy(lang).agg(F.sum("bytes").alias("bytes")).orderBy("lang")


# Features and models


def _split_rows(spark, folder):
    rows = features.with_split(fixtures.regression_rows(spark, folder), fixtures.ROW_KEY)
    return rows, rows.where("part = 'train'"), rows.where("part = 'test'")


@registered
def hash_split(spark, folder):
    rows, _, _ = _split_rows(spark, folder)
    return rows.select(*fixtures.ROW_KEY, "part")


@registered
def train_fractions(spark, folder):
    _, train, _ = _split_rows(spark, folder)
    return features.train_fractions(train, fixtures.ROW_KEY).groupBy("percent").agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum")
    )


@registered
def one_hot(spark, folder):
    """Vector of quantity and one-hot return flag; the flag R is not in the fitted rows and gets zeros."""
    rows = fixtures.regression_rows(spark, folder)
    model = features.fit_encoder(rows.where("l_returnflag <> 'R'"), ["l_quantity"], ["l_returnflag"])
    vector = vector_to_array("features")
    return model.transform(rows).select(
        *fixtures.ROW_KEY, *[F.get(vector, F.lit(i)).alias(f"f{i}") for i in range(3)]
    )


@registered
def one_hot_wide(spark, folder):
    """One-hot customer of each order behind its price, from a category table; customers of no train order set nothing."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    known = features.category_table(orders.where("o_orderkey % 5 <> 0"), "o_custkey")
    vectors = features.sparse_one_hot(orders, ["o_totalprice"], {"o_custkey": known})
    hot = F.filter(F.arrays_zip("indices", "values"), lambda e: e["indices"] > 0)
    return vectors.select(
        "o_orderkey", "size", F.get("values", F.lit(0)).alias("price"), F.get(hot.getField("indices"), F.lit(0)).alias("hot"),
        F.coalesce(F.get(hot.getField("values"), F.lit(0)), F.lit(0.0)).alias("flag"),
    )


def _constant_predictions(spark, folder):
    _, train, test = _split_rows(spark, folder)
    return models.constant_predictions(train, test, {"Dummy": "median", "Mean": "mean"})


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("model", *[F.round(m, 4).alias(m) for m in METRICS])


@registered
def dummy_metrics(spark, folder):
    return _rounded(metrics.error_metrics(_constant_predictions(spark, folder)))


@registered
def metrics_long(spark, folder):
    scores = metrics.error_metrics(_constant_predictions(spark, folder))
    return metrics.named_metrics(scores).select("key", F.round("value", 4).alias("value"))


@registered
def metrics_wide(spark, folder):
    """Long metric rows stored in a table, read back and turned to one row per model."""
    path = scratch_path(spark, "metrics")
    metrics.append_metrics(metrics.error_metrics(_constant_predictions(spark, folder)), path)
    return _rounded(metrics.metrics_wide(spark.read.parquet(path)))


@registered
def metric_series(spark, folder):
    scores = _rounded(metrics.error_metrics(_constant_predictions(spark, folder)))
    return metrics.metric_series(scores, "RMSE")


@registered
def best_so_far(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    return ordered.running_min(events, "value", ["event_id"], ["event_type"])


@registered
def anneal_replay(spark, folder):
    return models.anneal_history(fixtures.scored_draws(spark, folder), ["search_id"])


# The registered annealed search makes all steps over all train rows, with small forests; the random search draws from the
# full space. The functions keep the full spaces as defaults.
SMALL_SPACE = {"trees": range(5, 11), "depths": range(3, 6)}


def _encoded(spark, folder):
    """Encoded train and test rows; rows and split are stored, as encoder, constants and forests read them several times."""
    rows = stored(_split_rows(spark, folder)[0], "regression")
    numeric, categorical = ["l_extendedprice", "l_discount", "l_tax", "l_quantity"], ["l_returnflag"]
    model = features.fit_encoder(rows.where("part = 'train'"), numeric, categorical)
    values = features.encoded_values(model, numeric, categorical).alias("features")
    encoded = rows.select(*fixtures.ROW_KEY, "part", values, "label")
    return encoded.where("part = 'train'"), encoded.where("part = 'test'")


@registered
def rf_search(spark, folder):
    """Metrics of the forest searched in the full space of parameters next to those of the constant median."""
    train, test = _encoded(spark, folder)
    found = models.random_search(train, fixtures.ROW_KEY)
    forest = found.model.transform(test).select(F.lit("RandomSearch_RF").alias("model"), "label", "prediction")
    return metrics.error_metrics(forest.unionByName(models.constant_predictions(train, test)))


@registered
def rf_anneal(spark, folder):
    """Trace of an annealed search; it is scored on a validation part of the train rows."""
    train = _encoded(spark, folder)[0]
    held_out = scalars.hash_bucket(features.row_key(*fixtures.ROW_KEY, salt="valid")) < 25
    return models.annealed_search(train, held_out, fixtures.ROW_KEY, **SMALL_SPACE).trace


@registered
def rf_learning_curve(spark, folder):
    train, test = _encoded(spark, folder)
    params = {"numTrees": 8, "maxDepth": 5, "minInstancesPerNode": 1, "featureSubsetStrategy": "all"}
    return models.learning_curve(train, test, fixtures.ROW_KEY, params)


# Streams and event logs


def _shaped_rollup(rollup: DataFrame) -> DataFrame:
    return rollup.withColumns({
        "window_start": F.col("window_start").cast("string"), "avg_value": F.round("avg_value", 9),
    })


def _gauges(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("source"), "ts", "value")


@registered
def gauge_rollup(spark, folder):
    return _shaped_rollup(gauges.gauge_rollup(_gauges(table(spark, folder, "events")), width="1 hour"))


@registered
def gauge_rollup_stream(spark, folder):
    """Hourly windows of a stream over the events, two hours of lateness allowed: those it has closed and those still open."""
    path, state = scratch_path(spark, "gauges"), scratch_path(spark, "gauges-state")
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    rollup = gauges.gauge_rollup(_gauges(stream), width="1 hour", late="2 hours")
    gauges.store_rollup(rollup, path, state).awaitTermination()
    return _shaped_rollup(gauges.all_windows(spark, path, state))


def _arriving_log(spark, folder):
    """Folder of comma log lines and the two deliveries that bring them, each a function to call: a new log, then more lines."""
    source, lines = scratch_path(spark, "log"), fixtures.comma_lines(spark, folder)
    part = lambda which: lines.where(which).select("value")
    return source, [
        lambda: logs.replace_log(part("seq % 3 <> 0"), source), lambda: logs.append_log(part("seq % 3 = 0"), source),
    ]


@registered
def stream_run_stats(spark, folder):
    """Comma log lines arrive in two deliveries; the statistics are brought up to date after each from its lines alone."""
    source, deliveries = _arriving_log(spark, folder)
    path, state = scratch_path(spark, "stats"), scratch_path(spark, "stats-state")
    for deliver in deliveries:
        deliver()
        run_streams.keep_stats(spark, source, path, state).awaitTermination()
    return run_streams.stored_stats(spark, path).select(
        "benchmark", "engine", "scale", "n", "min_sec", "max_sec",
        F.round("mean_sec", 6).alias("mean_sec"), F.round("std_sec", 6).alias("std_sec"),
    )


@registered
def stream_percentiles(spark, folder):
    """Exact percentiles of the same log from stored counts that each delivery extends."""
    source, deliveries = _arriving_log(spark, folder)
    store, state = scratch_path(spark, "percentiles"), scratch_path(spark, "percentiles-state")
    for deliver in deliveries:
        deliver()
        records = run_streams.log_stream(spark, source)
        percentiles.keep_percentiles(records, store, state, "duration_sec", run_streams.RUN_KEYS).awaitTermination()
    found = percentiles.stored_percentiles(spark, store, stats.PERCENTS, run_streams.RUN_KEYS)
    return found.select(*run_streams.RUN_KEYS, "n", *[F.round(name, 6).alias(name) for name in stats.PERCENTS])


@registered
def eventlog_rollup(spark, folder):
    tasks = event_logs.task_table(fixtures.event_log_lines(spark, folder))
    return eventlog.stage_rollup(tasks, ["app"])


@registered
def app_durations(spark, folder):
    return event_logs.app_durations(fixtures.event_log_lines(spark, folder), ("app",))
