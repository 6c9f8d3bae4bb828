"""The three end-to-end flows: measure word counts, turn a log into CSV tables, learn from collected tables."""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions import scalars
from tallyloom.operators import features, metrics, models, speedup
from tallyloom.operators.collect import collect_dataset
from tallyloom.operators.runs import aggregate_rows, enriched_runs
from tallyloom.operators.wordcount import word_counts
from tallyloom.schemas import AGG, RUNS
from tallyloom.sources import csvs, logs, meta as metas


def measure_word_count(spark: SparkSession, text_path: str, log_path: str, scale: str = "tiny", runs: int = 9) -> None:
    """Count the words of a text folder ``runs`` times and append one log line per run."""
    for _ in range(runs):
        start = time.time_ns()
        word_counts(spark.read.text(text_path)).count()
        seconds = (time.time_ns() - start) // 1_000_000 / 1000.0
        record = spark.createDataFrame(
            [("WordCount", "Spark", scale, seconds)], "benchmark STRING, engine STRING, scale STRING, duration_sec DOUBLE"
        )
        logs.append_log(record.select(logs.comma_line().alias("value")), log_path)


def log_to_csv(
    spark: SparkSession, log_path: str, report_path: str, meta_path: str, runs_out: str, agg_out: str,
    by: Sequence[str] | None = None,
) -> None:
    """Parse the run log (or, if it has no record, the report) and write the runs and the aggregate table.

    ``by=None`` gives one aggregate row for the whole log, else one per label. The runs table is written even
    if it is empty, the aggregate table is not. Either file may be absent, or both. The source in use is parsed once.
    """
    lines = lambda path: logs.read_ordered_lines(spark, path)
    records = logs.first_nonempty(logs.parse_comma_log(lines(log_path)), logs.parse_report(lines(report_path))).persist()
    try:
        meta = metas.read_meta(spark, meta_path)
        order = [*logs.LOG_BLOCK, *logs.LOG_ORDER]
        runs = enriched_runs(records, meta, logs.LOG_ORDER, by or (), logs.LOG_BLOCK)
        csvs.write_csv(runs, runs_out, RUNS.fieldNames())
        csvs.write_csv(aggregate_rows(records, meta, by, order), agg_out, AGG.fieldNames(), skip_empty=True)
    finally:
        records.unpersist()


def collect_tables(
    spark: SparkSession, folder: str, out: str, name_glob: str = "*.csv", drop_duplicates: bool = False,
    path_pattern: str | None = None,
) -> DataFrame:
    """Collect all aggregate CSV files below ``folder`` into one CSV table.

    ``path_pattern`` tells them from other tables below the same folder. ``out`` must lie elsewhere, or a second
    collection would read the first one's result.
    """
    if f"{out.rstrip('/')}/".startswith(f"{folder.rstrip('/')}/"):
        raise ValueError(f"{out} lies below {folder}, which is read")
    dataset = collect_dataset(csvs.collect_csv(spark, folder, name_glob, AGG, path_pattern), drop_duplicates)
    csvs.write_csv(dataset, out)
    return dataset


class Baselines(NamedTuple):
    scores: DataFrame
    anneal_trace: DataFrame
    curve: DataFrame
    speedups: DataFrame


def train_baselines(
    runs: DataFrame, key: Sequence[str], draws: int = models.SEARCH_DRAWS, folds: int = models.SEARCH_FOLDS,
    steps: int = models.ANNEAL_STEPS, seed: int = 0, valid_percent: int = 25, **space: Sequence[Any],
) -> Baselines:
    """Constant median, searched forest and annealed forest on a run table, with their test metrics.

    ``key`` names the columns that identify a row. The annealed search is scored on a validation part of the
    train rows, never on the test rows. Speedups use the same target as the models; the base is the
    default row that comes first in a collection's order, the one with the lowest target.
    """
    data = features.regression_inputs(runs)
    rows = features.with_split(data.frame, key)
    encoded = features.fit_encoder(rows.where("part = 'train'"), data.numeric, data.categorical).transform(rows)
    encoded = encoded.select(*key, "part", "features", "label").persist()
    try:
        train, test = (encoded.where(F.col("part") == part) for part in ("train", "test"))
        searched = models.random_search(train, key, draws, folds, seed, **space)
        held_out = scalars.hash_bucket(features.row_key(*key, "label")) < valid_percent
        annealed = models.annealed_search(train, held_out, key, steps, seed, **space)
        predicted = lambda found, name: found.model.transform(test).select(F.lit(name).alias("model"), "label", "prediction")
        predictions = (
            models.constant_predictions(train, test)
            .unionByName(predicted(searched, "RandomSearch_RF"))
            .unionByName(predicted(annealed, "SimAnneal_RF"))
        )
        scores = runs.sparkSession.createDataFrame(
            metrics.error_metrics(predictions).collect(), "model STRING, MAE DOUBLE, RMSE DOUBLE, R2 DOUBLE, MAPE DOUBLE"
        )
        curve = models.learning_curve(train, test, key, searched.params, seed=seed)
    finally:
        encoded.unpersist()
    return Baselines(scores, annealed.trace, curve, speedup.top_speedups(data.frame, data.target, [data.target, *key]))
