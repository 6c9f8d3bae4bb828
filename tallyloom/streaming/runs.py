"""Incremental ingest of run logs that are still being written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.sources.logs import parse_comma_log


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New comma log lines of a folder, parsed to run records."""
    return parse_comma_log(spark.readStream.text(folder))


def running_stats(records: DataFrame, by: Sequence[str] = ("benchmark", "engine", "scale")) -> DataFrame:
    """Count, mean, extremes and deviation per configuration, for batch or (complete mode) stream.

    The state is a few numbers per configuration, merged with those of each batch. Exact percentiles would need every
    value in the state; ``streaming.percentiles`` keeps them in a table of counts instead.
    """
    value = "duration_sec"
    return records.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean_sec"), F.min(value).alias("min_sec"),
        F.max(value).alias("max_sec"), F.stddev_pop(value).alias("std_sec"),
    )


def ingest_log(spark: SparkSession, folder: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Append the records of all lines not seen before to a Parquet table, exactly once, then stop."""
    return (
        log_stream(spark, folder).writeStream.outputMode("append").format("parquet").option("path", table_path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


RUN_KEYS = ("benchmark", "engine", "scale")


def keep_stats(
    spark: SparkSession, folder: str, path: str, checkpoint: str, by: Sequence[str] = RUN_KEYS,
) -> StreamingQuery:
    """Bring the stored statistics up to date with the files that are new in ``folder``, then stop.

    Count, mean, squared deviations and extremes of each configuration are the state of the stream, so lines of earlier
    files are not read again. A batch writes the configurations that it changed to a folder of its own, which a repeated
    batch replaces.
    """
    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        running_stats(log_stream(spark, folder), by).writeStream.outputMode("update").foreachBatch(changed)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stored_stats(spark: SparkSession, path: str, by: Sequence[str] = RUN_KEYS) -> DataFrame:
    """The latest statistics of each configuration."""
    rows = spark.read.parquet(path)
    latest = Window.partitionBy(*by).orderBy(F.desc("batch"))
    return rows.withColumn("_age", F.row_number().over(latest)).where("_age = 1").drop("_age", "batch")
