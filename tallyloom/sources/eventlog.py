"""Spark event logs as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Event names and the fields read from them.
TASK_END = "SparkListenerTaskEnd"
APP_START = "SparkListenerApplicationStart"
APP_END = "SparkListenerApplicationEnd"
APP_IN_PATH = r"((?:app|application|local)-?_?\d+[-_]\d+)"
TASK_DDL = """
    Event STRING,
    `Stage ID` INT, `Stage Attempt ID` INT,
    `Task Info` STRUCT<`Task ID`: BIGINT, `Launch Time`: BIGINT, `Finish Time`: BIGINT>,
    `Task Metrics` STRUCT<
        `Memory Bytes Spilled`: BIGINT, `Disk Bytes Spilled`: BIGINT,
        `Shuffle Read Metrics`: STRUCT<`Remote Bytes Read`: BIGINT, `Local Bytes Read`: BIGINT>,
        `Shuffle Write Metrics`: STRUCT<`Shuffle Bytes Written`: BIGINT>>
"""
APP_DDL = "Event STRING, `App ID` STRING, Timestamp BIGINT"


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """``log_file, app, value``: event lines of one or many logs, rolled folders and compressed files included.

    ``app`` is the application id in the file's path, or else the file itself, so that rollups keep logs apart.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    file = F.col("_metadata.file_path")
    app = F.nullif(F.regexp_extract(file, APP_IN_PATH, 1), F.lit(""))
    return lines.select(file.alias("log_file"), F.coalesce(app, file).alias("app"), "value")


def _mentions(*names: str) -> Column:
    """Cheap test before a line is parsed: the name occurs anywhere. The parsed event decides."""
    return reduce(Column.__or__, [F.contains(F.col("value"), F.lit(name)) for name in names])


def task_table(lines: DataFrame) -> DataFrame:
    """One row per finished task: stage, duration, shuffle and spill bytes."""
    kept = [c for c in lines.columns if c != "value"]
    event = F.from_json("value", TASK_DDL)
    metrics = "e.`Task Metrics`"
    zero = lambda name: F.coalesce(F.col(name), F.lit(0).cast("bigint"))
    return (
        lines.where(_mentions(TASK_END)).select(*kept, event.alias("e")).where(F.col("e.Event") == TASK_END)
        .select(
            *kept,
            F.col("e.`Stage ID`").alias("stage_id"),
            F.col("e.`Stage Attempt ID`").alias("attempt"),
            F.col("e.`Task Info`.`Task ID`").alias("task_id"),
            (F.col("e.`Task Info`.`Finish Time`") - F.col("e.`Task Info`.`Launch Time`")).alias("task_ms"),
            zero(f"{metrics}.`Shuffle Write Metrics`.`Shuffle Bytes Written`").alias("shuffle_write_bytes"),
            (
                zero(f"{metrics}.`Shuffle Read Metrics`.`Remote Bytes Read`")
                + zero(f"{metrics}.`Shuffle Read Metrics`.`Local Bytes Read`")
            ).alias("shuffle_read_bytes"),
            (zero(f"{metrics}.`Memory Bytes Spilled`") + zero(f"{metrics}.`Disk Bytes Spilled`")).alias("spill_bytes"),
        )
    )


def app_durations(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Seconds between application start and end, per log."""
    event = F.from_json("value", APP_DDL)
    at = lambda name: F.when(F.col("e.Event") == name, F.col("e.Timestamp"))
    return (
        lines.where(_mentions(APP_START, APP_END)).select(*by, event.alias("e"))
        .where(F.col("e.Event").isin(APP_START, APP_END)).groupBy(*by)
        .agg(((F.max(at(APP_END)) - F.min(at(APP_START))) / 1000.0).alias("app_sec"))
    )
