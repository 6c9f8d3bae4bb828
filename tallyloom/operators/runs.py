"""Run tables: metadata attached to records, run numbers, aggregate rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.scalars import round3
from tallyloom.operators.ordered import number_rows
from tallyloom.operators.stats import log_stats, run_stats
from tallyloom.schemas import AGG, AGG_META, RUN_META, RUNS


def attach_meta(rows: DataFrame, meta: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Put the fields of the single metadata row on every row; all NULL without metadata, ``is_default`` then 0.

    The metadata row is a one-row subquery, so more than one row is an error and nothing is joined.
    """
    row = meta.select(F.struct(*fields).alias("m")).scalar()
    columns = [F.col(f"_meta.{name}").alias(name) for name in fields if name != "is_default"]
    if "is_default" in fields:
        columns.append(F.coalesce(F.col("_meta.is_default"), F.lit(0)).alias("is_default"))
    return rows.withColumn("_meta", row).select(*rows.columns, *columns)


def enriched_runs(
    records: DataFrame, meta: DataFrame, order: Sequence[str], by: Sequence[str] = (), blocks: Sequence[str] = ()
) -> DataFrame:
    """Runs table: records numbered in log order, rounded to milliseconds, with their metadata.

    ``by`` restarts the numbering per group; by default it runs over the whole log.
    """
    numbered = number_rows(records, order, by, blocks)
    shaped = numbered.select(
        "benchmark", "engine", "scale", F.col("run_idx").cast("int").alias("run_idx"),
        round3(F.col("duration_sec")).alias("duration_sec"),
    )
    return attach_meta(shaped, meta, RUN_META).select(*RUNS.fieldNames())


def aggregate_rows(
    records: DataFrame, meta: DataFrame, by: Sequence[str] | None = ("benchmark", "engine", "scale"),
    order: Sequence[str] = (),
) -> DataFrame:
    """Aggregate table: statistics with metadata, per label or, with ``by=None``, one row for the whole log."""
    stats = log_stats(records, order) if by is None else run_stats(records, by)
    return attach_meta(stats, meta, AGG_META).select(*AGG.fieldNames())
