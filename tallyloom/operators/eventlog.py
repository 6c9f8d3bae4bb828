"""Rollups of finished tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyloom.operators.stats import grouped_summary


def stage_rollup(tasks: DataFrame, by: Sequence[str] = (), one_task: bool | None = None) -> DataFrame:
    """Per stage: number of tasks, median and longest task, shuffle and spill bytes."""
    keys = [*by, "stage_id", "attempt"]
    sums = [F.sum(c).alias(c) for c in ("shuffle_write_bytes", "shuffle_read_bytes", "spill_bytes")]
    plain = [F.count("*").alias("tasks"), F.max("task_ms").alias("max_task_ms"), *sums]
    return grouped_summary(tasks, keys, plain, "task_ms", {"p50_task_ms": 0.5}, one_task)
