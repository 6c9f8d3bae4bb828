"""Union of differently shaped tables and best row per configuration."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.schemas import CONFIG_KEYS


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames; a column that a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def best_per_key(
    df: DataFrame, keys: Sequence[str] = CONFIG_KEYS, score: str = "median_sec", ties: Sequence[str] = ("source_file",)
) -> DataFrame:
    """Row with the lowest score per key, ties broken by further columns; a missing score comes last.

    Spark limits each key to its best row per task before the shuffle (WindowGroupLimit), so a key with very
    many rows costs one row per task.
    """
    order = [F.asc_nulls_last(c) for c in (score, *ties)]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def collect_dataset(
    tables: DataFrame, drop_duplicates: bool = False, keys: Sequence[str] = CONFIG_KEYS,
    score: str = "median_sec", ties: Sequence[str] = ("source_file",),
) -> DataFrame:
    """The collected rows; with ``drop_duplicates`` one row per configuration, sorted by score."""
    if not drop_duplicates:
        return tables
    best = best_per_key(tables, keys, score, ties)
    return best.orderBy(*[F.asc_nulls_last(c) for c in (score, *ties)])


def source_counts(collected: DataFrame) -> DataFrame:
    """Number of rows and of source files."""
    per_file = collected.groupBy("source_file").agg(F.count("*").alias("n"))
    return per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("source_file").alias("files"))
