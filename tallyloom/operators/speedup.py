"""Speedups of configurations over the default one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.scalars import config_label, speedup


def baseline(configs: DataFrame, value: str = "median_sec", order: Sequence[str] = ("source_file",)) -> DataFrame:
    """One row: the value of the first configuration flagged as default, NULL if none is."""
    flagged = configs.where("is_default = 1")
    return flagged.agg(F.min_by(F.struct(F.col(value).cast("double").alias("base")), F.struct(*order)).alias("_b")).select(
        F.col("_b.base").alias("base")
    )


def with_speedup(configs: DataFrame, value: str = "median_sec", order: Sequence[str] = ("source_file",)) -> DataFrame:
    """Add ``speedup`` = default value / own value. The default value is a one-row subquery.

    Without a default configuration there is no speedup to report and the result is empty.
    """
    base = baseline(configs, value, order).scalar()
    return configs.withColumn("_base", base).where("_base IS NOT NULL").withColumn(
        "speedup", speedup(F.col("_base"), F.col(value).cast("double"))
    ).drop("_base")


def top_speedups(
    configs: DataFrame, value: str = "median_sec", order: Sequence[str] = ("source_file",), k: int = 20
) -> DataFrame:
    """The ``k`` fastest configurations with a short label."""
    ranked = with_speedup(configs, value, order).orderBy(F.desc_nulls_last("speedup"), *order).limit(k)
    return ranked.withColumn(
        "label",
        config_label(*[F.col(c) for c in (
            "executors", "executor_cores", "executor_memory_gb", "parallelism", "shuffle_partitions"
        )]),
    )
