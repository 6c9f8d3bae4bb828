"""Run metadata: one flat JSON object per measured configuration."""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions.scalars import submit_options
from tallyloom.schemas import META

# Knobs of a run when nothing else is given.
DEFAULT_KNOBS = {
    "benchmark": "wordcount", "engine": "spark", "scale": "tiny", "input_gb": 1, "runs": 9, "is_default": 0,
    "executors": 2, "executor_cores": 1, "executor_memory_gb": 2, "driver_cores": 1, "driver_memory_gb": 1,
    "parallelism": 8, "shuffle_partitions": 8, "rdd_compress": "true", "io_compression_codec": "lz4",
}


def build_meta(spark: SparkSession, **knobs: Any) -> DataFrame:
    """One-row metadata frame with the submit options assembled from the knobs."""
    values = {**DEFAULT_KNOBS, **knobs}
    columns = {f.name: F.lit(values[f.name]).cast(f.dataType) for f in META if f.name in values}
    columns["spark_conf"] = submit_options(columns)
    return spark.range(1).select(*[columns[name].alias(name) for name in META.fieldNames()])


def write_meta(meta: DataFrame, path: str) -> None:
    meta.write.mode("overwrite").json(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Metadata row; a missing file gives no row and broken JSON gives NULL fields."""
    try:
        found = spark.read.schema(META).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], META)
    return found


def meta_value(meta: DataFrame, key: str, default: Any) -> DataFrame:
    """The value of one key, or the default if the row or the key is missing: always one row."""
    return meta.agg(F.coalesce(F.max(key), F.lit(default)).alias(key))
