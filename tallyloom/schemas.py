"""Declared schemas and column orders of the run tables."""

from pyspark.sql import types as T

_TYPES = {"text": T.StringType(), "int": T.IntegerType(), "count": T.LongType(), "sec": T.DoubleType()}


def _schema(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields.items()])


# Column names, order and types of the exchanged tables.
META = _schema(
    benchmark="text", engine="text", scale="text", input_gb="int", runs="int", is_default="int",
    executors="int", executor_cores="int", executor_memory_gb="int", driver_cores="int", driver_memory_gb="int",
    parallelism="int", shuffle_partitions="int", rdd_compress="text", io_compression_codec="text", spark_conf="text",
)
RUNS = _schema(
    benchmark="text", engine="text", scale="text", run_idx="int", duration_sec="sec",
    executors="int", executor_cores="int", executor_memory_gb="int", driver_cores="int", driver_memory_gb="int",
    parallelism="int", shuffle_partitions="int", rdd_compress="text", io_compression_codec="text", input_gb="int",
    is_default="int", spark_conf="text",
)
AGG = _schema(
    benchmark="text", engine="text", scale="text", n="count", mean_sec="sec", median_sec="sec",
    p50_sec="sec", p90_sec="sec", p99_sec="sec", std_sec="sec",
    executors="int", executor_cores="int", executor_memory_gb="int", driver_cores="int", driver_memory_gb="int",
    parallelism="int", shuffle_partitions="int", rdd_compress="text", io_compression_codec="text", input_gb="int",
    is_default="int",
)
CONFIG_KEYS = [
    "executors", "executor_cores", "executor_memory_gb", "driver_cores", "driver_memory_gb",
    "parallelism", "shuffle_partitions", "rdd_compress", "io_compression_codec", "input_gb", "scale",
]
FEATURES = [
    "executors", "executor_cores", "executor_memory_gb", "driver_cores", "driver_memory_gb",
    "parallelism", "shuffle_partitions", "rdd_compress", "io_compression_codec", "input_gb",
]
CATEGORICAL = ["io_compression_codec"]
TARGETS = ["median_sec", "duration_sec"]
METRICS = ["MAE", "RMSE", "R2", "MAPE"]

# Metadata columns that are attached to every run and to every aggregate row.
RUN_META = RUNS.fieldNames()[5:]
AGG_META = AGG.fieldNames()[10:]
