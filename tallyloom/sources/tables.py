"""Parquet tables by name."""

from pyspark.sql import DataFrame, SparkSession

from tallyloom.session import spread_small_scan


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# Columns that spread the rows of a table evenly.
SPREAD_KEYS = {
    "events": "event_id", "documents": "doc_id", "orders": "o_orderkey", "part": "p_partkey",
    "lineitem": "l_orderkey", "conversations": "conv_id",
}


def balanced_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table dealt out to all cores if it is small; for queries with much work per row."""
    return spread_small_scan(table(spark, folder, name), SPREAD_KEYS[name])
