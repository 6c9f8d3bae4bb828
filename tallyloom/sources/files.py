"""File listings: sizes come from the file index, no content is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def list_files(spark: SparkSession, folder: str, name_glob: str = "*") -> DataFrame:
    """One row per file below ``folder``: path and bytes."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", name_glob).load(folder)
        .select(F.col("path").alias("source_file"), F.col("length").alias("bytes"))
    )


def input_size(spark: SparkSession, folder: str, name_glob: str = "*") -> DataFrame:
    return list_files(spark, folder, name_glob).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    )
