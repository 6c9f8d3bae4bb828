"""Incremental collection of CSV tables: only new files are read, and only the touched part of the best rows is rewritten."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators.collect import best_per_key
from tallyloom.schemas import AGG, CONFIG_KEYS
from tallyloom.session import stored
from tallyloom.sources import csvs

# The best rows are kept in so many parts by hash of the configuration; a batch rewrites the parts that its rows fall into.
BUCKETS = 64


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _latest(spark: SparkSession, store: str, before: int | None = None) -> DataFrame | None:
    """The newest version of each part of the best rows, or None before the first batch."""
    try:
        rows = spark.read.option("mergeSchema", True).parquet(f"{store}/best")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    rows = rows if before is None else rows.where(F.col("version") < before)
    newest: dict[int, list[int]] = {}
    for r in rows.groupBy("bucket").agg(F.max("version").alias("version")).collect():  # at most BUCKETS rows
        newest.setdefault(r.version, []).append(r.bucket)
    if not newest:
        return None
    parts = [(F.col("version") == v) & F.col("bucket").isin(buckets) for v, buckets in newest.items()]
    return rows.where(reduce(Column.__or__, parts)).drop("version")


def merge_rows(
    rows: DataFrame, number: int, store: str, keys: Sequence[str] = CONFIG_KEYS, score: str = "median_sec",
    ties: Sequence[str] = ("source_file",), known: T.StructType = AGG,
) -> None:
    """Add collected rows to a store under the batch's number; adding the same batch again replaces it.

    ``rows`` holds all rows of all batches, ``best`` per configuration the one with the lowest score, see
    ``operators.collect.best_per_key``. Columns that rows lack are NULL, of their type in ``known``.
    """
    types = {f.name: f.dataType for f in known}
    lacking = [c for c in dict.fromkeys([*keys, score, *ties]) if c not in rows.columns]
    rows = rows.select("*", *[F.lit(None).cast(types.get(c, T.StringType())).alias(c) for c in lacking])
    rows.write.mode("overwrite").parquet(f"{store}/rows/batch={number}")
    rows = rows.sparkSession.read.schema(rows.schema).parquet(f"{store}/rows/batch={number}")
    best = stored(best_per_key(rows, keys, score, ties).withColumn("bucket", _bucket(keys)), "best")
    before = _latest(rows.sparkSession, store, number)
    if before is not None:
        touched = [r.bucket for r in best.select("bucket").distinct().collect()]
        both = before.where(F.col("bucket").isin(touched)).unionByName(best, allowMissingColumns=True)
        best = best_per_key(both, keys, score, ties)
    # One file per part, so that versions stay few files.
    best.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/best/version={number}")


def keep_collection(
    spark: SparkSession, folder: str, store: str, checkpoint: str, name_glob: str = "*.csv", path_pattern: str | None = None,
    known: T.StructType = AGG, keys: Sequence[str] = CONFIG_KEYS, score: str = "median_sec", ties: Sequence[str] = ("source_file",),
) -> StreamingQuery:
    """Bring a store up to date with the CSV files that are new below ``folder``, then stop.

    The list of files taken is the stream's own, in ``checkpoint``. Lines are stored first, so a file is read once.
    """
    def take(batch: DataFrame, number: int) -> None:
        lines = stored(batch.withColumn("row", F.monotonically_increasing_id()), "lines")
        table = csvs.table_of_lines(lines, known)
        if len(table.columns) > 1 and not lines.isEmpty():
            merge_rows(table, number, store, keys, score, ties, known)

    return (
        csvs.line_stream(spark, folder, name_glob, path_pattern).writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def collected_rows(spark: SparkSession, store: str) -> DataFrame:
    """All rows collected so far; a column that a batch lacks is NULL there."""
    return spark.read.option("mergeSchema", True).parquet(f"{store}/rows").drop("batch")


def best_rows(spark: SparkSession, store: str, score: str = "median_sec", ties: Sequence[str] = ("source_file",)) -> DataFrame:
    """The best row of each configuration, sorted by score."""
    rows = _latest(spark, store)
    if rows is None:
        raise ValueError(f"nothing has been collected in {store}")
    return rows.drop("bucket").orderBy(*[F.asc_nulls_last(c) for c in (score, *ties)])
