"""Helpers that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.session import scratch_path
from tallyloom.sources.tables import table  # noqa: F401  used by the operators' queries

# The white space of the word definition: blank and the five controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

ROW = "_row"

BATCH_BYTES = 16 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_rows(docs: DataFrame, name: str = ROW) -> DataFrame:
    """Adds an integer that tells rows apart even if ids are null or repeated.

    It follows from the scan partition and the place in it, so two scans of the same stored table agree. So operators that
    number their rows take a table as it was stored, with no more than a projection on top; store other inputs first.
    """
    return docs.withColumn(name, F.monotonically_increasing_id())


def packed(docs: DataFrame) -> DataFrame:
    """Whole rows as one column ``doc`` beside ``_row``, so no column of theirs can clash with one of ours."""
    return docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias(ROW))


def bounded_batches(df: DataFrame) -> DataFrame:
    """Arrow batches to Python hold at most this many bytes, however long the texts are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Pure ASCII texts take the quick way."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Rows numbered from 0 in the order given, without bringing them together in one task.

    The rows are dealt by range and stored; only one count per partition is summed up.
    """
    part, place = "_part", "_place"
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(
        dealt.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()), "ranked"
    )
    before = F.sum("n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    offsets = kept.groupBy(part).agg(F.count("*").alias("n")).select(part, F.coalesce(before, F.lit(0)).alias("_before"))
    number = (F.col("_before") + F.col(place).bitwiseAND((1 << 33) - 1)).cast("long")
    # One row per partition: bounded by the number of shuffle partitions.
    return kept.join(F.broadcast(offsets), part).select(*df.columns, number.alias(rank))
