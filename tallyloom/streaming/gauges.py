"""Tumbling rollup of gauge samples, the same code for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

# Fixed value: the sampling interval.
WIDTH = "5 seconds"


def gauge_rollup(
    gauges: DataFrame, source: str = "source", ts: str = "ts", value: str = "value", width: str = WIDTH,
    late: str | None = None,
) -> DataFrame:
    """Samples, mean and maximum per source and window. ``late`` sets the watermark of a stream.

    A watermark needs a timestamp with time zone, so the column is read in the session's zone then.
    """
    samples = gauges.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if late else gauges
    return (
        samples.groupBy(F.window(ts, width), F.col(source).alias("source"))
        .agg(F.count("*").alias("n"), F.avg(value).alias("avg_value"), F.max(value).alias("max_value"))
        .select(F.col("window.start").alias("window_start"), "source", "n", "avg_value", "max_value")
    )


def store_rollup(rollup: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to a Parquet table; state and offsets live in ``checkpoint``."""
    return (
        rollup.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Windows that a stopped stream of ``store_rollup`` still holds open, from its state.

    Together with the stored windows they are all windows of the samples that were not too late: a window leaves the state
    when the watermark closes it, in the batch that stores it.
    """
    state = spark.read.format("statestore").load(checkpoint)
    largest = state.schema["value"].dataType[3].dataType.simpleString()
    # The state of count, mean and maximum, by place: two of its fields have the same name.
    held = F.col("value").cast(f"struct<n: bigint, total: double, counted: bigint, max_value: {largest}>")
    return state.select(F.col("key.window.start").alias("window_start"), F.col("key.source").alias("source"), held.alias("held")).select(
        "window_start", "source", "held.n", (F.col("held.total") / F.nullif("held.counted", F.lit(0))).alias("avg_value"), "held.max_value"
    )


def all_windows(spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """Stored windows and those still open, told apart by ``open``."""
    closed = spark.read.parquet(path).withColumn("open", F.lit(False))
    return closed.unionByName(open_windows(spark, checkpoint).withColumn("open", F.lit(True)))
