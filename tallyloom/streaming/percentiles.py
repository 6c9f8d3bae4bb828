"""Exact percentiles of an append-only log: counts of values in slots, extended by each batch.

A store has two tables. ``values`` holds, per batch and octave of the value, how often each value occurs; ``slots`` how
many values a slot holds, and its ends. A batch adds files to both and reads only its own lines. A rank is looked up in
the slots, and only octaves that hold a wanted rank are opened.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators.stats import SLOTS_PER_OCTAVE, measured, slot_of


def _octave(slot: Column) -> Column:
    return F.floor(slot / SLOTS_PER_OCTAVE).cast("int")


def add_batch(rows: DataFrame, number: int, store: str, value: str, by: Sequence[str]) -> None:
    """Add the values of a batch; adding the same batch again replaces it.

    The slots come last: a batch without them does not count, so a lost driver leaves no half of one.
    """
    number_of = measured(F.col(value))
    counted = (
        rows.select(*by, number_of.alias("_v")).where("_v IS NOT NULL")
        .groupBy(*by, "_v").agg(F.count("*").alias("c")).withColumn("slot", slot_of(F.col("_v")))
    )
    values = f"{store}/values/batch={number}"
    dealt = counted.withColumn("octave", _octave(F.col("slot"))).repartitionByRange("octave", "_v", *by)
    dealt.write.mode("overwrite").partitionBy("octave").parquet(values)
    added = rows.sparkSession.read.schema(counted.schema).parquet(values)
    slots = added.groupBy(*by, "slot").agg(F.sum("c").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    slots.write.mode("overwrite").parquet(f"{store}/slots/batch={number}")


def keep_percentiles(rows: DataFrame, store: str, checkpoint: str, value: str, by: Sequence[str]) -> StreamingQuery:
    """Bring a store up to date with a stream of records, then stop."""
    return (
        rows.writeStream.foreachBatch(lambda batch, number: add_batch(batch, number, store, value, by))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _cumulated(counts: DataFrame, by: Sequence[str], order: str) -> Callable[[Column], Column]:
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lambda start: start + F.coalesce(F.sum("c").over(before), F.lit(0))


def stored_percentiles(spark: SparkSession, store: str, percents: Mapping[str, float], by: Sequence[str]) -> DataFrame:
    """``n`` and the percentiles per group of all values added so far, interpolated at rank (n - 1) * p.

    Slots of one value answer without a look at the values. Of the others, octaves that hold no wanted rank are not read:
    the driver learns the wanted octaves, of which there are at most two per octave that a double can have.
    """
    by = list(by)
    slots = spark.read.parquet(f"{store}/slots")
    batches = [r.batch for r in slots.select("batch").distinct().collect()]  # those that are complete
    merged = slots.groupBy(*by, "slot").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    size = F.sum("c").over(Window.partitionBy(*by))
    merged = merged.select("*", _cumulated(merged, by, "slot")(F.lit(0)).alias("below"), size.alias("n"))
    position = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(position(p)), F.ceil(position(p))) for p in percents.values()])))
    inside = lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("c"))
    wanted = merged.where(F.exists(ranks, inside))
    known = wanted.where("lo = hi").select(*by, F.col("lo").alias("_v"), "n", "c", F.col("below").alias("first"))
    mixed = wanted.where("lo < hi").select(*by, "slot", "below", "n")
    octaves = [r[0] for r in mixed.select(_octave(F.col("slot"))).distinct().collect()]
    ranked = known
    if octaves:
        values = spark.read.parquet(f"{store}/values").where(F.col("octave").isin(octaves) & F.col("batch").isin(batches))
        same = [F.col(f"v.{c}").eqNullSafe(F.col(f"m.{c}")) for c in [*by, "slot"]]
        opened = values.alias("v").join(mixed.alias("m"), same).select("m.*", "v._v", "v.c")
        counted = opened.groupBy(*by, "slot", "below", "n", "_v").agg(F.sum("c").alias("c"))
        first = _cumulated(counted, [*by, "slot"], "_v")(F.col("below")).alias("first")
        ranked = known.unionByName(counted.select(*by, "_v", "n", "c", first))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("first")) & (rank < F.col("first") + F.col("c")), F.col("_v")))

    pieces = []
    for i, p in enumerate(percents.values()):
        pieces += [at(F.floor(position(p))).alias(f"_low{i}"), at(F.ceil(position(p))).alias(f"_high{i}")]
    found = ranked.groupBy(*by).agg(F.max("n").alias("n"), *pieces)
    columns = []
    for i, (name, p) in enumerate(percents.items()):
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        between = low + (high - low) * (position(p) - F.floor(position(p)))
        columns.append(F.when(low == high, low).otherwise(between).alias(name))
    return found.select(*by, "n", *columns)


def compact(spark: SparkSession, store: str, into: str, by: Sequence[str]) -> None:
    """Write a store anew as one batch under the number of its last one, so that many small batches become few files."""
    slots = spark.read.parquet(f"{store}/slots")
    batches = [r.batch for r in slots.select("batch").distinct().collect()]
    last = max(batches)
    values = spark.read.parquet(f"{store}/values").where(F.col("batch").isin(batches))
    merged = values.groupBy(*by, "octave", "slot", "_v").agg(F.sum("c").alias("c")).repartitionByRange("octave", "_v", *by)
    merged.write.partitionBy("octave").parquet(f"{into}/values/batch={last}")
    merged = slots.groupBy(*by, "slot").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    merged.write.parquet(f"{into}/slots/batch={last}")
