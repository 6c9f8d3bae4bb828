"""Order-dependent columns over groups of any size.

A plain window sorts a whole group in one task. Here the order is cut into blocks: a block is numbered or
scanned on its own, and a small table with one row per block carries the running total across blocks. The
result equals that of the plain window, which is used where the input is small enough for one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.session import cut_lineage, fits_one_task

def _keyed(df: DataFrame, by: Sequence[str], blocks: Sequence[str], order: Sequence[str], block_rows: int | None):
    if blocks:
        parts = [F.col(b) for b in blocks]
    else:
        # Dealt by range of group and order, so blocks hold about equally many rows whatever the type and the values
        # are, and there are no more of them than partitions. Stored: the bounds of a range may differ if drawn again.
        wanted = [-(-df.count() // block_rows)] if block_rows else []
        dealt = df.repartitionByRange(*wanted, *[F.col(c) for c in (*by, *order)])
        df = cut_lineage(dealt.withColumn("_block", F.spark_partition_id()))
        parts = [F.col("_block")]
    # One struct is the join key and the window partition at once, so the rows are shuffled a single time.
    # NULLs inside a struct compare equal, as grouping needs.
    key = F.struct(F.struct(F.lit(0).alias("_all"), *by).alias("group"), F.struct(*parts).alias("block"))
    return df.withColumn("_key", key)


def _carried(keyed: DataFrame, total: Column, combine) -> DataFrame:
    before = (
        Window.partitionBy("_key.group").orderBy("_key.block").rowsBetween(Window.unboundedPreceding, -1)
    )
    return keyed.groupBy("_key").agg(total.alias("_total")).select(
        "_key", combine(F.col("_total")).over(before).alias("_carry")
    )


def number_rows(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), blocks: Sequence[str] = (),
    out: str = "run_idx", block_rows: int | None = None, one_task: bool | None = None,
) -> DataFrame:
    """``row_number`` from 1 per group in the given order.

    ``order`` is unique per group and of any type that sorts. Its rows are dealt into blocks by range, of about
    ``block_rows`` rows or as many as there are shuffle partitions, unless ``blocks`` names columns that come before it
    in the order, such as file and offset.
    """
    if fits_one_task(df) if one_task is None else one_task:
        whole = Window.partitionBy(*by).orderBy(*blocks, *order)
        return df.withColumn(out, F.row_number().over(whole).cast("bigint"))
    keyed = _keyed(df, by, blocks, order, block_rows)
    carry = _carried(keyed, F.count("*"), F.sum)
    within = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    numbered = keyed.join(carry, "_key").withColumn(out, (within + F.coalesce("_carry", F.lit(0))).cast("bigint"))
    return numbered.select(*df.columns, out)


def running_min(
    df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), blocks: Sequence[str] = (),
    out: str = "best", block_rows: int | None = None, one_task: bool | None = None,
) -> DataFrame:
    """Smallest value so far per group, the row itself included."""
    if fits_one_task(df) if one_task is None else one_task:
        whole = Window.partitionBy(*by).orderBy(*blocks, *order)
        return df.withColumn(out, F.min(value).over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    keyed = _keyed(df, by, blocks, order, block_rows)
    carry = _carried(keyed, F.min(value), F.min)
    so_far = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = keyed.join(carry, "_key").withColumn(out, F.least(F.min(value).over(so_far), "_carry"))
    return scanned.select(*df.columns, out)


def running_sums(
    df: DataFrame, values: dict[str, str], order: Sequence[str], by: Sequence[str] = (), blocks: Sequence[str] = (),
    block_rows: int | None = None, one_task: bool | None = None,
) -> DataFrame:
    """For each ``out: value`` the sum so far per group, the row itself included."""
    if fits_one_task(df) if one_task is None else one_task:
        so_far = Window.partitionBy(*by).orderBy(*blocks, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(value).over(so_far).alias(out) for out, value in values.items()])
    keyed = _keyed(df, by, blocks, order, block_rows)
    before = Window.partitionBy("_key.group").orderBy("_key.block").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy("_key").agg(*[F.sum(value).alias(out) for out, value in values.items()])
    carry = totals.select("_key", *[F.coalesce(F.sum(out).over(before), F.lit(0)).alias(f"_carry_{out}") for out in values])
    so_far = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = [(F.sum(value).over(so_far) + F.col(f"_carry_{out}")).alias(out) for out, value in values.items()]
    return keyed.join(carry, "_key").select(*df.columns, *summed)


def last_record(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Last row per group: an aggregate with map-side combine, not a window."""
    picked = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*by).agg(picked).where("_row IS NOT NULL").select("_row.*")


def head(df: DataFrame, order: Sequence[str], k: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(k)


def tail(df: DataFrame, order: Sequence[str], k: int = 5) -> DataFrame:
    """Last ``k`` rows, in ascending order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(k).orderBy(*order)
