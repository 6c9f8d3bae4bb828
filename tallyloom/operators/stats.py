"""Summary statistics of durations: exact median and interpolated percentiles for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom import session
from tallyloom.functions.scalars import round3
from tallyloom.session import cut_lineage, fits_one_task, settled

# The reported percentiles.
PERCENTS = {"p50_sec": 0.50, "p90_sec": 0.90, "p99_sec": 0.99}

# First slots: a sixteenth of an octave each, over all magnitudes a double can have.
SLOTS_PER_OCTAVE = 16
OCTAVES = 1080.0

# Later slots: a slot with more rows than one task should sort is cut into so many parts.
PARTS = 4096
SLOT_ROWS = 500_000


def measured(value: Column) -> Column:
    """The number if it is finite, else NULL: neither NaN nor an infinity is a measurement."""
    number = value.cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def slot_of(value: Column) -> Column:
    """Monotone map of a finite number to a slot; zero has one of its own."""
    size = F.floor((F.log2(F.abs(value)) + OCTAVES) * SLOTS_PER_OCTAVE) + 1
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("bigint") * size).cast("bigint")


def _ranks(n: Column, p: float) -> tuple[Column, Column]:
    low = F.floor((n - 1) * F.lit(float(p)))
    return low, F.least(low + 1, n - 1)


def _holds(wanted: Column) -> Column:
    return F.exists(wanted, lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("c")))


def _small(df: DataFrame, cut: DataFrame) -> DataFrame:
    """Marks ``cut`` for broadcast if it has few rows; beyond the limit the join shuffles."""
    return F.broadcast(cut) if cut.count() <= session.BROADCAST_ROWS else cut


def exact_percentiles(
    df: DataFrame, value: str, percents: Mapping[str, float], by: Sequence[str] = (), one_task: bool | None = None
) -> DataFrame:
    """Exact percentiles of the finite values per group, interpolated linearly at rank (n - 1) * p.

    Inputs of few rows use the built-in aggregate, which holds the distinct values of a group in one task. Larger
    ones never do: (1) a histogram of value slots, combined map-side, tells which slot holds each wanted rank; (2) a
    slot with too many rows is cut between its least and its largest value, again and again, until its rows fit one
    task or are all equal; (3) only the rows of the slots left are ranked, after equal values have been merged. Both
    ways give the same numbers.
    """
    names = list(percents)
    data = df.select(*by, measured(F.col(value)).alias("_v")).where("_v IS NOT NULL")
    if one_task is None:
        data = settled(data)
    if fits_one_task(data, session.PERCENTILE_ROWS) if one_task is None else one_task:
        found = F.percentile("_v", [float(p) for p in percents.values()]).alias("_p")
        return data.groupBy(*by).agg(found).select(
            *by, *[F.get("_p", F.lit(i)).alias(name) for i, name in enumerate(names)]
        )

    group = F.struct(F.lit(0).alias("_all"), *by)
    slotted = data.select(F.struct(group.alias("group"), slot_of(F.col("_v")).alias("slot")).alias("_key"), "_v")
    per_group = Window.partitionBy("_key.group")
    before = per_group.orderBy("_key.slot").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(*[r for p in percents.values() for r in _ranks(F.col("n"), p)])
    summary = [F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi")]
    slots = cut_lineage(
        slotted.groupBy("_key").agg(*summary)
        .select(
            "_key", "c", "lo", "hi", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("below"),
            F.sum("c").over(per_group).alias("n"),
        )
        .where(_holds(wanted))
    )
    ready = []
    while True:
        coarse = slots.where((F.col("c") > SLOT_ROWS) & (F.col("lo") < F.col("hi")))
        ready.append(slots.where((F.col("c") <= SLOT_ROWS) | (F.col("lo") == F.col("hi"))))
        if coarse.isEmpty():
            break
        slots = _finer(slotted, coarse, wanted, summary)
    slots = reduce(DataFrame.unionByName, ready)

    # A slot of equal values is known without looking at its rows again.
    known = slots.where("lo = hi").select("_key", F.col("lo").alias("_v"), "n", "c", F.col("below").alias("first"))
    rest = slots.where("lo < hi").select("_key", "lo", "hi", "below", "n")
    inside = slotted.join(_small(slotted, rest), "_key").where("_v BETWEEN lo AND hi")
    counted = inside.groupBy("_key", "lo", "below", "n", "_v").agg(F.count("*").alias("c"))
    same_slot = Window.partitionBy("_key", "lo").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("below") + F.coalesce(F.sum("c").over(same_slot), F.lit(0))
    ranked = counted.select("_key", "_v", "n", "c", first.alias("first")).unionByName(known)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("first")) & (rank < F.col("first") + F.col("c")), F.col("_v")))

    pieces = []
    for i, p in enumerate(percents.values()):
        low, high = _ranks(F.col("n"), p)
        pieces += [at(low).alias(f"_low{i}"), at(high).alias(f"_high{i}")]
    found = ranked.groupBy(F.col("_key.group").alias("group")).agg(F.max("n").alias("n"), *pieces)
    columns = []
    for i, (name, p) in enumerate(percents.items()):
        position = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        between = low + (high - low) * (position - F.floor(position))
        columns.append(F.when(low == high, low).otherwise(between).alias(name))
    return found.select(*[F.col("group").getField(c).alias(c) for c in by], *columns)


def _finer(slotted: DataFrame, coarse: DataFrame, wanted: Column, summary: list[Column]) -> DataFrame:
    """The parts of too large slots that hold a wanted rank. A part's ends are values that occur, so a slot with more
    than one value always splits."""
    outer = coarse.select("_key", F.col("lo").alias("from"), F.col("hi").alias("to"), F.col("below").alias("base"), "n")
    inside = slotted.join(_small(slotted, outer), "_key").where("_v BETWEEN `from` AND `to`")
    # Halves first: the width of a slot may exceed the largest double.
    share = (F.col("_v") / 2 - F.col("from") / 2) / (F.col("to") / 2 - F.col("from") / 2)
    part = F.when(F.col("_v") == F.col("to"), F.lit(PARTS)).otherwise(F.floor(share * PARTS)).cast("int")
    parts = inside.groupBy("_key", "from", "base", "n", part.alias("part")).agg(*summary)
    below = Window.partitionBy("_key", "from").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("c").over(below), F.lit(0))
    return cut_lineage(parts.select("_key", "c", "lo", "hi", start.alias("below"), "n").where(_holds(wanted)))


def grouped_summary(
    df: DataFrame, by: Sequence[str], aggregates: Sequence[Column], value: str, percents: Mapping[str, float],
    one_task: bool | None = None,
) -> DataFrame:
    """Plain aggregates and exact percentiles of one value column, per group.

    ``value`` is cleaned first, so the aggregates see NULL where it is not finite, in both forms.
    """
    by = list(by)
    if one_task is None:
        df = settled(df)
    small = fits_one_task(df, session.PERCENTILE_ROWS) if one_task is None else one_task
    if df.schema[value].dataType.typeName() in ("double", "float"):  # other types have no such values and stay as they are
        df = df.withColumn(value, measured(F.col(value)))
    if small:
        found = F.percentile(value, list(percents.values())).alias("_p")
        summary = df.groupBy(*by).agg(*aggregates, found)
        cuts = [F.get("_p", F.lit(i)).alias(name) for i, name in enumerate(percents)]
        return summary.select("*", *cuts).drop("_p")
    plain = df.groupBy(*by).agg(*aggregates)
    cuts = exact_percentiles(df, value, percents, by, one_task=False)
    if not by:
        return plain.select("*", *[cuts.select(name).scalar().alias(name) for name in percents])
    same = [F.col(f"plain.{k}").eqNullSafe(F.col(f"cuts.{k}")) for k in by]
    return plain.alias("plain").join(cuts.alias("cuts"), same, "left").select(
        "plain.*", *[F.col(f"cuts.{name}") for name in percents]
    )


def run_stats(
    runs: DataFrame, by: Sequence[str] = ("benchmark", "engine", "scale"), value: str = "duration_sec",
    one_task: bool | None = None,
) -> DataFrame:
    """n, mean, median, p50, p90, p99 and population deviation per group, rounded to milliseconds.

    The deviation of a single run is 0.
    """
    moments = [F.count(value).alias("n"), F.avg(value).alias("mean_sec"), F.stddev_pop(value).alias("std_sec")]
    stats = grouped_summary(runs, by, moments, value, PERCENTS, one_task).where("n > 0")
    seconds = [round3(F.col(name)).alias(name) for name in ("p50_sec", "p90_sec", "p99_sec", "std_sec")]
    return stats.select(
        *by, "n", round3(F.col("mean_sec")).alias("mean_sec"), round3(F.col("p50_sec")).alias("median_sec"), *seconds
    )


def first_values(runs: DataFrame, columns: Sequence[str], order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Values of the first record in the given order."""
    picked = F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")
    return runs.groupBy(*by).agg(picked).select(*by, "_first.*")


def log_stats(runs: DataFrame, order: Sequence[str], value: str = "duration_sec") -> DataFrame:
    """Statistics of a whole log as one row, labelled by its first record; no row for an empty log."""
    labels = first_values(runs, ["benchmark", "engine", "scale"], order)
    stats = run_stats(runs, (), value)
    label = labels.select(F.struct("*").alias("label")).scalar()
    return stats.withColumn("_label", label).select("_label.*", *stats.columns)
