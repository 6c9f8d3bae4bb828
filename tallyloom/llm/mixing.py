"""Mixing sources to target weights: hash-random keys, prefix sums by key range, exact budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.llm.common import ROW, n_words, packed, ranked, stored, with_rows

# Weights in the order of the sources' names, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2

# A source's keys are cut into so many ranges that one holds about this many of its rows.
RANGE_ROWS = 20_000
LEAST_BITS = 8


@dataclass(frozen=True)
class Mix:
    """``rows``: ``_row, doc_id, source, size, key``; ``sources``: one row per source with its budget and cut;
    ``cut``: ``_row, extra`` for the rows in the range where a source's budget ends."""

    rows: DataFrame
    sources: DataFrame
    cut: DataFrame
    bits: int


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "source", "size")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size`` with ``rank, target``: ``share`` of all sizes by weight, at most ``most`` times a size.

    What a full source leaves is shared out again by weight. With one unit of weight worth ``unit``, a source is full
    if weight * unit exceeds its limit; ``unit`` rises until no further source fills up.
    """
    named = ranked(sizes, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    limits = stored(named.withColumn("weight", weight).withColumn("most", F.lit(float(most)) * F.col("source_size")), "sources")
    total = limits.agg(F.sum("source_size")).first()[0] or 0
    unit, full = 0.0, -1
    while True:
        is_full = F.col("weight") * unit >= F.col("most")
        now, taken, open_weight = limits.agg(
            F.count_if(is_full), F.sum(F.when(is_full, F.col("most"))), F.sum(F.when(~is_full, F.col("weight")))
        ).first()
        if now == full or not open_weight:
            break
        full, unit = now, (share * total - (taken or 0.0)) / open_weight
    return limits.select("source", "source_size", "rank", F.least(F.col("weight") * unit, F.col("most")).alias("target"))


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> Mix:
    """How often each row is taken. A source's budget is its target without fraction.

    Whole epochs are taken first. For the rest, rows are ordered by a hash of id, source and size. Sums per key range,
    added up over the ranges of a source, tell the range where the budget ends; only the rows of that range are ordered
    one by one (ties by doc_id, then place in the table). So a source with a third of all rows is never in one task.
    Texts may be null or empty (size 0), ids null or repeated, sources null; an empty table gives empty tables.
    """
    rows = with_rows(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    rows = stored(rows.withColumn("key", _key(seed)), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    bits = max(LEAST_BITS, (largest // RANGE_ROWS).bit_length())
    targets = source_targets(sizes.drop("n"), weights, share, most)
    budget = F.floor("target").cast("long")
    epochs = F.coalesce(F.floor(F.try_divide(budget, F.col("source_size"))).cast("long"), F.lit(0))
    sources = targets.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    sums = rows.groupBy("source", _range(bits).alias("range")).agg(F.sum("size").alias("range_size"))
    upto = F.sum("range_size").over(W.partitionBy("source").orderBy("range"))
    sums = sums.withColumn("before", upto - F.col("range_size"))
    near = sums.alias("s").join(sources.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    ends = near.where("before < rest and rest <= before + range_size").select(
        F.col("t.rank").alias("_rank"), F.col("range").alias("cut_range"), "before"
    )
    sources = stored(
        sources.join(ends, F.col("rank") == F.col("_rank"), "left").select(
            "source", "source_size", "target", "rank", "epochs", "rest",
            F.coalesce("cut_range", F.lit(-1)).alias("cut_range"), F.coalesce("before", F.lit(0)).alias("before"),
        ),
        "mix-sources",
    )
    inside = rows.alias("r").join(
        sources.where("cut_range >= 0").alias("t"),
        F.col("r.source").eqNullSafe(F.col("t.source")) & (_range(bits) == F.col("cut_range")),
    ).select(ROW, "doc_id", "size", "key", "rank", "rest", "before")
    upto = F.sum("size").over(W.partitionBy("rank").orderBy("key", "doc_id", ROW).rowsBetween(W.unboundedPreceding, 0))
    left = F.col("rest") - F.col("before") - (upto - F.col("size"))
    cut = stored(inside.select(ROW, F.greatest(F.lit(0), F.least("size", left)).cast("long").alias("extra")), "mix-cut")
    return Mix(rows, sources, cut, bits)


def _range(bits: int) -> Column:
    return F.shiftrightunsigned("key", 64 - bits)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Per row ``_row, doc_id, size, source_size, target, taken``; budgets are met to the word, so the last document
    that a source gives may be taken in part."""
    mix = plan_mix(docs, **options)
    extra = F.when(_range(mix.bits) < F.col("cut_range"), F.col("size")).otherwise(F.coalesce("extra", F.lit(0)))
    return (
        mix.rows.alias("r").join(mix.sources.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        .join(mix.cut, ROW, "left")
        .select(ROW, "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).alias("taken"))
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: rows of ``docs`` with all their columns, repeated as often as they are taken.

    Documents stay whole: the one at which a budget ends is taken if at least half of its words are within the budget.
    Rows without words belong to every whole epoch.
    """
    mix = plan_mix(docs, **options)
    extra = F.when(_range(mix.bits) < F.col("cut_range"), F.lit(1)).otherwise(
        F.coalesce((2 * F.col("extra") >= F.col("_size")) & (F.col("extra") > 0), F.lit(False)).cast("int")
    )
    plan = (
        mix.rows.alias("r").join(mix.sources.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        .withColumn("_size", F.col("size")).join(mix.cut, ROW, "left")
        .select(ROW, (F.col("epochs").cast("int") + extra).alias("_copies")).where("_copies > 0")
    )
    again = F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")
    return packed(docs).join(plan, ROW).select("doc", again).select("doc.*")
