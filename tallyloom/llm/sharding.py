"""Shards of near equal size: best-fit-decreasing packing of indivisible groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tallyloom.llm.common import ROW, stored, with_rows

# A group at least as large as this part of a shard is packed by itself; smaller ones are poured into as many parcels.
PARCELS_PER_SHARD = 512

# Rows that are numbered within one window group, about.
SLOT_ROWS = 50_000


class FreeSpace:
    """Bins by free space in a treap: a search tree that stays balanced in expectation.

    Nodes are ``[key, priority, left, right]`` with key ``(free space, bin)``; priorities follow from the bin number.
    """

    def __init__(self):
        self.root = None

    @staticmethod
    def _split(node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = FreeSpace._split(node[3], key)
            return node, high
        low, node[2] = FreeSpace._split(node[2], key)
        return low, node

    @staticmethod
    def _merge(low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = FreeSpace._merge(low[3], high)
            return low
        high[2] = FreeSpace._merge(low, high[2])
        return high

    def add(self, free: int, bin_: int) -> None:
        priority = (bin_ + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
        priority ^= priority >> 29
        low, high = self._split(self.root, (free, bin_))
        self.root = self._merge(self._merge(low, [(free, bin_), priority, None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes the bin with the least free space that still holds ``size``."""
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            low, rest = self._split(self.root, best)
            _, high = self._split(rest, (best[0], best[1] + 1))
            self.root = self._merge(low, high)
        return best


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item; ``sizes`` are in descending order. An item above the capacity gets a bin of its own."""
    space, bins, opened = FreeSpace(), [], 0
    for size in sizes:
        found = space.take_tightest(size)
        free, bin_ = found if found else (max(capacity, size), opened)
        opened += found is None
        space.add(free - size, bin_)
        bins.append(bin_)
    return bins


def best_fit_into(sizes: list[int], shards: int) -> list[int]:
    """Bins 0..shards-1 with the smallest capacity that best fit gets by with, to a ten-thousandth.

    An item above the fair share of what is left is a bin by itself, so that the others still spread over all bins.
    """
    alone = 0
    left = sum(sizes)
    while alone < min(shards - 1, len(sizes)) and sizes[alone] * (shards - alone) > left:
        left -= sizes[alone]
        alone += 1
    rest, open_ = sizes[alone:], shards - alone
    if not rest:
        return list(range(alone))
    low = max(-(-left // open_), rest[0])
    high = low + rest[0]
    bins = best_fit(rest, high)
    while high - low > max(1, low // 10_000):
        middle = (low + high) // 2
        tried = best_fit(rest, middle)
        if max(tried) < open_:
            bins, high = tried, middle
        else:
            low = middle
    return [*range(alone), *(alone + b for b in bins)]


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per row ``_row, doc_id, size, text_crc32, shard, slot``: all documents in ``shards`` shards of near equal bytes.

    Size is the UTF-8 length plus one; null texts count as empty. Equal texts (SHA-256) form an indivisible group.
    Groups of at least 1/512 of a shard, at most 512 per shard, are items by themselves. Smaller groups go into 512
    parcels per shard by their hash. Best-fit-decreasing packs the items and parcels: a summary of at most 1,024 rows
    per shard, whatever the input size, which also bounds the two broadcast tables. Slots are numbered from 0 in each
    shard by hash range of doc_id, so no shard is gathered in one task. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = with_rows(docs.select("doc_id", text.alias("text"))).select(
        ROW, "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("group"),
    )
    rows = stored(rows, "shard-rows")
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    parcels = shards * PARCELS_PER_SHARD
    least = max(1, (total or 0) // parcels)
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    parcel = F.pmod(F.xxhash64("group"), F.lit(parcels)).cast("int")
    large = F.col("bytes") > least
    items = (
        groups.groupBy(F.when(large, F.col("group")).alias("group"), F.when(~large, parcel).alias("parcel"))
        .agg(F.sum("bytes").alias("bytes")).collect()
    )
    items.sort(key=lambda r: (-r.bytes, r.group or b"", -1 if r.parcel is None else r.parcel))
    placed = list(zip(items, best_fit_into([r.bytes for r in items], shards)))
    spark = docs.sparkSession
    single = spark.createDataFrame([(bytes(r.group), s) for r, s in placed if r.group is not None], "group binary, single int")
    poured = spark.createDataFrame([(r.parcel, s) for r, s in placed if r.group is None], "parcel int, poured int")
    dealt = (
        rows.join(F.broadcast(single), "group", "left").withColumn("parcel", parcel)
        .join(F.broadcast(poured), "parcel", "left")
        .select(ROW, "doc_id", "size", "text_crc32", F.coalesce("single", "poured").alias("shard"))
    )
    return with_slots(dealt, count)


def with_slots(dealt: DataFrame, count: int) -> DataFrame:
    """Adds ``slot``: places from 0 without gaps in each shard, by a bucket of the row's hash and then by id."""
    buckets = max(64, count // SLOT_ROWS)
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("doc_id", ROW), F.lit(buckets)).cast("int"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", F.coalesce(before, F.lit(0)).alias("start")
    )
    place = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", ROW)) - 1
    numbered = dealt.withColumn("place", place)
    return numbered.join(starts, ["shard", "bucket"]).select(
        ROW, "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot")
    )
