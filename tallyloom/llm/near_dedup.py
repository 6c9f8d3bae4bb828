"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.common import ROW, bounded_batches, packed, stored, with_rows
from tallyloom.llm.graph import components

SHINGLE = 5
PERCENT = 80

# Two texts with similarity 0.8 share no band with probability (1 - 0.8 ** ROWS) ** BANDS = 3e-8.
BANDS, ROWS = 24, 3
COORDINATES = BANDS * ROWS

# Two texts with similarity 0.8 agree in fewer coordinates with probability 1e-7.
LEAST_AGREEMENT = 39

# Members of a bucket, and shingles of theirs, that are compared within one Python call; smaller buckets go into a join.
CHUNK = 256
CHUNK_SHINGLES = 1 << 20
SMALL_BUCKET = 16

# Bits of the filter that tells which texts need their full sets; beyond that many texts it only filters less.
FILTER_BITS = 1 << 23

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) > 150_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray, multiplier: int) -> np.ndarray:
    """A permutation of the 64-bit integers, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(multiplier)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x


def shingle_set(text: bytes, size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit names of the word shingles; a shorter text is one shingle, a text without words has none."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(words) < size:
        value = len(words)
        for x in h.tolist():
            value = (value * 0x9E3779B97F4A7C15 + x) % (1 << 64)
        return _mix(np.array([value], np.uint64), 0x94D049BB133111EB)
    sums = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        sums *= np.uint64(0x9E3779B97F4A7C15)
        sums += h[k : len(h) - size + 1 + k]
    return np.unique(_mix(sums, 0x94D049BB133111EB))


def circulant_minhash(shingles: np.ndarray) -> np.ndarray:
    """Coordinate k is the least value of the second permutation, shifted by k, over the first permutation's places."""
    places = _mix(shingles.copy(), 0xD6E8FEB86659FD93)
    shifts = np.arange(COORDINATES, dtype=np.uint64)[:, None]
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(places), 8192):
        shifted = places[None, at : at + 8192] - shifts
        least = np.minimum(least, _mix(shifted, 0xFF51AFD7ED558CCD).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different for each band."""
    s = signature.astype(np.uint64).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + s[:, k], 0xFF51AFD7ED558CCD)
    return keys.view(np.int64)


def _long_lists(arrays: list, kind) -> pa.Array:
    """Lists of numbers without Python objects; None is null."""
    sizes = np.array([0 if a is None else len(a) for a in arrays])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    full = [a for a in arrays if a is not None and len(a)]
    values = np.concatenate(full) if full else np.empty(0, np.int64)
    mask = pa.array([a is None for a in arrays], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind)), mask=mask)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``_row, doc_id, n, set_id, signature, keys``: set size, 128-bit digest of the whole set, coordinates, band keys."""
    schema = f"{ROW} long, doc_id long, n long, set_id binary, signature array<int>, keys array<long>"

    def sign(batches):
        hashes = _WordHashes()
        for batch in batches:
            n, ids, signs, keys = [], [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py() or b"", size, hashes)
                n.append(len(s))
                if len(s):
                    sign = circulant_minhash(s)
                    ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    signs.append(sign.view(np.int32))
                    keys.append(band_keys(sign))
                else:
                    ids.append(None), signs.append(None), keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                 _long_lists(signs, np.int32), _long_lists(keys, np.int64)],
                names=[ROW, "doc_id", "n", "set_id", "signature", "keys"],
            )

    rows = with_rows(docs.select("doc_id", F.col("text").cast("binary").alias("text")))
    return bounded_batches(rows.select(ROW, "doc_id", "text")).mapInArrow(sign, schema)


def _filter_places(row: np.ndarray) -> np.ndarray:
    return (_mix(row.astype(np.uint64), 0xD6E8FEB86659FD93) % np.uint64(FILTER_BITS)).astype(np.int64)


def full_sets(docs: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """``_row, shingles`` of the rows in ``wanted``, made from their texts again.

    A bit array of fixed size tells the workers which rows they may skip; it is put together by a grouped ``bit_or``.
    """

    def places(batches):
        for batch in batches:
            at = _filter_places(batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], names=["word", "bit"]
            )

    words = (
        wanted.select(ROW).mapInArrow(places, "word long, bit long")
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most FILTER_BITS / 32 rows
    )
    bits = np.zeros(FILTER_BITS >> 5, np.uint32)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def make(batches):
        hashes, bits = _WordHashes(), sent.value
        for batch in batches:
            at = _filter_places(batch.column(0).to_numpy(zero_copy_only=False))
            keep = np.flatnonzero(bits[at >> 5] >> (at & 31).astype(np.uint32) & 1)
            texts = batch.column(1)
            sets = [shingle_set(texts[i].as_py() or b"", size, hashes).view(np.int64) for i in keep.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), _long_lists(sets, np.int64)], names=[ROW, "shingles"]
            )

    rows = with_rows(docs.select(F.col("text").cast("binary").alias("text"))).select(ROW, "text")
    return bounded_batches(rows).mapInArrow(make, f"{ROW} long, shingles array<long>")


def _similar(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * shared >= percent * (a + b - shared)


def _verified(pairs: DataFrame, signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``a, b`` those whose full sets are similar enough. Sizes and signatures go first, as they are small."""
    side = lambda k: signed.select(F.col(ROW).alias(k), F.col("n").alias(f"n{k}"), F.col("signature").alias(f"s{k}"))
    agreed = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
    likely = (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (agreed >= LEAST_AGREEMENT))
        .select("a", "b", "na", "nb")
    )
    full = lambda k: sets.select(F.col(ROW).alias(k), F.col("shingles").alias(f"f{k}"))
    shared = F.size(F.array_intersect("fa", "fb"))
    both = likely.join(full("b"), "b").join(full("a"), "a")
    return both.where(_similar(shared, F.col("na"), F.col("nb"), percent)).select("a", "b")


class _Forest:
    """Union-find over component names."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[x] = y
        return x != y


def _chunk_links(percent: int):
    """Links between the components of two chunks of a bucket, on full sets: a spanning forest of those that exist.

    Components are named by a row of theirs, so a link between names is one between rows.
    """

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found, forest = [], _Forest()
        if len(left) and len(right):
            lefts = [np.asarray(x, np.int64) for x in left["shingles"]]
            rights = [np.asarray(x, np.int64) for x in right["shingles"]]
            owner = np.repeat(np.arange(len(rights)), [len(x) for x in rights])
            values = np.concatenate(rights)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            sizes = np.array([len(x) for x in rights])
            comps = right["comp"].to_numpy()
            for x, comp in zip(lefts, left["comp"].tolist()):
                first, last = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
                span = last - first
                total = int(span.sum())
                if not total:
                    continue
                at = np.repeat(first - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(total)
                shared = np.bincount(owner[at], minlength=len(rights))
                hits = np.flatnonzero(100 * shared >= percent * (len(x) + sizes - shared))
                found += [(comp, other) for other in np.unique(comps[hits]).tolist() if forest.join(comp, other)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return compare


def _bucket_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components of each bucket in ``rows`` (_row, key, n, comp, main), on full sets.

    A bucket is dealt into chunks by hash and all pairs of chunks are compared, so neither a bucket nor its pairs are ever
    in one task. Rows outside the bucket's main component are compared with all rows. A pair of chunks gives fewer links
    than it has rows.
    """
    counts = rows.groupBy("key").agg(
        F.count("*").alias("left"), F.sum("n").alias("shingles"), F.count_if(F.col("comp") != F.col("main")).alias("apart")
    )
    chunks = F.greatest(F.ceil(F.col("left") / CHUNK), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    rows = rows.join(counts.where("apart > 0").select("key", chunks.alias("chunks")), "key")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(ROW), F.col("chunks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    outside = rows.where("comp <> main").select("key", F.col("chunk").alias("i"), every.alias("j"), ROW, "comp")
    inside = rows.select("key", every.alias("i"), F.col("chunk").alias("j"), ROW, "comp")
    with_set = lambda side: side.join(sets, ROW).toDF(ROW, "key", "i", "j", "comp", "shingles")
    return (
        with_set(outside).groupBy("key", "i", "j")
        .cogroup(with_set(inside).groupBy("key", "i", "j"))
        .applyInPandas(_chunk_links(percent), "a long, b long")
    )


def _can_have_partner(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of large open buckets without those that provably have no partner there.

    Of a set with n shingles, s occur in another set of these buckets. It shares at most min(s, m) with a set of m
    shingles, and the similarity that this allows is greatest for the m nearest to s between the bucket's least and most.
    """
    rows = stored(large.select(ROW).distinct().join(sets, ROW), "large-sets")
    owners = rows.select(ROW, F.explode("shingles").alias("shingle")).groupBy("shingle").agg(
        F.count("*").alias("df"), F.min(ROW).alias(ROW)
    )
    alone = owners.where("df = 1").groupBy(ROW).agg(F.count("*").alias("alone"))
    sizes = rows.select(ROW, F.size("shingles").alias("n")).join(alone, ROW, "left")
    sizes = stored(sizes.select(ROW, "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("s")), "large-sizes")
    other = F.least(F.greatest("s", "least"), "most")
    return large.join(sizes.select(ROW, "s"), ROW).where(_similar(F.least(F.col("s"), other), F.col("n"), other, percent)).drop("s")


def _as_links(labels: DataFrame) -> DataFrame:
    """A component as links to its name: one per row."""
    return labels.where(f"comp <> {ROW}").select(F.col(ROW).alias("a"), F.col("comp").alias("b"))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their own and their leader's component."""
    rows = members.join(labels, ROW, "left").withColumn("comp", F.coalesce("comp", F.col(ROW)))
    rows = stored(rows.select(*members.columns, "comp"), "labelled")
    several = rows.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.when(F.col(ROW) == F.col("leader"), F.col("comp"))).alias("main")
    )
    return stored(rows.join(several.where("low < high").select("key", "main"), "key"), "open")


def near_links(docs: DataFrame, signed: DataFrame, size: int, percent: int) -> DataFrame:
    """Labels ``_row, comp`` of all distinct sets that have a link, one row per set (the smallest row of a set).

    1. Every member of a bucket is compared with the bucket's smallest row; the links give first components.
    2. Rows of large buckets are compared within one of their buckets, the largest. Copies of one text share most of their
       buckets, so this finds most links, once, and few components are left.
    3. Buckets that still hold several components are compared across them: small ones by a join, large ones in pairs
       of chunks. Rows in the same component need no comparison, nor do rows of large buckets with so many shingles of
       their own that no set there can be similar enough.

    From step to step a component is one link per row, and a comparison gives links between components only. So the links
    stay in proportion to the rows, however many pairs of a group are similar.
    """
    reps = signed.where("n > 0").groupBy("set_id").agg(F.min(ROW).alias(ROW)).select(ROW)
    signed = signed.join(reps, ROW)
    keys = signed.select(ROW, "n", F.explode("keys").alias("key"))
    buckets = keys.groupBy("key").agg(F.min(ROW).alias("leader"), F.count("*").alias("members"), F.min("n").alias("least"), F.max("n").alias("most"))
    shared = keys.select(ROW, "n", "key").join(buckets.where("members > 1"), "key")
    members = stored(shared.select(ROW, "n", "key", "leader", "members", "least", "most"), "buckets")
    signed = stored(signed.join(members.select(ROW).distinct(), ROW).select(ROW, "n", "signature"), "signed")
    sets = stored(full_sets(docs, size, signed), "sets")
    stars = members.where(f"leader <> {ROW}").select(F.col("leader").alias("a"), F.col(ROW).alias("b")).distinct()
    labels = components(stored(_verified(stars, signed, sets, percent), "star-links"))

    open_ = _labelled(members, labels)
    large = stored(_can_have_partner(open_.where(f"members > {SMALL_BUCKET}"), sets, percent), "large")
    if not large.isEmpty():
        own = large.groupBy(ROW).agg(F.max(F.struct("members", "key")).alias("own")).select(ROW, F.col("own.key").alias("key"))
        inner = stored(_bucket_links(large.join(own, [ROW, "key"]), sets, percent).distinct(), "inner-links")
        labels = components(_as_links(labels).unionByName(inner))
        columns = [c for c in large.columns if c not in ("comp", "main")]
        large = _labelled(large.select(columns), labels)
    few = open_.where(f"members <= {SMALL_BUCKET}").select(ROW, "key").join(labels, ROW, "left")
    few = stored(few.select(ROW, "key", F.coalesce("comp", F.col(ROW)).alias("comp")), "small")
    left, right = few.alias("l"), few.alias("r")
    crossing = (F.col("l.key") == F.col("r.key")) & (F.col(f"l.{ROW}") < F.col(f"r.{ROW}")) & (F.col("l.comp") != F.col("r.comp"))
    pairs = left.join(right, crossing).select(F.col(f"l.{ROW}").alias("a"), F.col(f"r.{ROW}").alias("b")).distinct()
    more = _verified(pairs, signed, sets, percent).unionByName(_bucket_links(large, sets, percent))
    return components(_as_links(labels).unionByName(stored(more.distinct(), "cross-links")))


def near_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row ``_row, doc_id, n_shingles, component_id, kept, stays``.

    Words are separated by ASCII white space, A-Z in lower case. Rows are linked if their sets of distinct shingles of
    ``size`` words have a Jaccard similarity of at least ``percent``; confirmed on the full sets. component_id is the
    smallest doc_id reachable. ``kept`` is doc_id = component_id; ``stays`` is true for exactly one row of each
    component, also with null or repeated ids. Equal sets are one class before any comparison, so copies never make
    pairs. Null texts and texts without words have an empty set and no link. An empty table gives no rows.
    """
    signed = stored(signatures(docs, size), "signatures")
    labels = near_links(docs, signed, size, percent)
    reps = signed.where("n > 0").groupBy("set_id").agg(F.min(ROW).alias("rep"))
    named = reps.join(labels.withColumnRenamed(ROW, "rep"), "rep", "left").select("set_id", F.coalesce("comp", "rep").alias("comp"))
    named = stored(named, "named")  # so that the join deals both sides anew and a set with very many rows can be split
    rows = signed.select(ROW, "doc_id", "n", "set_id")
    placed = rows.where("n > 0").join(named, "set_id").select(ROW, "doc_id", "n", "comp")
    placed = stored(placed.unionByName(rows.where("n = 0").select(ROW, "doc_id", "n", F.col(ROW).alias("comp"))), "placed")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
    # Stored, so that the join deals both sides anew and a component with very many rows can be split.
    firsts = stored(placed.groupBy("comp").agg(F.min(first).alias("first")), "firsts")
    stays = F.col(ROW) == F.col(f"first.{ROW}")
    return placed.join(firsts, "comp").select(
        ROW, "doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("first.doc_id"), stays).alias("kept"), stays.alias("stays"),
    )


def drop_near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, one of each component, with all their columns."""
    kept = near_groups(docs, size, percent).where("stays").select(ROW)
    return packed(docs).join(kept, ROW, "left_semi").select("doc.*")
