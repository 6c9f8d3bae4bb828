"""Product codes of vectors: integer codebooks fitted over Hilbert-sorted blocks with boxes and sums."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import ROW, bounded_batches, stored, with_rows
from tallyloom.session import BROADCAST_ROWS

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6

# Part vectors in a block. Smaller blocks have tighter boxes and more of them.
BLOCK = 128

# Beyond this magnitude squared distances may not fit into 64 bits.
LARGEST = 1 << 26

KEY_BITS = 62


def hilbert_keys(axes: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points with ``bits`` bits per axis (Skilling's transform), one row per point."""
    x = [axes[:, i].astype(np.int64) for i in range(axes.shape[1])]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            swapped = np.where(x[i] & q, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(x[i] & q, low, swapped)
            x[i] = x[i] ^ swapped
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn, q = np.zeros(len(axes), np.int64), top
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    key = np.zeros(len(axes), np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | (axis ^ turn) >> b & 1
    return key


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """``_row, vec_id, label, v``: rows whose vector has finite components only, as floors of 4096 times the components."""
    x, scaled = F.col("embedding"), lambda c: c.cast("double") * SCALE
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(scaled(c)) < F.lit(float("inf"))))
    refused = F.raise_error(F.lit(f"integer components beyond {LARGEST} have no 64-bit distances"))
    whole = lambda c: F.when(F.abs(scaled(c)) > LARGEST, refused).otherwise(F.floor(scaled(c))).cast("int")
    rows = with_rows(vectors.select("vec_id", "label", "embedding")).where(x.isNotNull() & finite)
    return rows.select(ROW, "vec_id", "label", F.transform(x, whole).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    m = np.zeros((len(sizes), width), np.int32)
    m[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return m


def _flat_lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.reshape(-1), kind))


def block_table(kept: DataFrame, width: int, low: np.ndarray, high: np.ndarray, parts: int, block: int) -> DataFrame:
    """``part, n, lo, hi, sums, rows, data``: blocks of part vectors that follow one another on the part's Hilbert curve.

    Rows are dealt by range of part, place and row number, so equal vectors without number fill as many tasks as they need.
    """
    size = width // parts
    axes = min(size, KEY_BITS)
    bits = max(1, min(16, KEY_BITS // axes))
    span = np.maximum(1, high.astype(np.int64) - low + 1)

    def cut(batches):
        for batch in batches:
            rows, m = batch.column(0), _matrix(batch.column(1), width)
            places = ((m.astype(np.int64) - low) << bits) // span
            for p in range(parts):
                at = slice(p * size, (p + 1) * size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(m), p, np.int32)), pa.array(hilbert_keys(places[:, at][:, :axes], bits)), rows,
                     _flat_lists(np.ascontiguousarray(m[:, at]), pa.int32())],
                    names=["part", "key", ROW, "v"],
                )

    def blocks(batches):
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        names = ["part", "n", "lo", "hi", "sums", "rows", "data"]

        def out(part, rows, m):
            values = [[part], [len(m)], [m.min(0)], [m.max(0)], [m.sum(0, dtype=np.int64)], [rows], [m.reshape(-1)]]
            kinds = [pa.int32(), pa.int32(), *[pa.list_(t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            part, rows, m = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), size)
            ends = np.flatnonzero(np.diff(part)) + 1
            for p, r, x in zip(part[np.concatenate([[0], ends])] if len(part) else [], np.split(rows, ends), np.split(m, ends)):
                if held and held[0][0] == p:
                    r, x = np.concatenate([held[0][1], r]), np.concatenate([held[0][2], x])
                elif held:
                    yield out(*held[0])
                full = len(x) // block * block
                for at in range(0, full, block):
                    yield out(int(p), r[at : at + block], x[at : at + block])
                held = [(int(p), r[full:], x[full:])] if len(x) > full else []
        if held:
            yield out(*held[0])

    schema = f"part int, key long, {ROW} long, v array<int>"
    dealt = bounded_batches(kept.select(ROW, "v")).mapInArrow(cut, schema).repartitionByRange("part", "key", ROW)
    rows = dealt.sortWithinPartitions("part", "key", ROW).select("part", ROW, "v")
    shape = "part int, n int, lo array<int>, hi array<int>, sums array<long>, rows array<long>, data array<int>"
    return stored(rows.mapInArrow(blocks, shape), "blocks")


def shortlists(lo: np.ndarray, hi: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries can be nearest to some point of a box: those no farther at best than another is at worst.

    ``lo`` and ``hi`` are (blocks, size), ``entries`` (blocks, entries, size). Equal distances stay, so ties are decided by
    the exact kernel.
    """
    lo, hi = lo[:, None, :], hi[:, None, :]
    outside = np.maximum(np.maximum(lo - entries, entries - hi), 0)
    farthest = np.maximum(entries - lo, hi - entries)
    return (outside * outside).sum(2) <= (farthest * farthest).sum(2).min(1)[:, None]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lower on ties, and the squared distance, in integers."""
    gaps = points[:, None, :] - entries[None, :, :]
    distances = (gaps * gaps).sum(2)
    best = distances.argmin(1)
    return best, distances[np.arange(len(points)), best]


def _decided(batch: pa.RecordBatch, books: np.ndarray):
    """For each block its part, its rows of points and the entries that its box leaves."""
    part = batch.column(0).to_numpy()
    size = books.shape[2]
    lo, hi = (_matrix(batch.column(i), size).astype(np.int64) for i in (2, 3))
    lists = shortlists(lo, hi, books[part])
    for i in range(len(part)):
        yield i, int(part[i]), np.flatnonzero(lists[i])


def _points(batch: pa.RecordBatch, i: int, size: int) -> np.ndarray:
    return batch.column(6)[i].values.to_numpy().reshape(-1, size).astype(np.int64)


def next_books(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries move to the floored mean of their parts. A block with one entry left gives its stored sums."""
    parts, entries, size = books.shape

    def add(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for i, part, left in _decided(batch, books):
                if len(left) == 1:
                    sums[part, left[0]] += batch.column(4)[i].values.to_numpy()
                    counts[part, left[0]] += batch.column(1)[i].as_py()
                    continue
                points = _points(batch, i, size)
                best = left[nearest(points, books[part, left])[0]]
                np.add.at(sums[part], best, points)
                counts[part] += np.bincount(best, minlength=entries)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]),
             _flat_lists(sums[part, entry], pa.int64())],
            names=["part", "entry", "n", "sums"],
        )

    added = bounded_batches(blocks).mapInArrow(add, "part int, entry int, n long, sums array<long>")
    places = added.select("part", "entry", "n", F.posexplode("sums").alias("place", "total"))
    totals = places.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    moved = books.copy()
    for r in totals.collect():  # at most one row per number of the codebooks
        moved[r.part, r.entry, r.place] = r.total // r.n
    return moved


def assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``_row, part, entry, distance`` of every part vector."""
    size = books.shape[2]

    def assign(batches):
        for batch in batches:
            for i, part, left in _decided(batch, books):
                best, distance = nearest(_points(batch, i, size), books[part, left])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(5)[i].values, pa.array(np.full(len(best), part, np.int32)),
                     pa.array(left[best].astype(np.int32)), pa.array(distance)],
                    names=[ROW, "part", "entry", "distance"],
                )

    return bounded_batches(blocks).mapInArrow(assign, f"{ROW} long, part int, entry int, distance long")


def fit_codebooks(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK,
) -> tuple[DataFrame, DataFrame | None, np.ndarray]:
    """Kept rows, their blocks and the fitted codebooks (part, entry, place)."""
    kept = stored(kept_vectors(vectors), "vectors")
    ends = kept.select(F.max(F.size("v")).alias("width")).first()
    width = max(1, -(-(ends.width or 0) // parts)) * parts
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v", ROW).limit(entries).select("v").collect()
    if not first:
        return kept, None, np.zeros((parts, 0, width // parts), np.int64)
    books = np.zeros((len(first), width), np.int64)
    for i, r in enumerate(first):
        books[i, : len(r.v)] = r.v
    books = np.ascontiguousarray(books.reshape(len(first), parts, -1).transpose(1, 0, 2))
    low, high = np.zeros(width, np.int64), np.zeros(width, np.int64)
    places = kept.select(F.posexplode("v").alias("place", "c")).groupBy("place").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    for r in places.collect():  # one row per component
        low[r.place], high[r.place] = min(0, r.low), max(0, r.high)
    blocks = block_table(kept, width, low, high, parts, block)
    for _ in range(rounds):
        books = next_books(blocks, books)
    return kept, blocks, books


def books_text(books: np.ndarray) -> str:
    """All components by part, entry and place, joined by commas."""
    return ",".join(map(str, books.reshape(-1).tolist()))


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK,
) -> DataFrame:
    """``vec_id, label, codes, error, label_error, codebooks_sha256`` of every row with a finite vector.

    ``codes`` lists the entry per part, ``error`` is the squared distance of all parts, ``label_error`` its sum over the rows
    of the same label, nulls together. Rows whose vector is null or holds null or non-finite components are left out.
    Shorter vectors are filled with zeros to the greatest length, and that to a multiple of ``parts``. Of equal vec_ids the
    smaller vector comes first among the starting entries, null vec_ids come last; fewer rows than entries give fewer
    entries. Repeated rows are coded one by one. Components from 2^14 on (integers beyond 2^26) are refused, as their
    distances need not fit into 64 bits. Only the three named columns are read, so no other can clash. An empty table gives
    no rows.
    """
    kept, blocks, books = fit_codebooks(vectors, parts, entries, rounds, block)
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    names = kept.select(ROW, "vec_id", "label")
    if blocks is None:
        none = names.where("false")
        return none.select(
            "vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"),
            F.lit(0).cast("long").alias("label_error"), F.lit(digest).alias("codebooks_sha256"),
        )
    by_part = F.array_sort(F.collect_list(F.struct("part", "entry")))  # one per part
    rows = assigned(blocks, books).groupBy(ROW).agg(by_part.alias("codes"), F.sum("distance").alias("error"))
    coded = stored(rows.join(names, ROW).select("vec_id", "label", F.col("codes.entry").alias("codes"), "error"), "codes")
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label-errors")
    if sums.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    whole = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return whole.select("vec_id", "label", "codes", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
