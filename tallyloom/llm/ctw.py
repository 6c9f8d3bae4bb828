"""Language-model scores by context-tree weighting over bytes, beside a word-frequency base."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from collections import Counter
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.common import ROW, bounded_batches, stored, with_rows

# The context of a byte: the five bytes before it. Each older byte extends the context before it by one, which makes a tree.
DEPTH = 5
EDGE = b"\xff"  # a byte that UTF-8 never has: stands before and after each text

# Words with at least this share of all training tokens are sent to the workers: never more than 2 ** 20 words.
COMMON = 2.0**-20

# At most so many of the most frequent cells are sent to the workers; the others are joined, with the same values.
SENT_CELLS = 1 << 20

COUNTED_WORDS = 300_000
COUNTED_BYTES = 4 << 20
COUNTED_CELLS = 1_000_000
RARE_ROWS = 500_000

END = b" "  # the end token; no word holds a blank
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def cells(text: bytes) -> np.ndarray:
    """For each byte of a text and its end: the context, newest byte first, and then the byte."""
    padded = np.frombuffer(EDGE * DEPTH + text + EDGE, np.uint8).astype(np.int64)
    n = len(text) + 1
    key = padded[DEPTH - 1 : DEPTH - 1 + n].copy()
    for back in range(2, DEPTH + 1):
        key <<= 8
        key |= padded[DEPTH - back : DEPTH - back + n]
    return (key << 8) | padded[DEPTH:]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up so that it is exact to doubles for all x >= 0.5."""
    low = x < 8
    y = np.where(low, x + 8, x)
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    small = np.where(low, x, 1.0)
    product = np.ones_like(small)
    for k in range(8):
        product *= small + k
    return series - np.where(low, np.log(product), 0)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - 2 * 0.5723649429247001


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def count_corpus(texts: DataFrame) -> DataFrame:
    """``cell, word, n, more``: how often each byte follows each context, and how often each word (or the end) occurs.

    A second column of ``texts`` may tell which of them are only scored: their words are not counted, their cells not in
    ``n`` but in ``more``. Workers add up what they read and give out sums of bounded size; the shuffle adds the sums.
    """

    def count(batches):
        words, parts, held, summed = Counter(), ([], []), 0, nothing()
        for batch in batches:
            only_scored = batch.column(1).to_pylist() if batch.num_columns > 1 else [False] * batch.num_rows
            for text, other in zip(batch.column(0), only_scored):
                low = (text.as_py() or b"").translate(LOWER)
                if not other:
                    words.update(low.split())
                    words[END] += 1
                parts[other].append(cells(low))
                held += len(low)
                if held >= COUNTED_BYTES:
                    summed, parts, held = added(summed, parts), ([], []), 0
                    if len(summed[0]) >= COUNTED_CELLS:
                        yield from cell_rows(*summed)
                        summed = nothing()
                if len(words) >= COUNTED_WORDS:
                    yield from word_rows(words)
                    words = Counter()
        yield from cell_rows(*added(summed, parts))
        yield from word_rows(words)

    def nothing():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def added(summed, parts):
        for k in (0, 1):
            if parts[k]:
                cell, n = np.unique(np.concatenate(parts[k]), return_counts=True)
                every, place = np.unique(np.concatenate([summed[0], cell]), return_inverse=True)
                old, new = place[: len(summed[0])], place[len(summed[0]) :]
                sums = np.zeros((2, len(every)), np.int64)
                sums[:, old] = summed[1:]
                sums[k, new] += n
                summed = every, sums[0], sums[1]
        return summed

    def cell_rows(cell, n, more):
        for at in range(0, len(cell), 100_000):
            some, m = slice(at, at + 100_000), len(cell[at : at + 100_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell[some]), pa.nulls(m, pa.binary()), pa.array(n[some]), pa.array(more[some])],
                names=["cell", "word", "n", "more"],
            )

    def word_rows(words):
        n = len(words)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64()),
             pa.array(np.zeros(n, np.int64))], names=["cell", "word", "n", "more"],
        )

    partial = bounded_batches(texts).mapInArrow(count, "cell long, word binary, n long, more long")
    return partial.groupBy("cell", "word").agg(F.sum("n").alias("n"), F.sum("more").alias("more"))


def _weighed(level: DataFrame, deepest: bool) -> DataFrame:
    """``node, zeros, ones, share, weighted``: the weight of a node's own estimate, and its log weighted probability."""

    def work(batches):
        for batch in batches:
            zeros, ones, below = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            own = log_kt(zeros.astype(np.float64), ones.astype(np.float64))
            weighted = own if deepest else np.logaddexp(own, below) - np.log(2)
            share = np.ones(len(own)) if deepest else np.exp(own - np.log(2) - weighted)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 1, 2)), pa.array(share), pa.array(weighted)],
                names=["node", "zeros", "ones", "share", "weighted"],
            )

    return level.select("node", "zeros", "ones", "below").mapInArrow(
        work, "node long, zeros long, ones long, share double, weighted double"
    )


def _above(node: Column) -> Column:
    """The same decision one context up. A node is a context of its depth, and the decision's place below in 8 bits."""
    return F.shiftleft(F.shiftright(node, 16), 8).bitwiseOR(node.bitwiseAND(F.lit(255)))


def cell_logs(cells_: DataFrame) -> DataFrame:
    """Adds ``log``: log10 of the probability of the byte in its context, for each row of ``cell, n`` (n may be 0).

    Every context is a node, and the tree is only ever tables of one row per context and decision: counts and weighted
    probabilities are added up from depth to depth, estimates are mixed on the way down. A node has at most 256 nodes
    one deeper, so no key of a sum or a join holds more than a few rows, whatever the corpus.
    """
    symbol = F.col("cell").bitwiseAND(F.lit(255))
    at = lambda k: F.shiftright(symbol + 256, 8 - k)  # noqa: E731  decisions in heap order from 1
    bit = lambda k: F.shiftright(symbol, 7 - k).bitwiseAND(F.lit(1))
    context = F.shiftright("cell", 8)
    steps = F.explode(F.array(*[
        F.struct(F.shiftleft(context, 8).bitwiseOR(at(k)).alias("node"), bit(k).alias("bit")) for k in range(8)
    ])).alias("s")
    level = cells_.select(steps, "n").groupBy("s.node").agg(
        F.sum(F.when(F.col("s.bit") == 0, F.col("n")).otherwise(0)).alias("zeros"),
        F.sum(F.when(F.col("s.bit") == 1, F.col("n")).otherwise(0)).alias("ones"), F.lit(0.0).alias("below"),
    )
    levels = {}
    for depth in range(DEPTH, -1, -1):
        levels[depth] = stored(_weighed(level, depth == DEPTH), f"contexts-{depth}")
        level = levels[depth].groupBy(_above(F.col("node")).alias("node")).agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below")
        )
    # done: what the depths above add to the probability of a one; left: the weight of the depths from here on.
    down = levels[0].select("node", F.lit(0.0).alias("done"), F.lit(1.0).alias("left"), F.lit(0.5).alias("p"), "zeros", "ones", "share")
    for depth in range(DEPTH + 1):
        if depth:
            up = down.select(F.col("node").alias("up"), "done", "left", "p")
            down = levels[depth].join(up, _above(F.col("node")) == F.col("up"))
        estimate = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
        seen = F.col("zeros") + F.col("ones") > 0
        down = down.select(
            "node", (F.col("done") + F.col("left") * F.col("share") * estimate).alias("done"),
            (F.col("left") * (1 - F.col("share"))).alias("left"),
            F.when(seen, F.col("done") + F.col("left") * estimate).otherwise(F.col("p")).alias("p"),
        )
    decision = F.struct(F.col("node").bitwiseAND(F.lit(255)).alias("at"), "p")
    known = down.groupBy(F.shiftright("node", 8).alias("context")).agg(F.map_from_entries(F.collect_list(decision)).alias("ps"))
    p = lambda k: F.element_at("ps", at(k))
    log = sum((F.log10(F.when(bit(k) == 1, p(k)).otherwise(1 - p(k))) for k in range(8)), F.lit(0.0))
    return cells_.join(known, context == F.col("context")).select(*cells_.columns, log.alias("log"))


def least_sent(logs: DataFrame, most: int) -> int:
    """The least count that leaves at most ``most`` cells, to an eighth of a power of two."""
    size = F.floor(F.log2("of") * 8).cast("int")
    left = most
    for row in logs.groupBy(size.alias("k")).count().orderBy(F.desc("k")).collect():
        left -= row["count"]
        if left < 0:
            return max(1, math.ceil(2.0 ** ((row["k"] + 1) / 8)))
    return 1


class CellTable:
    """The logs of some cells in a hash table at most three quarters full, for whole arrays at a time."""

    def __init__(self, cell: np.ndarray, log: np.ndarray):
        self.bits = max(4, (len(cell) * 3 // 2).bit_length())
        self.cell, self.log = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, np.nan)
        slot = self._slots(cell)
        while len(cell):
            free = np.flatnonzero(self.cell[slot] < 0)
            self.cell[slot[free]] = cell[free]  # of several for one slot the last stays
            put = self.cell[slot] == cell
            self.log[slot[put]] = log[put]
            cell, log, slot = cell[~put], log[~put], (slot[~put] + 1) & (len(self.cell) - 1)

    def _slots(self, cell: np.ndarray) -> np.ndarray:
        return ((cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, cell: np.ndarray) -> np.ndarray:
        """Their logs, NaN for those not in the table."""
        slot = self._slots(cell)
        met = self.cell[slot]
        far = np.flatnonzero((met != cell) & (met >= 0))
        while len(far):
            slot[far] = (slot[far] + 1) & (len(self.cell) - 1)
            met = self.cell[slot[far]]
            far = far[(met != cell[far]) & (met >= 0)]
        return self.log[slot]


def text_parts(text: bytes, part: int = 1 << 18):
    """The cells of a text and its end, of a long text piece by piece."""
    if len(text) < part:
        yield cells(text)
        return
    for at in range(0, len(text) + 1, part):
        back = min(at, DEPTH)
        yield cells(text[at - back : at + part])[back : None if at + part > len(text) else -1]


class _Known(dict):
    def __missing__(self, word):
        return float("nan")


def score_documents(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    Both models learn from all rows whose crc32 of the id, as text, leaves no remainder 1 by 5 (a null id counts as an
    empty text) and score every row. Null texts count as empty: one end token. An empty table gives no rows.

    ``score`` is the log10 probability of the text's bytes and an end sign under a context tree of depth 5: each byte is
    eight binary decisions, each with a Krichevsky-Trofimov estimate per depth, mixed with the weights of context-tree
    weighting. Where a context has never met a decision, the deepest one
    that has is used. Every context is a node of its own, however rare. ``bits_per_byte`` is the code length over the
    bytes and the end. ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))) over words and end.

    Counts of common words (a share of 2 ** -20 of all tokens or more) and logs of the most frequent cells (at most
    2 ** 20) go to the workers; the other words and cells of a document are joined with theirs by a shuffle, so no
    vocabulary and no model has to fit anywhere.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = with_rows(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text.alias("text")))
    counts = stored(count_corpus(rows.select("text", "held_out")), "corpus-counts")
    words = counts.where("word IS NOT NULL").select("word", F.col("n").alias("c"))
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = words.where(F.col("c") >= max(1.0, total * COMMON)).toPandas()  # at most 2 ** 20 rows
    known = dict(zip(map(bytes, common["word"]), np.log10(common["c"].to_numpy(np.float64) + 0.5).tolist()))
    met_cells = counts.where("cell IS NOT NULL").select("cell", "n", (F.col("n") + F.col("more")).alias("of"))
    logs = stored(cell_logs(met_cells).select("cell", "of", "log"), "cell-logs")
    least = least_sent(logs, SENT_CELLS)
    common = logs.where(F.col("of") >= least).select("cell", "log").toArrow()  # at most SENT_CELLS rows
    # Plain arrays: a broadcast object of a class of this package would ask for the package on the workers.
    sent = docs.sparkSession.sparkContext.broadcast((known, common["cell"].to_numpy(), common["log"].to_numpy()))
    schema = (
        f"{ROW} long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
        "n_bytes long, word binary, n long"
    )
    names = [f.split()[0] for f in schema.split(", ")]

    def score(batches):
        known, table = _Known(sent.value[0]), CellTable(*sent.value[1:])
        for batch in batches:
            n = batch.num_rows
            tokens, found, base, scores, sizes = [], [], [], [], []
            rare_row, rare_word, rare_n = [], [], []
            rare_cells, held = [], 0
            for row, text in zip(batch.column(0).to_pylist(), batch.column(3)):
                low = text.as_py().translate(LOWER)
                doc_words = [*low.split(), END]
                logs = np.fromiter(map(known.__getitem__, doc_words), np.float64, len(doc_words))
                unknown = np.flatnonzero(np.isnan(logs))
                tokens.append(len(doc_words))
                found.append(len(doc_words) - len(unknown))
                base.append(float(np.nansum(logs)))
                scores.append(0.0)
                for part in text_parts(low):
                    logs = table.find(part)
                    absent = np.isnan(logs)
                    if absent.any():
                        scores[-1] += float(np.nansum(logs))
                        rare_cells.append((row, *np.unique(part[absent], return_counts=True)))
                        held += len(rare_cells[-1][1])
                        if held >= RARE_ROWS:
                            yield rare_rows(*joined(rare_cells))
                            rare_cells, held = [], 0
                    else:
                        scores[-1] += float(logs.sum())
                sizes.append(len(low))
                rare = Counter([doc_words[i] for i in unknown.tolist()])
                rare_row += [row] * len(rare)
                rare_word += rare.keys()
                rare_n += rare.values()
            own = [b" %d" % r for r in batch.column(0).to_pylist()]  # a key of its own, so these rows spread
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(tokens, pa.int64()), pa.array(found, pa.int64()),
                 pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()),
                 pa.array(own, pa.binary()), pa.nulls(n, pa.int64())], names=names,
            )
            yield rare_rows(pa.array(rare_row, pa.int64()), pa.array(rare_word, pa.binary()), pa.array(rare_n, pa.int64()))
            if rare_cells:
                yield rare_rows(*joined(rare_cells))

    def joined(rare_cells):
        row = np.repeat([r for r, _, _ in rare_cells], [len(c) for _, c, _ in rare_cells])
        cell = pc.cast(pa.array(np.concatenate([c for _, c, _ in rare_cells])), pa.string())
        n = np.concatenate([k for _, _, k in rare_cells])
        return pa.array(row, pa.int64()), pc.binary_join_element_wise(" c", cell, "").cast(pa.binary()), pa.array(n, pa.int64())

    def rare_rows(row, word, n):
        empty = (pa.nulls(len(row), t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))
        return pa.RecordBatch.from_arrays([row, *empty, word, n], names=names)

    scored = bounded_batches(rows.select(ROW, "doc_id", "held_out", "text")).mapInArrow(score, schema)
    cell_key = F.concat(F.lit(" c"), F.col("cell").cast("string")).cast("binary")  # no word holds a blank
    rare = logs.where(F.col("of") < least).select(cell_key.alias("word"), F.lit(None).cast("long").alias("c"), "log")
    matched = scored.join(words.withColumn("log", F.lit(None).cast("double")).unionByName(rare), "word", "left")
    seen = F.coalesce("c", F.lit(0))
    is_cell = F.col("log").isNotNull()
    part = F.when(F.col("n").isNull(), F.col("base")).when(is_cell, 0.0).otherwise(F.col("n") * F.log10(seen + 0.5))
    met = F.when(F.col("n").isNull(), F.col("n_known")).otherwise(F.when(seen > 0, F.col("n")).otherwise(0))
    score_part = F.when(F.col("n").isNull(), F.col("score")).when(is_cell, F.col("n") * F.col("log")).otherwise(0.0)
    one = lambda name: F.max(name).alias(name)
    added = matched.groupBy(ROW).agg(
        one("doc_id"), one("held_out"), one("n_tokens"), F.sum(met).alias("n_known"), F.sum(part).alias("logs"),
        F.sum(score_part).alias("score"), one("n_bytes"),
    )
    scale = float(np.log10(total + 0.5 * (kinds + 1)))
    return added.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * scale).alias("base_score"), "score",
        (-F.col("score") / (F.log10(F.lit(2.0)) * (F.col("n_bytes") + 1))).alias("bits_per_byte"),
    )
