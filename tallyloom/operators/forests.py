"""Random forests for regression, all fits of a search grown together: one histogram pass per depth.

Rows are binned once. A node is a tree number and a box of bins, so fits whose trees agree down to a node share it, and
with it one histogram per row class; the training rows of a fit are a set of classes (all folds but one, or the first
fractions), whose histograms add up. A pass routes the rows to the open boxes, sums (node, feature, class, bin) cells, and
picks the best split of each node for each rule that asks. The driver holds the trees, never rows or cells.

Many rows share few combinations of bins. Rows of one class and equal bins go the same way in all trees, so such groups,
with their sums per tree, stand for the rows in all passes and scores once they are few enough (``grouped``).
"""

from __future__ import annotations

import math
import random
import sys
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyloom.session import stored

# Functions that run in Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
EDGE_ACCURACY = 1_000

# Up to so many features have an aggregate of their own; the values of more are grouped by their place.
AGGREGATES_AT_ONCE = 64

# Labels become integers of at most so many bits, so that sums are exact in whatever order tasks end.
LABEL_BITS = 28

# Rows that a task routes at once, and the cells it may hold for the nodes of a pass; more nodes take more passes.
ROWS_AT_ONCE = 1 << 17
CELLS_AT_ONCE = 1 << 23

# Groups of equal rows replace the rows if there are at least so many rows per group, or half the number of trees.
ROWS_PER_GROUP = 4

# The nodes of a pass are dealt into so many parts, whose splits are picked side by side.
PARTS = 64

# The driver grows forests of up to so many nodes by passes, at about a millisecond a node.
DRIVER_NODES = 1 << 17

# A row is in a tree 0, 1, 2.. times, as in a sample with replacement: quantiles of the Poisson distribution with mean 1.
_DRAWS = 1 << 16
_STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
POISSON = np.searchsorted(_STEPS, (np.arange(_DRAWS) + 0.5) / _DRAWS).astype(np.uint8)


class Fit(NamedTuple):
    """One forest: its row classes, its size and its stopping rules; ``features`` are tried at each node."""

    classes: frozenset[int]
    trees: int
    depth: int
    leaf_rows: int
    split_rows: int
    features: int


class Groups(NamedTuple):
    """Stored ``tree, class, y, bins, n, spread``: rows and label sum of a group in a tree, counted as often as its bag holds them.

    Tree -1 counts each row once; only there ``spread`` is set, the squared deviations of ``y`` from the mean of the group.
    """

    rows: DataFrame
    trees: int
    seed: int


class Binned(NamedTuple):
    """Stored rows ``draw, class, y, bins``; a label is ``center + y * unit``."""

    rows: DataFrame
    edges: list[np.ndarray]
    center: float
    unit: float
    classes: int
    groups: Groups | None = None


class Tree(NamedTuple):
    """Node arrays; a row goes left if its bin is at most ``cut``. Leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    depth: int


class Forest(NamedTuple):
    trees: list[Tree]
    edges: list[np.ndarray]

    def transform(self, df: DataFrame, features: str = "features", prediction: str = "prediction") -> DataFrame:
        trees, edges = list(self.trees), self.edges

        @F.arrow_udf("double")
        def predict(x: pa.Array) -> pa.Array:
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(edges))
            return pa.array(predicted(trees, bin_matrix(values, edges)))

        return df.withColumn(prediction, predict(values_of(df, features)))


def values_of(df: DataFrame, features: str) -> Column:
    """The features as an array, whether the column holds vectors or arrays."""
    return F.col(features) if isinstance(df.schema[features].dataType, T.ArrayType) else vector_to_array(features)


def feature_count(strategy: str, width: int) -> int:
    """Features tried at a node."""
    few = {"all": width, "sqrt": math.ceil(math.sqrt(width)), "log2": math.ceil(math.log2(max(2, width)))}
    return max(1, few[strategy])


def bin_matrix(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins as (feature, row). Bin b holds values above edge b - 1 and up to edge b; what is no number is in the last one."""
    bins = np.empty((len(edges), len(x)), np.uint8)
    for f, edge in enumerate(edges):
        bins[f] = np.searchsorted(edge, x[:, f], "left")
    return bins


def predicted(trees: Sequence[Tree], bins: np.ndarray) -> np.ndarray:
    """Mean of the trees for each column of ``bins``."""
    n = bins.shape[1]
    total, every = np.zeros(n), np.arange(n)
    for tree in trees:
        at = np.zeros(n, np.int32)
        for _ in range(tree.depth):
            at = np.where(bins[tree.feature[at], every] <= tree.cut[at], tree.left[at], tree.right[at])
        total += tree.value[at]
    return total / len(trees)


def bag_weights(draw: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree: a function of the row's hash, the tree and the seed only."""
    x = draw.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xBF58476D1CE4E5B9) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return POISSON[(x >> np.uint64(48)).astype(np.int64)]


def feature_order(seed: int, tree: int, box: tuple, width: int, first: int | None = None, rng: random.Random | None = None) -> list[int]:
    """The order in which a node tries features, or the first of them; a smaller number of features is a prefix of a larger one.

    That is ``random.Random(...).sample(range(width), width)``, without a generator per node and the draws that nobody asks for.
    """
    rng = rng or random.Random()
    rng.seed(f"{seed}|{tree}|{box}")
    bits, pool, order = rng.getrandbits, list(range(width)), []
    for left in range(width, max(0, width - (width if first is None else first)), -1):
        size = left.bit_length()
        at = bits(size)
        while at >= left:
            at = bits(size)
        order.append(pool[at])
        pool[at] = pool[left - 1]
    return order


# Binning


def _usable(df: DataFrame) -> DataFrame:
    label = F.col("label").cast("double")
    return df.where(label.isNotNull() & ~F.isnan(label))


def bin_rows(df: DataFrame, key: Sequence[str], row_class: Column, classes: int, like: Binned | None = None) -> Binned:
    """Rows with a label as bins, stored. Edges and label scale are those of ``like``, else quantiles of these rows.

    Quantiles are exact up to a thousandth of the rows. The table has a byte per feature.
    """
    rows = _usable(df).select(
        F.xxhash64(*key).alias("draw"), row_class.cast("int").alias("class"), F.col("label").cast("double").alias("label"),
        values_of(df, "features").alias("x"),
    )
    if like is None:
        first = rows.select(F.size("x").alias("width")).first()
        if first is None:
            raise ValueError("no training rows")
        # What is no number counts for no edge.
        ranks = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
        quantiles = lambda v: F.percentile_approx(F.when(~F.isnan(v), v), ranks, EDGE_ACCURACY)
        moments = [F.count("*").alias("n"), F.avg("label").alias("mean"), F.max("label").alias("high"), F.min("label").alias("low")]
        if first.width <= AGGREGATES_AT_ONCE:
            found = [quantiles(F.get("x", F.lit(f))) for f in range(first.width)]
            label = rows.agg(*moments, F.array(*found).alias("edges")).first()
            cuts = label.edges
        else:
            label = rows.agg(*moments).first()
            values = rows.select(F.posexplode("x").alias("place", "v"))
            found = values.groupBy("place").agg(quantiles(F.col("v")).alias("edges")).orderBy("place")
            cuts = [r.edges for r in found.collect()]  # one row per feature
        edges = [np.unique(np.array(e or [], float)) for e in cuts]
        reach = max(label.high - label.mean, label.mean - label.low) or 1.0
        bits = min(LABEL_BITS, 58 - label.n.bit_length())
        like = Binned(rows, edges, label.mean, reach / (1 << bits), classes)
    edges, center, unit, width = like.edges, like.center, like.unit, len(like.edges)

    def cut(batches):
        for batch in batches:
            n = batch.num_rows
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            bins = np.ascontiguousarray(bin_matrix(x, edges).T)
            offsets = np.arange(n + 1, dtype=np.int32) * width
            y = np.rint((batch.column(2).to_numpy() - center) / unit).astype(np.int64)
            binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(bins)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(y), binary], names=["draw", "class", "y", "bins"])

    made = stored(rows.mapInArrow(cut, "draw long, class int, y long, bins binary"), "binned")
    return Binned(made, edges, center, unit, classes)


def _gathered(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """Larger pieces of a task's rows: three columns, the bins as (feature, row), the other columns."""
    held, n = [], 0

    def piece():
        columns = [pa.concat_arrays([b.column(i) for b in held]) for i in range(held[0].num_columns)]
        bins = np.frombuffer(columns.pop(3).buffers()[2] or b"", np.uint8)[: n * width].reshape(n, width)
        plain = [c.to_numpy(zero_copy_only=False) for c in columns]
        return *plain[:3], np.ascontiguousarray(bins.T), *plain[3:]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= max(1, min(ROWS_AT_ONCE, (1 << 26) // max(1, width))):
            yield piece()
            held, n = [], 0
    if n:
        yield piece()


def grouped(binned: Binned, trees: int, seed: int = 0, most: int = 0) -> Binned:
    """Adds the groups of rows of equal class and bins, with their sums in each of so many trees, if they are few: up to
    ``most``, or so few that their sums are fewer than the rows.

    Rows meet by the hash of class and bins; a group too large for one task is cut, and what is left of its parts adds up
    like rows do. All sums are of integers, so forests are the same with groups and without.
    """
    key, width = F.xxhash64("class", "bins"), len(binned.edges)
    found = binned.rows.agg(F.count("*").alias("n"), F.approx_count_distinct(key).alias("groups")).first()
    if found.groups > most and found.n < found.groups * max(ROWS_PER_GROUP, trees / 2):
        return binned

    def add_up(batches):
        for draw, row_class, y, bins in _gathered(batches, width):
            new = (row_class[1:] != row_class[:-1]) | (bins[:, 1:] != bins[:, :-1]).any(0)
            first = np.concatenate([[0], np.flatnonzero(new) + 1])
            size = np.diff(np.append(first, len(y)))
            total = np.add.reduceat(y, first)
            spread = np.add.reduceat((y - np.repeat(total / size, size)) ** 2, first)
            group_class, group_bins = pa.array(row_class[first]), pa.array([b.tobytes() for b in bins.T[first]], pa.binary())
            sums = [(-1, size, total, spread)]
            for tree in range(trees):
                bag = bag_weights(draw, tree, seed).astype(np.int64)
                sums.append((tree, np.add.reduceat(bag, first), np.add.reduceat(bag * y, first), None))
            for tree, n, s, spread in sums:
                columns = [
                    pa.array(np.full(len(n), tree, np.int32)), group_class, pa.array(s), group_bins, pa.array(n),
                    pa.nulls(len(n), pa.float64()) if spread is None else pa.array(spread),
                ]
                made = pa.RecordBatch.from_arrays(columns, names=["tree", "class", "y", "bins", "n", "spread"])
                yield made.filter(pa.array(n > 0))

    met = binned.rows.hint("rebalance", F.col("class"), F.col("bins")).sortWithinPartitions(key)
    made = met.mapInArrow(add_up, "tree int, class int, y long, bins binary, n long, spread double")
    return binned._replace(groups=Groups(stored(made, "groups"), trees, seed))


# Growing


class _Rule(NamedTuple):
    """What a split depends on besides its node. The least size to split is a stop, which trees apply when put together."""

    classes: frozenset[int]
    features: int
    leaf_rows: int


class _Lattice:
    """All boxes of all trees seen so far, each with one way to it from its root."""

    def __init__(self, seed: int, width: int):
        self.seed, self.width = seed, width
        self.ids: dict[tuple, int] = {}
        self.nodes: list[tuple] = []
        self.parents: list[tuple | None] = []

    def node(self, tree: int, box: tuple = (), parent: tuple | None = None) -> int:
        found = self.ids.setdefault((tree, box), len(self.nodes))
        if found == len(self.nodes):
            self.nodes.append((tree, box))
            self.parents.append(parent)
        return found

    def children(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        tree, box = self.nodes[node]
        ranges = dict((f, (low, high)) for f, low, high in box)
        low, high = ranges.get(feature, (0, BINS - 1))
        sides = []
        for side, part in enumerate([(low, cut), (cut + 1, high)]):
            whole = tuple(sorted((f, *r) for f, r in {**ranges, feature: part}.items()))
            sides.append(self.node(tree, whole, (node, feature, cut, side)))
        return sides[0], sides[1]

    def routes(self, wanted: Iterable[int]) -> tuple[dict[int, list], dict[int, int]]:
        """From each node on a way to a wanted one the cuts and the nodes below them, -1 where nothing is wanted; and the roots."""
        cuts: dict[int, dict] = defaultdict(dict)
        roots, open_ = {}, list(wanted)
        while open_:
            node = open_.pop()
            if self.parents[node] is None:
                roots[self.nodes[node][0]] = node
                continue
            above, feature, cut, side = self.parents[node]
            if above not in cuts:
                open_.append(above)
            cuts[above].setdefault((feature, cut), [-1, -1])[side] = node
        return {node: [(f, c, *sides) for (f, c), sides in below.items()] for node, below in cuts.items()}, roots


def best_splits(n: np.ndarray, s: np.ndarray, order: Sequence[int], rules: Sequence[_Rule]) -> list[tuple]:
    """Best split of a node for each rule, from the counts and label sums (feature, class, bin) of its rows.

    Returns per rule ``(feature, cut, rows, sum, rows left, sum left)``; the feature is -1 if no split lowers the squared
    error with enough rows on both sides. Ties go to the lower feature and then to the lower cut.
    """
    found, sums = [], {}
    for rule in rules:
        if rule.classes not in sums:
            classes = [c for c in sorted(rule.classes) if c < n.shape[1]]
            left_n, left_s = n[:, classes].sum(1).cumsum(1), s[:, classes].sum(1).cumsum(1)
            rows, total = int(left_n[order[0], -1]), int(left_s[order[0], -1])
            right_n, right_s = rows - left_n, total - left_s
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left_s.astype(float) ** 2 / left_n + right_s.astype(float) ** 2 / right_n
            base = total * (total / rows) if rows else 0.0
            sums[rule.classes] = left_n, left_s, np.minimum(left_n, right_n), gain, rows, total, base + 1e-12 * abs(base)
        left_n, left_s, fewer, gain, rows, total, base = sums[rule.classes]
        tried = sorted(order[: rule.features])
        fair = np.where(fewer[tried] >= max(1, rule.leaf_rows), gain[tried], -np.inf)
        at = int(fair.argmax())
        f, cut = tried[at // fair.shape[1]], at % fair.shape[1]
        if not rows or not fair.flat[at] > base:
            found.append((-1, 0, rows, total, 0, 0))
        else:
            found.append((f, cut, rows, total, int(left_n[f, cut]), int(left_s[f, cut])))
    return found


def _sums(slot: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of integers per slot. A double holds the sums of the rows of a piece, of their groups only in two parts."""
    low = values & ((1 << LABEL_BITS) - 1)
    high = np.bincount(slot, values >> LABEL_BITS, size).astype(np.int64)
    return (high << LABEL_BITS) + np.bincount(slot, low, size).astype(np.int64)


def _pass(binned: Binned, lattice: _Lattice, asks: dict[int, list[int]], rules: list[_Rule]) -> list[tuple]:
    """``(node, rule, feature, cut, rows, sum, rows left, sum left)`` for all that is asked, in one Spark job."""
    width, classes, seed = lattice.width, binned.classes, lattice.seed
    orders = {node: feature_order(seed, *lattice.nodes[node], width) for node in asks}
    wanted = {node: orders[node][: max(rules[r].features for r in asks[node])] for node in asks}
    sent = binned.rows.sparkSession.sparkContext.broadcast((lattice.routes(asks), wanted))
    groups = binned.groups is not None

    def cells(batches):
        (routes, roots), wanted = sent.value
        for draw_or_tree, row_class, y, bins, *group_n in _gathered(batches, width):
            slots = row_class.astype(np.int64) * BINS
            nodes, features, places, counts, sums = [], [], [], [], []
            for tree, root in roots.items():
                if groups:
                    weight, value, inside = group_n[0], y, np.flatnonzero(draw_or_tree == tree)
                else:
                    bag = bag_weights(draw_or_tree, tree, seed)
                    weight, value, inside = bag.astype(float), bag * y.astype(float), np.flatnonzero(bag)
                open_ = [(root, inside)]
                while open_:
                    node, at = open_.pop()
                    for f in wanted.get(node, ()):
                        slot = slots[at] + bins[f][at]
                        n = np.bincount(slot, weight[at], classes * BINS)
                        some = np.flatnonzero(n)
                        nodes.append(np.full(len(some), node, np.int32))
                        features.append(np.full(len(some), f, np.int32))
                        places.append(some.astype(np.int32))
                        counts.append(n[some].astype(np.int64))
                        total = _sums(slot, value[at], classes * BINS) if groups else np.bincount(slot, value[at], classes * BINS)
                        sums.append(total[some].astype(np.int64))
                    for f, cut, left, right in routes.get(node, ()):
                        low = bins[f][at] <= cut
                        open_ += [(below, at[side]) for below, side in ((left, low), (right, ~low)) if below >= 0]
            if nodes:
                columns = [pa.array(np.concatenate(c)) for c in (nodes, features, places, counts, sums)]
                for at in range(0, len(columns[0]), 1 << 18):
                    yield pa.RecordBatch.from_arrays([c[at : at + (1 << 18)] for c in columns], names=["node", "feature", "slot", "n", "s"])

    read = binned.groups.rows.where("tree >= 0").select("tree", "class", "y", "bins", "n") if groups else binned.rows
    summed = (
        read.mapInArrow(cells, "node int, feature int, slot int, n long, s long")
        .groupBy("node", "feature", "slot").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    )
    asked = {node: (orders[node], asks[node]) for node in asks}
    rule_list = [tuple(r) for r in rules]
    told = binned.rows.sparkSession.sparkContext.broadcast((asked, rule_list))

    def choose(table: pa.Table) -> pa.Table:
        asked, rule_list = told.value
        node, f, slot, n, s = (table.column(c).to_numpy() for c in ("node", "feature", "slot", "n", "s"))
        split, rows = (width, classes, BINS), []
        by_node = np.argsort(node, kind="stable")
        for at in np.split(by_node, np.flatnonzero(np.diff(node[by_node])) + 1):
            count, total = np.zeros((width, classes * BINS), np.int64), np.zeros((width, classes * BINS), np.int64)
            count[f[at], slot[at]], total[f[at], slot[at]] = n[at], s[at]
            name = int(node[at[0]])
            order, numbers = asked[name]
            best = best_splits(count.reshape(split), total.reshape(split), order, [_Rule(*rule_list[r]) for r in numbers])
            rows += [(name, r, *b) for r, b in zip(numbers, best)]
        return pa.table([pa.array(c) for c in zip(*rows)], names=_SPLIT_NAMES).cast(_SPLIT_TYPES)

    # A node has at most one cell per feature and slot here, so a part has at most a part of the cells of a pass.
    parts = summed.withColumn("part", F.pmod("node", F.lit(PARTS)))
    picked = parts.groupBy("part").applyInArrow(choose, ", ".join(f"{n} long" for n in _SPLIT_NAMES)).toArrow()
    sent.destroy()
    told.destroy()
    return list(zip(*[picked.column(n).to_pylist() for n in _SPLIT_NAMES]))


_SPLIT_NAMES = ["node", "rule", "feature", "cut", "rows", "total", "rows_left", "total_left"]
_SPLIT_TYPES = pa.schema([(n, pa.int64()) for n in _SPLIT_NAMES])


def most_nodes(fits: Sequence[Fit]) -> int:
    """Bound of the different nodes that the fits can have; trees share those they agree on."""
    deepest: dict[tuple, int] = defaultdict(int)
    for fit in fits:
        for tree in range(fit.trees):
            name = fit.classes, fit.features, fit.leaf_rows, tree
            deepest[name] = max(deepest[name], fit.depth)
    return sum((2 << depth) - 1 for depth in deepest.values())


def grow(binned: Binned, fits: Sequence[Fit], seed: int = 0) -> list[Forest]:
    """All forests, level by level: as many passes over the rows as the deepest tree is deep.

    A forest is the same whether it is grown alone or with others. Sizes count rows as often as the bag holds them.
    """
    rules: list[_Rule] = []
    numbers: dict[_Rule, int] = {}
    deepest: dict[tuple[int, int], int] = defaultdict(int)
    least: dict[int, int] = {}
    of_fit = []
    for fit in fits:
        rule = _Rule(fit.classes, fit.features, fit.leaf_rows)
        r = numbers.setdefault(rule, len(rules))
        if r == len(rules):
            rules.append(rule)
        of_fit.append(r)
        least[r] = min(least.get(r, fit.split_rows), fit.split_rows)
        for tree in range(fit.trees):
            deepest[r, tree] = max(deepest[r, tree], fit.depth)
    if binned.groups and (binned.groups.seed != seed or binned.groups.trees < max(fit.trees for fit in fits)):
        binned = binned._replace(groups=None)  # made for other bags
    lattice = _Lattice(seed, len(binned.edges))
    splits: dict[tuple[int, int], tuple] = {}
    asks: dict[int, list[int]] = defaultdict(list)
    for r, tree in deepest:
        asks[lattice.node(tree)].append(r)
    level = 0
    per_pass = max(1, CELLS_AT_ONCE // (len(binned.edges) * binned.classes * BINS))
    while asks:
        below: dict[int, list[int]] = defaultdict(list)
        names = list(asks)
        for at in range(0, len(names), per_pass):
            for node, r, f, cut, n, s, n_left, s_left in _pass(binned, lattice, {k: asks[k] for k in names[at : at + per_pass]}, rules):
                splits[node, r] = f, cut, n, s, n_left, s_left
                if f >= 0 and level + 1 < deepest[r, lattice.nodes[node][0]]:
                    for child, rows in zip(lattice.children(node, f, cut), (n_left, n - n_left)):
                        if rows >= max(least[r], 2 * rules[r].leaf_rows):
                            below[child].append(r)
        asks, level = below, level + 1
    return [
        Forest([_tree(lattice, splits, r, fit, tree, binned) for tree in range(fit.trees)], binned.edges)
        for fit, r in zip(fits, of_fit)
    ]


def _tree(lattice: _Lattice, splits: dict, r: int, fit: Fit, tree: int, binned: Binned) -> Tree:
    root = lattice.node(tree)
    _, _, n, s, _, _ = splits.get((root, r), (-1, 0, 0, 0, 0, 0))
    feature, cut, left, right, value, rows = [], [], [], [], [], []
    deep, open_ = 0, [(root, 0, n, s, None)]
    while open_:
        node, depth, n, s, origin = open_.pop()
        me, deep = len(feature), max(deep, depth)
        if origin:
            (left if origin[1] == 0 else right)[origin[0]] = me
        f, at, _, _, n_left, s_left = splits.get((node, r), (-1, 0, 0, 0, 0, 0))
        inner = f >= 0 and depth < fit.depth and n >= fit.split_rows
        feature.append(f if inner else 0)
        cut.append(at if inner else BINS)
        left.append(me), right.append(me), rows.append(n)
        value.append(binned.center + (binned.unit * s / n if n else 0.0))
        if inner:
            low, high = lattice.children(node, f, at)
            open_ += [(high, depth + 1, n - n_left, s - s_left, (me, 1)), (low, depth + 1, n_left, s_left, (me, 0))]
    kinds = (np.int32, np.int16, np.int32, np.int32, np.float64, np.int64)
    return Tree(*[np.array(c, k) for c, k in zip((feature, cut, left, right, value, rows), kinds)], deep)


# Scores


def rmse_of(binned: Binned, forests: Sequence[Forest], scored: Sequence[frozenset[int]]) -> list[float]:
    """Root mean squared error of each forest on its own row classes, in one pass over all rows."""
    width, center, unit = len(binned.edges), binned.center, binned.unit
    plain = [(sorted(classes), [tuple(t) for t in forest.trees]) for forest, classes in zip(forests, scored)]
    sent = binned.rows.sparkSession.sparkContext.broadcast(plain)
    read = binned.groups.rows.where("tree < 0") if binned.groups else binned.rows

    def errors(batches):
        models = [(classes, [Tree(*t) for t in trees]) for classes, trees in sent.value]
        for _, row_class, y, bins, *group in _gathered(batches, width):
            n, spread = group or (np.ones(len(y), np.int64), np.zeros(len(y)))
            label, out, parts = center + unit * (y / n), [], {}
            for number, (classes, trees) in enumerate(models):
                found = tuple(classes)
                if found not in parts:
                    at = np.flatnonzero(np.isin(row_class, classes))
                    parts[found] = at, bins[:, at], int(n[at].sum()), unit * unit * float(spread[at].sum())
                at, part, rows, inner = parts[found]
                if len(at):
                    gap = label[at] - predicted(trees, part)
                    out.append((number, rows, float(n[at] @ gap**2) + inner))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["model", "n", "error"])

    sums = read.mapInArrow(errors, "model int, n long, error double").groupBy("model").agg(
        F.sqrt(F.sum("error") / F.sum("n")).alias("rmse")
    )
    found = {r.model: r.rmse for r in sums.collect()}  # one row per forest
    return [found.get(number, math.nan) for number in range(len(forests))]
