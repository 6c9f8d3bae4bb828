"""Forests grown together against plain Python trees on the same bins, against single fits and against Spark ML."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tallyloom.operators import deep_forests, features, forests, models
from tallyloom.plans import catalog


@pytest.fixture(scope="module")
def rows(spark):
    wave = F.col("a") * 3 + F.pow(F.col("b") - 6, 2) + F.when(F.col("c") > 0, 25).otherwise(0) + F.pmod(F.xxhash64("id"), F.lit(7))
    frame = spark.range(1500).select(
        "id", (F.pmod(F.xxhash64(F.lit("a"), "id"), F.lit(1000)) / 50).alias("a"),
        F.pmod(F.xxhash64(F.lit("b"), "id"), F.lit(13)).cast("double").alias("b"), (F.col("id") % 2).cast("double").alias("c"),
    ).withColumn("label", wave.cast("double"))
    made = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(frame).select("id", "features", "label")
    return made.repartition(5).persist()


@pytest.fixture(scope="module")
def binned(rows):
    return forests.bin_rows(rows, ["id"], features.fold_of(["id"], 3), 3)


def local_rows(binned):
    table = binned.rows.toArrow()
    bins = np.stack([np.frombuffer(b, np.uint8) for b in table.column("bins").to_pylist()])
    return tuple(table.column(c).to_numpy() for c in ("draw", "class", "y")) + (bins,)


def plain_tree(local, fit, tree, seed, width):
    """Recursive tree over Python integers: {box: (rows, sum, split)} of all its nodes."""
    draw, row_class, y, bins = local
    bag = forests.bag_weights(draw, tree, seed)
    nodes = {}

    def grow(at, box, depth):
        n, s = sum(int(bag[i]) for i in at), sum(int(bag[i]) * int(y[i]) for i in at)
        nodes[box] = n, s, None
        if depth == fit.depth or n < fit.split_rows:
            return
        best = None
        best_gain = s * (s / n) + 1e-12 * abs(s * (s / n)) if n else 0.0
        for f in sorted(forests.feature_order(seed, tree, box, width)[: fit.features]):
            for cut in range(forests.BINS - 1):
                left = [i for i in at if bins[i, f] <= cut]
                nl, sl = sum(int(bag[i]) for i in left), sum(int(bag[i]) * int(y[i]) for i in left)
                if min(nl, n - nl) < max(1, fit.leaf_rows):
                    continue
                gain = float(sl) ** 2 / nl + float(s - sl) ** 2 / (n - nl)
                if gain > best_gain:
                    best, best_gain = (f, cut), gain
        nodes[box] = n, s, best
        if best:
            f, cut = best
            ranges = {g: (low, high) for g, low, high in box}
            low, high = ranges.get(f, (0, forests.BINS - 1))
            side = lambda r: tuple(sorted((g, *x) for g, x in {**ranges, f: r}.items()))
            grow([i for i in at if bins[i, f] <= cut], side((low, cut)), depth + 1)
            grow([i for i in at if bins[i, f] > cut], side((cut + 1, high)), depth + 1)

    grow([i for i in range(len(y)) if bag[i] and row_class[i] in fit.classes], (), 0)
    return nodes


def boxes_of(tree, binned):
    nodes, open_ = {}, [(0, ())]
    while open_:
        at, box = open_.pop()
        leaf = tree.left[at] == at
        f, cut = int(tree.feature[at]), int(tree.cut[at])
        nodes[box] = int(tree.rows[at]), round((float(tree.value[at]) - binned.center) / binned.unit * int(tree.rows[at])), None if leaf else (f, cut)
        if not leaf:
            ranges = {g: (low, high) for g, low, high in box}
            low, high = ranges.get(f, (0, forests.BINS - 1))
            side = lambda r: tuple(sorted((g, *x) for g, x in {**ranges, f: r}.items()))
            open_ += [(int(tree.left[at]), side((low, cut))), (int(tree.right[at]), side((cut + 1, high)))]
    return nodes


FITS = [
    forests.Fit(frozenset([0, 1]), 2, 4, 1, 2, 3), forests.Fit(frozenset([0, 1]), 2, 3, 1, 2, 3), forests.Fit(frozenset([0, 2]), 2, 4, 5, 2, 2),
    forests.Fit(frozenset([0, 1, 2]), 1, 4, 1, 150, 3), forests.Fit(frozenset([0, 1, 2]), 1, 4, 90, 400, 2), forests.Fit(frozenset([1]), 1, 0, 1, 2, 1),
]


def test_every_node_equals_a_plain_tree(binned):
    local = local_rows(binned)
    for fit, forest in zip(FITS, forests.grow(binned, FITS, seed=5)):
        assert len(forest.trees) == fit.trees
        for number, tree in enumerate(forest.trees):
            want, got = plain_tree(local, fit, number, 5, 3), boxes_of(tree, binned)
            assert set(want) == set(got) and tree.depth <= fit.depth
            for box, (n, s, split) in want.items():
                assert got[box][0] == n and got[box][2] == split and abs(got[box][1] - s) <= 1 + 1e-6 * abs(s)
                assert split is None or n >= fit.split_rows


def test_fits_do_not_depend_on_company_or_partitions(binned):
    together = forests.grow(binned, FITS, seed=5)
    dealt = binned._replace(rows=binned.rows.repartition(9))
    for fit, forest in zip(FITS, together):
        alone = forests.grow(dealt, [fit], seed=5)[0]
        for a, b in zip(forest.trees, alone.trees):
            assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_small_passes_give_the_same_forests(binned, monkeypatch):
    whole = forests.grow(binned, FITS[:3], seed=5)
    monkeypatch.setattr(forests, "CELLS_AT_ONCE", 3 * 3 * forests.BINS * 2)  # two nodes a pass
    monkeypatch.setattr(forests, "ROWS_AT_ONCE", 100)
    for a, b in zip(whole, forests.grow(binned, FITS[:3], seed=5)):
        assert all(np.array_equal(x, y) for s, t in zip(a.trees, b.trees) for x, y in zip(s, t))


def test_number_of_jobs_follows_the_depth(binned, spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("grow", "all fits")
    try:
        many = [forests.Fit(frozenset({0, 1, 2} - {k}), 6, 4, leaf, 2, m) for k in range(3) for leaf in (1, 2, 5) for m in (2, 3)]
        forests.grow(binned, many, seed=1)
        assert len(tracker.getJobIdsForGroup("grow")) <= 3 * 4  # a pass is one query of up to three stages, each a job with AQE
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_bins_are_consistent_with_cuts(rows, binned):
    x = np.array([[binned.edges[f][0] for f in range(3)], [1e9] * 3, [-1e9] * 3, [math.nan] * 3])
    bins = forests.bin_matrix(x, binned.edges)
    assert bins[:, 0].tolist() == [0, 0, 0] and bins[:, 2].tolist() == [0, 0, 0]
    assert bins[:, 1].tolist() == bins[:, 3].tolist() == [len(e) for e in binned.edges]
    assert all(len(e) < forests.BINS for e in binned.edges)


def test_error_is_that_of_transformed_rows_and_close_to_spark_ml(rows, binned):
    fits = [forests.Fit(frozenset([0, 1]), 10, 5, 1, 2, 3)]
    grown = forests.grow(binned, fits, seed=2)
    valid, fitted = (rows.where(features.fold_of(["id"], 3) == 2), rows.where(features.fold_of(["id"], 3) != 2))
    scores = forests.rmse_of(binned, grown, [frozenset([2])])
    assert scores[0] == pytest.approx(models.rmse(grown[0].transform(valid)), rel=1e-6)
    library = RandomForestRegressor(numTrees=10, maxDepth=5, featureSubsetStrategy="all", seed=2).fit(fitted).transform(valid)
    assert scores[0] == pytest.approx(models.rmse(library), rel=0.03)


def test_searches_score_and_refit_like_single_fits(rows):
    space = {"trees": [3, 5], "depths": [3, 4], "split_rows": [2, 60]}
    found = models.random_search(rows, ["id"], draws=4, folds=2, seed=3, **space)
    binned = forests.bin_rows(rows, ["id"], features.fold_of(["id"], 2), 2)
    rng = random.Random(3)
    candidates = [models.draw_params(rng, **space) for _ in range(4)]
    want = []
    for p in candidates:
        errors = []
        for k in range(2):
            alone = forests.grow(binned, [models._fit(p, [1 - k], 3)], 3)
            errors += forests.rmse_of(binned, alone, [frozenset([k])])
        want.append(sum(errors) / 2)
    got = [r.score for r in found.trace.orderBy("iter").collect()]
    assert got == pytest.approx(want, rel=1e-12) and found.score == min(got) and found.params == candidates[got.index(min(got))]
    whole = models.fit_forest(rows, ["id"], found.params, 3)
    assert all(np.array_equal(x, y) for s, t in zip(whole.trees, found.model.trees) for x, y in zip(s, t))
    annealed = models.annealed_search(rows, F.col("id") % 4 == 0, ["id"], steps=3, seed=3, **space)
    assert annealed.trace.count() == 4
    assert all(np.array_equal(x, y) for s, t in zip(models.fit_forest(rows, ["id"], annealed.params, 3).trees, annealed.model.trees) for x, y in zip(s, t))


def test_learning_curve_equals_separate_fits(rows):
    test, train = rows.where("id % 5 = 0"), rows.where("id % 5 <> 0")
    params = {"numTrees": 4, "maxDepth": 4, "minRowsToSplit": 8}
    curve = {r.fraction: r.rmse for r in models.learning_curve(train, test, ["id"], params, [20, 60, 100], seed=1).collect()}
    all_bins = forests.bin_rows(train, ["id"], F.lit(0), 1)
    for percent, got in curve.items():
        part = train.where(features.fraction_bucket(["id"]) < round(100 * percent))
        alone = forests.grow(forests.bin_rows(part, ["id"], F.lit(0), 1, like=all_bins), [models._fit(params, [0], 3)], 1)[0]
        assert got == pytest.approx(models.rmse(alone.transform(test)), rel=1e-6)


def test_awkward_rows(spark):
    from pyspark.ml.linalg import Vectors

    data = [(i, Vectors.dense([float(i % 3), float("nan") if i % 4 == 0 else 1.0]), None if i % 10 == 0 else float("nan") if i % 10 == 1 else 5.0) for i in range(40)]
    train = spark.createDataFrame(data, ["id", "features", "label"])
    forest = models.fit_forest(train, ["id"], {"numTrees": 3})
    assert {t.depth for t in forest.trees} == {0}  # equal labels leave nothing to split
    assert {r.prediction for r in forest.transform(train).collect()} == {5.0}
    one = models.fit_forest(train.where("id = 2"), ["id"], {"numTrees": 2})
    assert {r.prediction for r in one.transform(train).collect()} == {5.0}
    few = models.random_search(train.where("id IN (2, 3)"), ["id"], draws=2, folds=9, trees=[2], depths=[2])
    assert few.score == 0.0 and few.trace.count() == 2  # most folds are empty
    with pytest.raises(ValueError, match="no training rows"):
        models.fit_forest(train.where("label < 0"), ["id"])


def test_rows_of_equal_bins_are_grouped(spark, rows, monkeypatch):
    copies = rows.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).select(
        (F.col("copy") * 10_000 + F.col("id")).alias("id"), "features", (F.col("label") + F.col("copy") / 8).alias("label")
    )
    binned = forests.bin_rows(copies, ["id"], features.fold_of(["id"], 3), 3)
    grouped = forests.grouped(binned, 2, 5)
    plain = binned.rows.count()
    for tree in (-1, 0, 1):  # tree -1 counts every row once
        part = grouped.groups.rows.where(F.col("tree") == tree)
        local = local_rows(binned)
        bag = np.ones(plain, int) if tree < 0 else forests.bag_weights(local[0], tree, 5).astype(int)
        found = part.agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.count("*").alias("groups")).first()
        assert (found.n, found.y) == (bag.sum(), (bag * local[2]).sum()) and found.groups * 10 < plain
    fits = [fit for fit in FITS if fit.trees == 2]
    with_groups = forests.grow(grouped, fits, seed=5)
    monkeypatch.setattr(forests, "ROWS_AT_ONCE", 1000)  # groups cut at the ends of pieces add up
    for other in (forests.grow(binned, fits, seed=5), forests.grow(forests.grouped(binned, 2, 5), fits, seed=5)):
        for a, b in zip(with_groups, other):
            assert all(np.array_equal(x, y) for s, t in zip(a.trees, b.trees) for x, y in zip(s, t))
    scored = [frozenset([0]), frozenset([1, 2]), frozenset([2])]
    assert forests.rmse_of(grouped, with_groups, scored) == pytest.approx(forests.rmse_of(binned, with_groups, scored), rel=1e-10)
    # Groups of other bags are left aside.
    for a, b in zip(forests.grow(binned, fits[:1], seed=6), forests.grow(grouped, fits[:1], seed=6)):
        assert all(np.array_equal(x, y) for s, t in zip(a.trees, b.trees) for x, y in zip(s, t))
    assert forests.grouped(binned, 1000, 5).groups is None  # more sums than rows


def test_searches_read_groups_instead_of_rows(spark, rows, monkeypatch):
    """The rows that passes and scores read follow the combinations of bins, not the copies."""
    read, one_pass, score = [], forests._pass, forests.rmse_of
    size = lambda binned: (binned.groups.rows.where("tree = 0") if getattr(binned, "groups", None) else binned.rows).count()
    monkeypatch.setattr(forests, "_pass", lambda binned, *more: read.append(size(binned)) or one_pass(binned, *more))
    monkeypatch.setattr(forests, "rmse_of", lambda binned, *more: read.append(size(binned)) or score(binned, *more))
    copies = rows.crossJoin(spark.range(20).withColumnRenamed("id", "copy")).select(
        (F.col("copy") * 10_000 + F.col("id")).alias("id"), "features", "label"
    )
    models.random_search(copies, ["id"], draws=2, folds=2, trees=[2], depths=[2])
    assert len(read) == 3 and max(read) < 1500 * 20 / 5


def test_sums_of_groups_are_exact():
    values = np.array([(1 << 57) + 1, -(1 << 57) + 3, (1 << 54) + 1, -5, 7, (1 << 53) + 1], np.int64)
    assert forests._sums(np.array([0, 2, 0, 2, 3, 3]), values, 5).tolist() == [
        (1 << 57) + (1 << 54) + 2, 0, -(1 << 57) - 2, (1 << 53) + 8, 0
    ]


def test_arrays_and_many_features_give_the_same_bins(rows, binned, monkeypatch):
    from pyspark.ml.functions import vector_to_array

    arrays = rows.withColumn("features", vector_to_array("features"))
    monkeypatch.setattr(forests, "AGGREGATES_AT_ONCE", 2)
    other = forests.bin_rows(arrays, ["id"], features.fold_of(["id"], 3), 3)
    assert all(np.array_equal(a, b) for a, b in zip(binned.edges, other.edges))
    assert sorted(map(tuple, binned.rows.collect())) == sorted(map(tuple, other.rows.collect()))
    forest = forests.grow(binned, FITS[:1], seed=1)[0]
    got = [{r.id: r.prediction for r in forest.transform(frame).collect()} for frame in (rows, arrays)]
    assert got[0] == got[1] and len(got[0]) == 1500


def test_plain_expressions_equal_the_encoder(spark):
    from pyspark.ml.functions import vector_to_array

    data = [(1, 2.5, "A"), (2, None, "N"), (3, -1.0, None), (4, 0.0, "N"), (5, 7.0, "unseen"), (None, 1.0, "B")]
    frame = spark.createDataFrame(data, "a INT, b DOUBLE, c STRING")
    model = features.fit_encoder(frame.where("c IS NULL OR c <> 'unseen'"), ["a", "b"], ["c"])
    both = model.transform(frame).select(vector_to_array("features").alias("x"), features.encoded_values(model, ["a", "b"], ["c"]).alias("y"))
    rows = both.collect()
    assert len(rows) == 6 and all(np.array_equal(r.x, r.y, equal_nan=True) and len(r.y) == 5 for r in rows)


DEEP = [
    forests.Fit(frozenset([0, 1]), 2, 21, 1, 2, 3), forests.Fit(frozenset([0, 1]), 3, 12, 1, 9, 2), forests.Fit(frozenset([0, 1]), 2, 9, 3, 2, 2),
    forests.Fit(frozenset([0, 2]), 3, 15, 7, 11, 3), forests.Fit(frozenset([0, 2]), 1, 3, 2, 2, 3), forests.Fit(frozenset([0, 2]), 3, 20, 2, 5, 3),
    forests.Fit(frozenset([0, 2]), 2, 0, 1, 2, 1), forests.Fit(frozenset([1, 2]), 2, 6, 5, 10_000, 2), forests.Fit(frozenset([1, 2]), 2, 21, 90, 2, 2),
]


@pytest.mark.parametrize("most_rows", [1 << 20, 1000])
def test_trees_grown_in_tasks_equal_those_of_passes(spark, rows, monkeypatch, most_rows):
    """Trees and scores of whole trees in tasks, which read rows or groups of them."""
    copies = rows.where("id < 400").crossJoin(spark.range(3).withColumnRenamed("id", "copy")).select(
        (F.col("copy") * 10_000 + F.col("id")).alias("id"), "features", (F.col("label") + F.col("copy") / 8).alias("label")
    )
    binned = forests.bin_rows(copies, ["id"], features.fold_of(["id"], 3), 3)
    monkeypatch.setattr(deep_forests, "ROWS_PER_TASK", most_rows)
    held = deep_forests.holds(binned, 3, 5)
    assert (held.groups is None) == (most_rows > 1200)
    wanted = forests.grow(binned, DEEP, seed=5)
    scored = [next(k for k in range(3) if k not in fit.classes) for fit in DEEP]
    assert deep_forests.scores(held, DEEP, scored, 5) == pytest.approx(forests.rmse_of(binned, wanted, [frozenset([k]) for k in scored]), rel=1e-10)
    for fit, forest in list(zip(DEEP, wanted))[:6:2]:
        stored = deep_forests.grow(held, fit, 5)
        assert all(np.array_equal(x, y) for s, t in zip(stored.trees, forest.trees, strict=True) for x, y in zip(s, t))
        monkeypatch.setattr(deep_forests, "TREES_AT_ONCE", 2)
        monkeypatch.setattr(deep_forests, "CELLS_AT_ONCE", 100)
        got, want = ({r.id: r.prediction for r in f.transform(copies).collect()} for f in (stored, forest))
        assert got == pytest.approx(want, rel=1e-12) and len(got) == 1200
    monkeypatch.setattr(deep_forests, "ROWS_PER_TASK", 10)
    assert deep_forests.holds(binned, 1000, 5) is None  # too many rows and groups for a task


def test_a_search_is_the_same_in_tasks_and_by_passes(rows, monkeypatch):
    space = {"trees": [2, 3], "depths": [3, 6]}
    by_passes = models.random_search(rows, ["id"], draws=3, folds=3, seed=4, **space)
    monkeypatch.setattr(forests, "DRIVER_NODES", 0)
    in_tasks = models.random_search(rows, ["id"], draws=3, folds=3, seed=4, **space)
    assert in_tasks.params == by_passes.params
    scores = [[r.score for r in found.trace.orderBy("iter").collect()] for found in (in_tasks, by_passes)]
    assert scores[0] == pytest.approx(scores[1], rel=1e-12)
    assert all(np.array_equal(x, y) for s, t in zip(in_tasks.model.trees, by_passes.model.trees, strict=True) for x, y in zip(s, t))
    few = rows.where("id IN (2, 3)")
    assert len(models.random_search(few, ["id"], draws=2, folds=9, trees=[2], depths=[2]).model.trees) == 2  # with empty folds


def test_feature_order_is_that_of_a_sample():
    for width, box in ((1, ()), (3, ((0, 3, 12),)), (7, ((1, 0, 5), (6, 2, 31))), (40, ()), (300, ((250, 0, 1),))):
        want = random.Random(f"5|{width}|{box}").sample(range(width), width)
        assert forests.feature_order(5, width, box, width) == want and forests.feature_order(5, width, box, width, 2) == want[:2]


def test_sums_beyond_a_double_are_exact():
    """A tree of cells whose label sums need more than 53 bits, by whole numbers and by the same numbers in Python."""
    n, s = np.array([4, 5, 6, 7]), np.array([(1 << 57) + 1, -(1 << 57) + 3, (1 << 55) + 1, -5])
    grown = deep_forests.grow_nodes(np.array([[0, 1, 2, 3]], np.uint8), np.arange(4), n, s, 0, 0, 1, [1], [1], [2])
    cut = int(grown.cut[0][0])
    assert grown.rows.tolist() == [22, sum(n[: cut + 1]), sum(n[cut + 1 :])]
    assert grown.total.tolist() == [sum(map(int, s)), sum(map(int, s[: cut + 1])), sum(map(int, s[cut + 1 :]))]


def test_registered_search_draws_from_the_full_space(spark, tmp_path, monkeypatch):
    """All draws of the query come from the full space, and its model has all trees of the best one."""
    item = F.pmod(F.xxhash64("l_orderkey"), F.lit(1000))
    spark.range(120).select(
        F.col("id").alias("l_orderkey"), *[F.lit(1).alias(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")],
    ).select(
        "*", (item + 900).cast("double").alias("l_extendedprice"), (item % 11 / 100).alias("l_discount"),
        (item % 9 / 100).alias("l_tax"), (item % 50 + 1).cast("double").alias("l_quantity"),
        F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (item % 3 + 1).cast("int")).alias("l_returnflag"),
    ).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    drawn, found, one_draw, search = [], [], models.draw_params, models.random_search
    monkeypatch.setattr(models, "draw_params", lambda *a, **space: drawn.append(one_draw(*a, **space)) or drawn[-1])
    monkeypatch.setattr(models, "random_search", lambda *a, **space: found.append(search(*a, **space)) or found[-1])
    scores = {r.model: r.RMSE for r in catalog.rf_search(spark, str(tmp_path)).collect()}
    assert scores["RandomSearch_RF"] < scores["Dummy"] and found[0].trace.count() == len(drawn) == models.SEARCH_DRAWS
    rng = random.Random(0)
    assert drawn == [one_draw(rng) for _ in drawn]
    assert max(p["numTrees"] for p in drawn) > 300 and max(p["maxDepth"] for p in drawn) > 15
    assert len(found[0].model.trees) == found[0].params["numTrees"] >= 80
