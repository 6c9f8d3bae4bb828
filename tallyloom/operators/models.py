"""Regression baselines: constant predictor, forests, two searches, learning curve.

All fits of a search or curve are grown together, one pass over the train rows per depth, and scored in one more pass.
The driver holds parameter draws, trees and one score per fit. A random search with too many nodes for that grows its trees
in the tasks, and the driver holds no trees.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.scalars import squared_error
from tallyloom.operators import deep_forests, forests
from tallyloom.operators.features import FRACTION_PERCENTS, fold_of, fraction_bucket
from tallyloom.operators.stats import grouped_summary

# The search space and the settings of both searches.
TREES = range(80, 401)
DEPTHS = range(3, 22)
LEAF_ROWS = range(1, 8)
SPLIT_ROWS = range(2, 12)
SUBSETS = ["sqrt", "log2", "all"]
SEARCH_DRAWS, SEARCH_FOLDS = 40, 3
ANNEAL_STEPS, ANNEAL_START, ANNEAL_COOLING = 60, 3.0, 0.93

Params = dict[str, Any]


class SearchResult(NamedTuple):
    model: Any
    params: Params
    score: float
    trace: DataFrame


def constant_predictions(train: DataFrame, test: DataFrame, strategies: dict[str, str] | None = None) -> DataFrame:
    """(model, label, prediction): one value for all test rows, the exact median or the mean of the train labels.

    All centers come from one summary of the train rows and reach the test rows as a one-row subquery.
    """
    strategies = strategies or {"Dummy": "median"}
    center = grouped_summary(train, (), [F.avg("label").alias("mean")], "label", {"median": 0.5})
    models = lambda c: F.array(*[
        F.struct(F.lit(model).alias("model"), F.col("label"), c[kind].alias("prediction"))
        for model, kind in strategies.items()
    ])
    row = center.select(F.struct("*").alias("c")).scalar()
    return test.select("label", row.alias("_c")).select(F.inline(models(F.col("_c"))))


def draw_params(
    rng: random.Random, trees: Sequence[int] = TREES, depths: Sequence[int] = DEPTHS,
    leaf_rows: Sequence[int] = LEAF_ROWS, subsets: Sequence[str] = SUBSETS, split_rows: Sequence[int] = SPLIT_ROWS,
) -> Params:
    """One draw of forest parameters; ``minRowsToSplit`` is the least number of rows that a node needs to be split."""
    return {
        "numTrees": rng.choice(trees),
        "maxDepth": rng.choice(depths),
        "minInstancesPerNode": rng.choice(leaf_rows),
        "featureSubsetStrategy": rng.choice(subsets),
        "minRowsToSplit": rng.choice(split_rows),
    }


def _fit(params: Params, classes: Sequence[int], width: int) -> forests.Fit:
    """The defaults are those of a forest that is not searched."""
    whole = {"numTrees": 20, "maxDepth": 5, "minInstancesPerNode": 1, "featureSubsetStrategy": "all", "minRowsToSplit": 2, **params}
    return forests.Fit(
        frozenset(classes), whole["numTrees"], whole["maxDepth"], whole["minInstancesPerNode"], whole["minRowsToSplit"],
        forests.feature_count(whole["featureSubsetStrategy"], width),
    )


def fit_forest(train: DataFrame, key: Sequence[str], params: Params | None = None, seed: int = 0) -> forests.Forest:
    """One forest on all rows that have a label. ``key`` names the columns whose hash decides which trees a row is in."""
    binned = forests.bin_rows(train, key, F.lit(0), 1)
    return forests.grow(binned, [_fit(params or {}, [0], len(binned.edges))], seed)[0]


def rmse(predictions: DataFrame) -> float:
    error = squared_error(F.col("label"), F.col("prediction"))
    return float(predictions.agg(F.sqrt(F.avg(error)).alias("rmse")).first().rmse)


def random_search(
    train: DataFrame, key: Sequence[str], draws: int = SEARCH_DRAWS, folds: int = SEARCH_FOLDS, seed: int = 0, **space: Sequence,
) -> SearchResult:
    """Cross-validated search over random draws; the best draw's model is fitted on the whole train part.

    Folds follow the hash of the row key. The trace has one row per draw with its mean RMSE. Small forests of all draws and
    folds, and of all draws on the whole train part, are grown in the same passes. Those with more nodes than the driver
    should hold grow whole in the tasks, and only the best draw is fitted on the whole train part.
    """
    rng = random.Random(seed)
    candidates = [draw_params(rng, **space) for _ in range(draws)]
    binned = forests.bin_rows(train, key, fold_of(key, folds), folds)
    kept = [[k for k in range(folds) if k != out] for out in range(folds)]
    fits = [_fit(p, classes, len(binned.edges)) for p in candidates for classes in [*kept, range(folds)]]
    trees = max(fit.trees for fit in fits)
    held = deep_forests.holds(binned, trees, seed) if forests.most_nodes(fits) > forests.DRIVER_NODES else None
    if held:
        judged_fits = [fit for i, fit in enumerate(fits) if i % (folds + 1) < folds]
        scores = deep_forests.scores(held, judged_fits, [*range(folds)] * draws, seed)
        whole_fit = lambda i: deep_forests.grow(held, fits[i * (folds + 1) + folds], seed)
    else:
        binned = forests.grouped(binned, trees, seed)
        grown = forests.grow(binned, fits, seed)
        judged = [(grown[i * (folds + 1) + out], frozenset([out])) for i in range(draws) for out in range(folds)]
        scores = forests.rmse_of(binned, *zip(*judged))
        whole_fit = lambda i: grown[i * (folds + 1) + folds]
    measured = [[x for x in scores[i * folds:(i + 1) * folds] if not math.isnan(x)] for i in range(draws)]  # a fold may be empty
    means = [sum(found) / len(found) for found in measured]
    best = min(range(draws), key=means.__getitem__)
    trace = train.sparkSession.createDataFrame(list(enumerate(means)), "iter INT, score DOUBLE")
    return SearchResult(whole_fit(best), candidates[best], means[best], trace)


def annealed_search(
    train: DataFrame, held_out: Column, key: Sequence[str], steps: int = ANNEAL_STEPS, seed: int = 0,
    start: float = ANNEAL_START, cooling: float = ANNEAL_COOLING, **space: Sequence,
) -> SearchResult:
    """Annealed search over ``steps`` + 1 draws, scored on the train rows for which ``held_out`` is true.

    A draw does not depend on the current state, and a draw below the best score is always accepted. So all
    forests grow in the same passes, the result is the best of all draws, and acceptance only shapes the trace. The
    uniform number of each step is drawn up front, which makes the trace repeatable. The model is the best draw's,
    fitted on all train rows.
    """
    rng = random.Random(seed)
    candidates = [draw_params(rng, **space) for _ in range(steps + 1)]
    chances = [rng.random() for _ in candidates]
    binned = forests.bin_rows(train, key, F.coalesce(held_out, F.lit(False)).cast("int"), 2)
    fits = [_fit(p, classes, len(binned.edges)) for classes in ([0], [0, 1]) for p in candidates]
    binned = forests.grouped(binned, max(fit.trees for fit in fits), seed)
    grown = forests.grow(binned, fits, seed)
    scores = forests.rmse_of(binned, grown[: len(candidates)], [frozenset([1])] * len(candidates))
    best = min(range(len(scores)), key=scores.__getitem__)
    scored = train.sparkSession.createDataFrame(
        list(zip(range(len(scores)), scores, chances)), "iter INT, score DOUBLE, u DOUBLE"
    )
    trace = anneal_history(scored, start=start, cooling=cooling)
    return SearchResult(grown[len(candidates) + best], candidates[best], scores[best], trace)


def anneal_history(
    scored: DataFrame, by: Sequence[str] = (), start: float = ANNEAL_START, cooling: float = ANNEAL_COOLING,
) -> DataFrame:
    """Current score after each step of a search, replayed from the scored draws.

    A draw is accepted if it is better than the current one or if ``u`` is below exp(gain / temperature); the
    temperature cools by a factor per step. The replay depends on the step before, so a search is one fold over its
    ordered draws; each of its steps stands for a model fit. Different searches are replayed side by side.
    """
    draw = F.struct(F.col("iter").cast("int").alias("iter"), F.col("score").cast("double").alias("score"), "u")
    searches = scored.groupBy(*by).agg(F.array_sort(F.collect_list(draw)).alias("steps"))
    nothing = F.struct(F.lit(None).cast("double").alias("current"), F.array().cast("array<double>").alias("scores"))

    def step(state: Column, draw: Column) -> Column:
        heat = F.greatest(F.lit(start) * F.pow(F.lit(cooling), draw["iter"] - 1), F.lit(1e-8))
        chance = F.exp(F.least(F.lit(0.0), (state["current"] - draw["score"]) / heat))
        taken = state["current"].isNull() | (draw["score"] < state["current"]) | (draw["u"] < chance)
        current = F.when(taken, draw["score"]).otherwise(state["current"])
        return F.struct(current.alias("current"), F.array_append(state["scores"], current).alias("scores"))

    replayed = F.aggregate("steps", nothing, step, lambda state: state["scores"])
    pairs = F.zip_with("steps", replayed, lambda draw, score: F.struct(draw["iter"].alias("iter"), score.alias("score")))
    return searches.select(*by, F.inline(pairs))


def learning_curve(
    train: DataFrame, test: DataFrame, key: Sequence[str], params: Params, percents: Sequence[int] = FRACTION_PERCENTS,
    seed: int = 0,
) -> DataFrame:
    """Test RMSE of a forest per train fraction; 100 percent means all train rows.

    The fractions are nested, so the class of a row is the first fraction that holds it, and a fraction's histograms are
    the sums of the classes up to its own: one set of passes grows the forests of all fractions. Bins come from all train rows.
    """
    percents = sorted(percents)
    first = sum((fraction_bucket(key) >= p).cast("int") for p in percents)
    binned = forests.bin_rows(train, key, first, len(percents) + 1)
    fits = [_fit(params, range(i + 1), len(binned.edges)) for i in range(len(percents))]
    grown = forests.grow(forests.grouped(binned, fits[0].trees, seed), fits, seed)
    judged = forests.bin_rows(test, key, F.lit(0), 1, like=binned)
    scores = forests.rmse_of(judged, grown, [frozenset([0])] * len(grown))
    rows = [(p / 100.0, score) for p, score in zip(percents, scores)]
    return train.sparkSession.createDataFrame(rows, "fraction DOUBLE, rmse DOUBLE")
