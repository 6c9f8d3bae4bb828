"""Error metrics of predictions, and the metric tables in wide and long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.scalars import absolute_error, relative_error, squared_error
from tallyloom.schemas import METRICS


def error_metrics(
    predictions: DataFrame, by: Sequence[str] = ("model",), y: str = "label", predicted: str = "prediction"
) -> DataFrame:
    """MAE, RMSE, R2 and MAPE per group in one pass.

    For a constant target R2 is 1 if every prediction is exact and 0 otherwise; for a single row it is NULL.
    """
    target, guess = F.col(y), F.col(predicted)
    n, left, spread = F.count("*"), F.sum(squared_error(target, guess)), F.var_pop(target) * F.count("*")
    r2 = (
        F.when(n < 2, F.lit(None).cast("double"))
        .when(spread > 0, 1 - left / F.nullif(spread, F.lit(0.0)))
        .when(left == 0, 1.0)
        .otherwise(0.0)
    )
    return predictions.groupBy(*by).agg(
        F.avg(absolute_error(target, guess)).alias("MAE"),
        F.sqrt(F.avg(squared_error(target, guess))).alias("RMSE"),
        r2.alias("R2"),
        (F.avg(relative_error(target, guess)) * 100).alias("MAPE"),
    )


def metrics_long(wide: DataFrame) -> DataFrame:
    """(model, metric, value) rows of a wide metric table."""
    return wide.unpivot(["model"], METRICS, "metric", "value")


def metrics_wide(long: DataFrame) -> DataFrame:
    """One row per model with the metrics in their fixed order."""
    return long.groupBy("model").pivot("metric", METRICS).agg(F.max("value"))


def named_metrics(wide: DataFrame) -> DataFrame:
    """(key, value) rows named ``<model>_<metric>``."""
    return metrics_long(wide).select(F.concat_ws("_", "model", "metric").alias("key"), "value")


def metric_series(wide: DataFrame, metric: str) -> DataFrame:
    """One metric over all models, as for a bar chart."""
    return wide.select("model", F.col(metric).alias("value"))


def append_metrics(wide: DataFrame, path: str) -> None:
    """Add the long metric rows to a stored table."""
    metrics_long(wide).write.mode("append").parquet(path)
