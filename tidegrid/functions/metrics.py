"""Forecast metrics as aggregates, one result row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.config import DEFAULT, DemandConfig
from tidegrid.operators.blocks import over_series


def _c(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("double")


def rmse(actual: str | Column, predicted: str | Column) -> Column:
    error = _c(actual) - _c(predicted)
    return F.sqrt(F.avg(error * error))


def mae(actual: str | Column, predicted: str | Column) -> Column:
    return F.avg(F.abs(_c(actual) - _c(predicted)))


def smape(actual: str | Column, predicted: str | Column) -> Column:
    """Symmetric percentage error, 0 to 200; a pair of zeros counts as 0."""
    size = F.abs(_c(actual)) + F.abs(_c(predicted))
    ratio = F.when(size == 0, F.lit(0.0)).otherwise(
        F.lit(2.0) * F.abs(_c(actual) - _c(predicted)) / F.nullif(size, F.lit(0.0))
    )
    return F.lit(100.0) * F.avg(ratio)


METRICS = {"rmse": rmse, "mae": mae, "smape": smape}


def evaluate(
    predictions: DataFrame,
    actual: str,
    predicted: str,
    metrics: Sequence[str] = ("rmse", "mae", "smape"),
    by: Sequence[str] = (),
) -> DataFrame:
    """The named metrics per group; raises for an unknown name."""
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; choose from {sorted(METRICS)}")
    return predictions.groupBy(*by).agg(*[METRICS[m](actual, predicted).alias(m) for m in metrics])


def seasonal_scale(
    train: DataFrame,
    target: str,
    season: int = 24,
    by: Sequence[str] = (DEFAULT.key,),
    time: str = DEFAULT.time,
    block_hours: int | None = None,
) -> DataFrame:
    """Mean absolute seasonal difference of each training series, column ``scale``."""
    value = F.col(target).cast("double")
    lagged = over_series(
        train, by, time, lambda w: {"__before": F.lag(value, season).over(w)},
        before=season, block_hours=block_hours,
    )
    return lagged.groupBy(*by).agg(F.avg(F.abs(value - F.col("__before"))).alias("scale"))


def mase(
    predictions: DataFrame,
    train: DataFrame,
    actual: str,
    predicted: str,
    season: int = 24,
    by: Sequence[str] = (DEFAULT.key,),
    time: str = DEFAULT.time,
    block_hours: int | None = None,
) -> DataFrame:
    """Scaled error per series; infinite where the training scale is 0."""
    scale = seasonal_scale(train, actual, season, by, time, block_hours)
    errors = predictions.groupBy(*by).agg(mae(actual, predicted).alias("mae"))
    ratio = F.when(F.col("scale") == 0, F.lit(float("inf"))).otherwise(
        F.col("mae") / F.nullif(F.col("scale"), F.lit(0.0))
    )
    return errors.join(scale, list(by)).withColumn("mase", ratio)


def wrmsse(
    predictions: DataFrame, weights: DataFrame, actual: str, predicted: str, by: Sequence[str] = (DEFAULT.key,)
) -> DataFrame:
    """Weighted scaled error. ``weights`` has ``weight`` and ``scale`` per series; scale 0 counts as 1."""
    error = _c(actual) - _c(predicted)
    per_series = predictions.groupBy(*by).agg(F.avg(error * error).alias("mse")).join(weights, list(by))
    scale = F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale"))
    return per_series.agg(F.sum(F.col("weight") * F.sqrt(F.col("mse") / scale)).alias("wrmsse"))


def compute_all_metrics(
    predictions: DataFrame,
    actual: str,
    predicted: str,
    train: DataFrame | None = None,
    weights: DataFrame | None = None,
    season: int = 24,
    config: DemandConfig = DEFAULT,
) -> DataFrame:
    """One row: rmse, mae, smape; ``mase`` (mean over series) with ``train``; ``wrmsse`` with ``weights``."""
    row = evaluate(predictions, actual, predicted)
    if train is not None:
        per_series = mase(predictions, train, actual, predicted, season, (config.key,), config.time)
        row = row.withColumn("mase", per_series.agg(F.avg("mase")).scalar())
    if weights is not None:
        row = row.withColumn("wrmsse", wrmsse(predictions, weights, actual, predicted, (config.key,)).scalar())
    return row


def add_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Residual, absolute error and percent error (divisor at least 1)."""
    residual = F.col(actual) - F.col(predicted)
    return df.withColumns(
        {
            "residual": residual,
            "abs_error": F.abs(residual),
            "pct_error": F.abs(residual) / F.greatest(F.col(actual), F.lit(1)) * F.lit(100.0),
        }
    )


def accuracy_label(rmse_value: str | Column) -> Column:
    # Limits and texts of the accuracy label.
    value = _c(rmse_value)
    return F.when(value < 9.5, "Strong").when(value < 11.0, "Acceptable").otherwise("Needs work")


def round_count(predicted: str | Column) -> Column:
    """Half-even rounding to a count, never negative."""
    return F.greatest(F.bround(_c(predicted), 0), F.lit(0.0)).cast("int")


def round_rate(predicted: str | Column, digits: int = 2) -> Column:
    return F.bround(F.greatest(_c(predicted), F.lit(0.0)), digits)


def percent_difference(predicted: str | Column, actual: str | Column) -> Column:
    """(predicted − actual) / actual in percent, NULL unless actual is positive."""
    a, p = _c(actual), _c(predicted)
    return F.when(a > 0, (p - a) / F.nullif(a, F.lit(0.0)) * F.lit(100.0))
