"""Forecasts that need no fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidegrid.config import DEFAULT, DemandConfig
from tidegrid.operators.blocks import over_series

# The candidates and their season in hours.
CANDIDATES = ("naive_24", "naive_168", "mean_24")


def candidate_columns(
    panel: DataFrame, config: DemandConfig = DEFAULT, dense: bool = True
) -> DataFrame:
    """Yesterday's hour, last week's hour and the mean of the last day, one column each."""
    value = F.col(config.target).cast("double")

    def build(w: WindowSpec):
        return {
            "naive_24": F.lag(value, 24).over(w),
            "naive_168": F.lag(value, 168).over(w),
            "mean_24": F.avg(value).over(w.rowsBetween(-24, -1)),
        }

    return over_series(
        panel, config.key, config.time, build, before=168, block_hours=config.block_hours if dense else None
    )


def seasonal_naive(
    panel: DataFrame, season: int = 24, config: DemandConfig = DEFAULT, dense: bool = True
) -> DataFrame:
    value = F.col(config.target).cast("double")
    return over_series(
        panel, config.key, config.time, lambda w: {"prediction": F.lag(value, season).over(w)},
        before=season, block_hours=config.block_hours if dense else None,
    )


def long_predictions(wide: DataFrame, models, config: DemandConfig = DEFAULT) -> DataFrame:
    """(key, hour, actual, model, predicted) from one column per model."""
    actual = F.col(config.target).cast("double").alias("actual")
    return wide.select(config.key, config.time, actual, *models).unpivot(
        [config.key, config.time, "actual"], list(models), "model", "predicted"
    )
