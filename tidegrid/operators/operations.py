"""Roll-ups behind the operations, city, zone and pattern views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.config import DEFAULT, DemandConfig
from tidegrid.functions.metrics import percent_difference
from tidegrid.operators.ordered import quantiles


# --- forecast window -------------------------------------------------------

def zone_totals(forecast: DataFrame, config: DemandConfig = DEFAULT) -> DataFrame:
    """Predicted and actual totals and hours per zone; zones without a name keep their row."""
    return (
        forecast.groupBy(config.key, config.name, config.region)
        .agg(
            F.sum("predicted").alias("predicted_total"),
            F.sum("actual").alias("actual_total"),
            F.count("predicted").alias("hours_in_window"),
        )
        .withColumn("pct_diff_vs_actual", percent_difference("predicted_total", "actual_total"))
    )


def headline(per_zone: DataFrame) -> DataFrame:
    """Total predicted and actual and their difference in percent (0 without actuals)."""
    sums = per_zone.agg(
        F.sum("predicted_total").alias("total_predicted"), F.sum("actual_total").alias("total_actual")
    )
    return sums.withColumn("delta", F.col("total_predicted") - F.col("total_actual")).withColumn(
        "delta_pct",
        F.coalesce(
            F.col("delta") / F.nullif(F.col("total_actual"), F.lit(0)) * F.lit(100.0), F.lit(0.0)
        ),
    )


def hot_cold(per_zone: DataFrame, approx: bool = False) -> DataFrame:
    """90th and 10th percentile of the zone totals and the zones at or beyond them."""
    limits = quantiles(per_zone, "predicted_total", {"hot_threshold": 0.9, "cold_threshold": 0.1}, approx=approx)
    limit = limits.agg(F.first(F.struct("hot_threshold", "cold_threshold"))).scalar()
    marked = per_zone.withColumn("__t", limit)
    return marked.groupBy().agg(
        F.max("__t.hot_threshold").alias("hot_threshold"),
        F.max("__t.cold_threshold").alias("cold_threshold"),
        F.count_if(F.col("predicted_total") >= F.col("__t.hot_threshold")).alias("n_hot"),
        F.count_if(F.col("predicted_total") <= F.col("__t.cold_threshold")).alias("n_cold"),
    )


def region_totals(per_zone: DataFrame, config: DemandConfig = DEFAULT) -> DataFrame:
    """Zone totals rolled up to regions with the number of zones."""
    return (
        per_zone.groupBy(config.region)
        .agg(
            F.sum("predicted_total").alias("predicted"),
            F.sum("actual_total").alias("actual"),
            F.count_distinct(config.key).alias("zones"),
        )
        .withColumn("pct_diff", percent_difference("predicted", "actual"))
    )


def region_zone_rollup(forecast: DataFrame, config: DemandConfig = DEFAULT) -> DataFrame:
    """Zones, regions and the grand total in one pass; ``level`` 0, 1 or 3."""
    return forecast.rollup(config.region, config.key).agg(
        F.grouping_id().alias("level"),
        F.sum("predicted").alias("predicted"),
        F.sum("actual").alias("actual"),
    )


# --- city ------------------------------------------------------------------

def panel_facts(panel: DataFrame, config: DemandConfig = DEFAULT, approx: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approx else F.count_distinct
    return panel.agg(
        distinct(config.key).alias("zones"),
        distinct(config.time).alias("hours"),
        F.count(F.lit(1)).alias("rows"),
        F.min(config.time).alias("first_hour"),
        F.max(config.time).alias("last_hour"),
        F.sum(config.target).alias("total"),
        F.avg(config.target).alias("mean"),
    )


def _largest(df: DataFrame, label: str, value: str) -> DataFrame:
    """Row with the largest value; equal values go to the smaller label."""
    pick = F.min(F.struct((-F.col(value)).alias("v"), F.col(label).alias("l")))
    return df.agg(pick.alias("p")).select(F.col("p.l").alias(label), (-F.col("p.v")).alias(value))


def peak_hour(panel: DataFrame, config: DemandConfig = DEFAULT) -> DataFrame:
    """Hour of day with the highest mean."""
    return _largest(hour_profile(panel, config=config), "hour_of_day", "mean")


def busiest_zone(panel: DataFrame, by: str, config: DemandConfig = DEFAULT) -> DataFrame:
    return _largest(panel.groupBy(by).agg(F.sum(config.target).alias("total")), by, "total")


def city_totals(panel: DataFrame, config: DemandConfig = DEFAULT) -> DataFrame:
    """City total per hour. Partial sums make this one row per hour and task."""
    return panel.groupBy(config.time).agg(F.sum(config.target).alias("total"))


def demand_matrix(panel: DataFrame, by: Sequence[str] = (), config: DemandConfig = DEFAULT) -> DataFrame:
    """Weekday × hour-of-day means as a 7 × 24 table, per group if asked."""
    cell = lambda h: F.avg(F.when(F.hour(config.time) == h, F.col(config.target))).alias(f"h{h:02d}")
    return panel.groupBy(*by, F.weekday(config.time).alias("dow")).agg(*[cell(h) for h in range(24)])


def demand_cells(panel: DataFrame, by: Sequence[str] = (), config: DemandConfig = DEFAULT) -> DataFrame:
    return panel.groupBy(
        *by, F.weekday(config.time).alias("dow"), F.hour(config.time).alias("hour_of_day")
    ).agg(F.avg(config.target).alias("mean"))


def best_cell(panel: DataFrame, config: DemandConfig = DEFAULT) -> DataFrame:
    pick = F.min(F.struct((-F.col("mean")).alias("m"), "dow", "hour_of_day"))
    cell = demand_cells(panel, config=config).agg(pick.alias("p"))
    return cell.select("p.dow", "p.hour_of_day", (-F.col("p.m")).alias("mean"))


def totals_by(panel: DataFrame, by: Sequence[str], config: DemandConfig = DEFAULT) -> DataFrame:
    return panel.groupBy(*by).agg(F.sum(config.target).alias("total"))


def zone_aggregate(panel: DataFrame, by: Sequence[str], config: DemandConfig = DEFAULT) -> DataFrame:
    """Total, hourly mean and peak per zone."""
    return panel.groupBy(*by).agg(
        F.sum(config.target).alias("total"),
        F.avg(config.target).alias("mean"),
        F.max(config.target).alias("peak"),
    )


def hour_profile(panel: DataFrame, by: Sequence[str] = (), config: DemandConfig = DEFAULT) -> DataFrame:
    return panel.groupBy(*by, F.hour(config.time).alias("hour_of_day")).agg(
        F.avg(config.target).alias("mean")
    )


def zone_peaks(panel: DataFrame, config: DemandConfig = DEFAULT) -> DataFrame:
    """Peak hour of day of every zone."""
    pick = F.min(F.struct((-F.col("mean")).alias("m"), "hour_of_day"))
    profile = hour_profile(panel, [config.key], config).groupBy(config.key).agg(pick.alias("p"))
    return profile.select(config.key, F.col("p.hour_of_day").alias("peak_hour"), (-F.col("p.m")).alias("mean"))


def weekend_spread(panel: DataFrame, by: Sequence[str] = (), config: DemandConfig = DEFAULT) -> DataFrame:
    """Minimum, quartiles and maximum of weekend and weekday hours.

    Hourly counts are whole numbers up to the largest hourly count, which
    bounds the entries that the built-in aggregate keeps.
    """
    period = F.when(F.weekday(config.time) >= 5, "Weekend").otherwise("Weekday")
    box = F.percentile(config.target, F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    names = ("low", "q1", "median", "q3", "high")
    return (
        panel.groupBy(*by, period.alias("period"))
        .agg(box.alias("b"), F.count(F.lit(1)).alias("n"))
        .select(*by, "period", "n", *[F.col("b")[i].alias(c) for i, c in enumerate(names)])
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins from minimum to maximum; the maximum is in the last bin."""
    number = F.col(value).cast("double")
    low, high = df.agg(F.min(number)).scalar(), df.agg(F.max(number)).scalar()
    width = (high - low) / F.lit(float(bins))
    place = F.when(high == low, F.lit(0)).otherwise(
        F.least(F.floor((number - low) / F.nullif(width, F.lit(0.0))).cast("int"), F.lit(bins - 1))
    )
    return df.filter(number.isNotNull()).groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("bin_start", low + F.col("bin") * width)


# --- forecast detail -------------------------------------------------------

def residual_band(
    forecast: DataFrame, history: DataFrame, z: float = 1.96, config: DemandConfig = DEFAULT
) -> DataFrame:
    """95 % band per zone from the population std of the training residuals.

    A zone without history uses the std of its own forecast residuals. The lower
    end stops at 0. Both frames need ``actual`` and ``predicted``.
    """
    spread = F.stddev_pop(F.col("actual") - F.col("predicted"))
    past = history.groupBy(config.key).agg(spread.alias("past_std"))
    own = forecast.groupBy(config.key).agg(spread.alias("own_std"))
    std = F.coalesce("past_std", "own_std")
    return (
        forecast.join(own, config.key).join(past, config.key, "left")
        .withColumn("lower", F.greatest(F.col("predicted") - F.lit(z) * std, F.lit(0.0)))
        .withColumn("upper", F.col("predicted") + F.lit(z) * std)
        .drop("past_std", "own_std")
    )


def global_band(forecast: DataFrame, z: float = 1.96) -> DataFrame:
    """Band from the sample std of all residuals, not clipped."""
    std = forecast.agg(F.stddev_samp(F.col("actual") - F.col("predicted"))).scalar()
    return forecast.withColumns(
        {"lower": F.col("predicted") - F.lit(z) * std, "upper": F.col("predicted") + F.lit(z) * std}
    )


def error_table(forecast: DataFrame, time: str = "hour") -> DataFrame:
    """Actual, predicted, error and absolute error per hour."""
    error = F.col("actual") - F.col("predicted")
    return forecast.withColumns(
        {"hour_text": F.date_format(F.col(time), "yyyy-MM-dd HH:00"), "error": error, "abs_error": F.abs(error)}
    )


def exact_matches(forecast: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return forecast.groupBy(*by).agg(
        F.count_if(F.col("actual") == F.col("predicted")).alias("exact"), F.count(F.lit(1)).alias("n")
    )


def prediction_stats(forecast: DataFrame, column: str = "predicted") -> DataFrame:
    return forecast.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def error_share(forecast: DataFrame) -> DataFrame:
    """MAE as percent of mean demand (mean 0 counts as 1)."""
    mean = F.avg("actual")
    base = F.when(mean == 0, F.lit(1.0)).otherwise(mean)
    return forecast.agg(
        (F.avg(F.abs(F.col("actual") - F.col("predicted"))) / base * F.lit(100.0)).alias("mae_pct_of_mean")
    )


def outline_join(outlines: DataFrame, zones: DataFrame, config: DemandConfig = DEFAULT) -> DataFrame:
    """Zone aggregates matched to outlines on the id as text."""
    return zones.withColumn("zone_id", F.col(config.key).cast("string")).join(
        outlines.withColumn("zone_id", F.col("zone_id").cast("string")), "zone_id"
    )


def model_overlay(
    predictions: DataFrame, models: Sequence[str], key: str, time: str, actual: Column | str = "actual"
) -> DataFrame:
    """Actual and the prediction of each model side by side per (key, hour)."""
    value = F.col(actual) if isinstance(actual, str) else actual
    return predictions.groupBy(key, time).agg(
        F.max(value).alias("actual"),
        *[F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(m) for m in models],
    )
