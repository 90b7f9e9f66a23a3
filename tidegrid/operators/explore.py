"""Exploratory aggregates on panels, sales, prices and forecasts' residuals."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.ordered import exact_quantiles, quantiles, running_totals
from tidegrid.operators.ranking import top


def profile(df: DataFrame, dims: Sequence[str], ranges: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Distinct counts of ``dims`` and min/max of ``ranges`` in one row."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[distinct(c).alias(f"n_{c}") for c in dims],
        *[f(c).alias(f"{n}_{c}") for c in ranges for n, f in (("min", F.min), ("max", F.max))],
    )


def correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Correlation of every column with the target, all in one aggregate."""
    y = F.col(target).cast("double")
    rows = [
        F.struct(F.lit(c).alias("feature"), F.corr(F.col(c).cast("double"), y).alias("corr")) for c in columns
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def zero_share(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.when(F.col(value) == 0, 1.0).otherwise(0.0)).alias("zero_share"))


def variation(df: DataFrame, value: str, by: str) -> DataFrame:
    """Sample std, mean and their ratio per item."""
    return (
        df.groupBy(by)
        .agg(F.stddev_samp(value).alias("std"), F.avg(value).alias("mean"))
        .withColumn("cv", F.try_divide(F.col("std"), F.col("mean")))
    )


def items_that_vary(table: DataFrame, limit: float = 0.01) -> DataFrame:
    return table.agg(F.count_if(F.col("cv") > limit).alias("varying"), F.count(F.lit(1)).alias("items"))


def event_lift(days: DataFrame, value: str, event: str) -> DataFrame:
    """Mean of days with and without an event and the lift in percent."""
    with_event = F.avg(F.when(F.col(event), F.col(value)))
    without = F.avg(F.when(~F.col(event), F.col(value)))
    return days.agg(with_event.alias("with_event"), without.alias("without_event")).withColumn(
        "lift_pct", (F.try_divide(F.col("with_event"), F.col("without_event")) - F.lit(1.0)) * F.lit(100.0)
    )


def mean_by(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"))


def by_calendar_name(df: DataFrame, value: str, day: str, unit: str) -> DataFrame:
    """Mean by weekday or month name, with the calendar position for ordering."""
    position, name = {
        "weekday": (F.weekday(day), F.date_format(day, "EEEE")),
        "month": (F.month(day), F.date_format(day, "MMMM")),
    }[unit]
    return df.groupBy(position.alias("position"), name.alias("name")).agg(F.avg(value).alias("mean"))


def sum_by(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).alias("total"))


def most_frequent(df: DataFrame, key: str) -> DataFrame:
    """The key with most rows; equal counts go to the smaller key."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    pick = F.min(F.struct((-F.col("n")).alias("n"), F.col(key).alias("k")))
    return counts.agg(pick.alias("p")).select(F.col("p.k").alias(key), (-F.col("p.n")).alias("n"))


# --- residuals -------------------------------------------------------------

def residuals_over_time(df: DataFrame, time: str) -> DataFrame:
    return df.groupBy(time).agg(
        F.avg("residual").alias("mean_residual"), F.avg(F.abs("residual")).alias("mean_abs_error")
    )


def residual_moments(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, std and the bias-corrected skewness and excess kurtosis."""
    n = F.col("n").cast("double")
    g1, g2 = F.col("g1"), F.col("g2")
    skew = F.try_divide(F.sqrt(n * (n - 1)), n - 2) * g1
    kurt = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return (
        df.groupBy(*by)
        .agg(
            F.avg("residual").alias("mean"),
            F.stddev_samp("residual").alias("std"),
            F.skewness("residual").alias("g1"),
            F.kurtosis("residual").alias("g2"),
            F.count("residual").alias("n"),
        )
        .select(*by, "n", "mean", "std", skew.alias("skewness"), kurt.alias("kurtosis"))
    )


# The five points of a box.
BOX = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}


def spread_by(df: DataFrame, value: str, by: Sequence[str], approx: bool = False) -> DataFrame:
    """Minimum, quartiles and maximum of ``value`` per group."""
    return quantiles(df, value, BOX, by, approx)


def worst_series(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The ``n`` series with the largest mean absolute error. The score has nine
    digits, so that summing in another order cannot decide between equal series."""
    table = df.groupBy(key).agg(F.round(F.avg(F.abs("residual")), 9).alias("mean_abs_error"))
    return top(table, "mean_abs_error", n, [key])


def spread_of_worst(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return spread_by(df.join(worst_series(df, key, n).select(key), key, "left_semi"), "residual", [key])


def series_errors(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, median and mean percent error per series; needs ``add_errors`` columns."""
    median = exact_quantiles(df, "abs_error", {"median_abs_error": 0.5}, by)
    means = df.groupBy(*by).agg(
        F.avg("abs_error").alias("mean_abs_error"),
        F.avg("pct_error").alias("mean_pct_error"),
        F.count("residual").alias("n_obs"),
    )
    return means.join(median, list(by))


def best_worst_median(table: DataFrame, key: str, score: str) -> DataFrame:
    """The series with the largest, the smallest and the middle score."""
    keyed = table.select(key, score).withColumns({"__down": -F.col(score), "one": F.lit(1)})
    ranked = running_totals(keyed, ["__down", key], ["one"])
    role = (
        F.when(F.col("cum_one") == 1, "worst")
        .when(F.col("cum_one") == F.col("all_one"), "best")
        .when(F.col("cum_one") - 1 == F.floor(F.col("all_one") / 2), "median")
    )
    return ranked.select(role.alias("role"), key, score).filter(F.col("role").isNotNull())


def qq_points(df: DataFrame, value: str, points: int = 99) -> DataFrame:
    """Quantiles of ``value`` against the standard normal on an even grid."""
    grid = [(i + 1) / (points + 1) for i in range(points)]
    found = exact_quantiles(df, value, {f"q{i}": p for i, p in enumerate(grid)})
    rows = [
        F.struct(F.lit(p).alias("p"), F.lit(NormalDist().inv_cdf(p)).alias("normal"), F.col(f"q{i}").alias("sample"))
        for i, p in enumerate(grid)
    ]
    return found.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def family_shares(importance: DataFrame, family: Column, value: str) -> DataFrame:
    """Importance per feature family and its percent of the whole."""
    total = importance.agg(F.sum(value)).scalar()
    return (
        importance.groupBy(family.alias("family"))
        .agg(F.sum(value).alias("importance"))
        .withColumn("pct", F.try_divide(F.col("importance"), total) * F.lit(100.0))
    )
