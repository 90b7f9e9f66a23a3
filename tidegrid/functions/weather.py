"""Derived weather columns and their join to the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weather variables, thresholds and scales.
HOURLY_VARS = ("temperature_2m", "precipitation", "snowfall", "wind_speed_10m", "relative_humidity_2m")
DERIVED = (
    "is_raining",
    "is_heavy_rain",
    "is_snowing",
    "is_freezing",
    "rolling_precip_3h",
    "wind_chill_proxy",
)
RAIN_MM, HEAVY_RAIN_MM = 0.1, 5.0
MAX_WIND, MIN_TEMP, MAX_TEMP = 50.0, -20.0, 30.0


def _clip(column: Column, low: float, high: float) -> Column:
    """Bounds that keep NULL as NULL (``least``/``greatest`` would skip it)."""
    return F.when(column.isNotNull(), F.least(F.greatest(column, F.lit(low)), F.lit(high)))


def _above(column: str, limit: float) -> Column:
    return F.coalesce(F.col(column) > limit, F.lit(False)).cast("tinyint")


def weather_flags() -> dict[str, Column]:
    span = MAX_TEMP - MIN_TEMP
    wind = _clip(F.col("wind_speed_10m"), 0.0, MAX_WIND) / F.lit(MAX_WIND)
    warmth = (_clip(F.col("temperature_2m"), MIN_TEMP, MAX_TEMP) - F.lit(MIN_TEMP)) / F.lit(span)
    return {
        "is_raining": _above("precipitation", RAIN_MM),
        "is_heavy_rain": _above("precipitation", HEAVY_RAIN_MM),
        "is_snowing": _above("snowfall", 0.0),
        "is_freezing": F.coalesce(F.col("temperature_2m") < 0, F.lit(False)).cast("tinyint"),
        "wind_chill_proxy": wind * (F.lit(1.0) - warmth),
    }


def derive_weather_features(
    weather: DataFrame, time: str = "hour", station: Sequence[str] = ()
) -> DataFrame:
    """Flags, wind-chill proxy and the rain of the last three rows.

    One station has one row per hour of the calendar, so its series is a small
    window partition. Name ``station`` columns when there are several.
    """
    last_three = Window.partitionBy(*station).orderBy(time).rowsBetween(-2, 0)
    return weather.withColumns(weather_flags()).withColumn(
        "rolling_precip_3h", F.sum("precipitation").over(last_three)
    )


def attach_weather(
    panel: DataFrame,
    weather: DataFrame,
    time: str = "hour",
    fill: bool = True,
    station: Sequence[str] = (),
) -> DataFrame:
    """Left join of the derived weather on the hour; missing hours become 0 (or NULL)."""
    features = derive_weather_features(weather, time, station)
    joined = panel.join(features, [*station, time], "left")
    if not fill:
        return joined
    return joined.na.fill(0, [c for c in (*HOURLY_VARS, *DERIVED) if c in joined.columns])
