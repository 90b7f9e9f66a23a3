"""The panel as it was known at a point in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _instant(value: str | Column) -> Column:
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


def as_of(df: DataFrame, time: str, instant: str | Column) -> DataFrame:
    """Rows up to and including ``instant``."""
    return df.filter(F.col(time) <= _instant(instant))


def trailing_hours(df: DataFrame, time: str, instant: str | Column, hours: int) -> DataFrame:
    """Rows in (instant − hours, instant]; both bounds reach the file scan."""
    end = _instant(instant)
    return df.filter((F.col(time) > end - F.expr(f"INTERVAL {int(hours)} HOURS")) & (F.col(time) <= end))


def time_range(df: DataFrame, time: str, warm_up_days: int = 7) -> DataFrame:
    """First and last time, and the default replay start after a warm-up."""
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last")).withColumn(
        "replay_start", F.col("first") + F.expr(f"INTERVAL {int(warm_up_days)} DAYS")
    )


def features_between(df: DataFrame, time: str, start: str, end: str, reach_hours: int, build) -> DataFrame:
    """``build(rows)`` for [start, end] only.

    A time filter does not pass below a window, so the source is cut first to
    the wanted range plus the reach of the frames, and trimmed afterwards.
    Exact for frames that look back at most ``reach_hours`` on a dense panel.
    """
    low, high = _instant(start), _instant(end)
    padded = df.filter(F.col(time).between(low - F.expr(f"INTERVAL {int(reach_hours)} HOURS"), high))
    return build(padded).filter(F.col(time).between(low, high))
