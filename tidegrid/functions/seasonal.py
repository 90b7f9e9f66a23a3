"""Fourier terms."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hours_since(time: str, origin: str | Column) -> Column:
    start = F.lit(origin).cast("timestamp") if isinstance(origin, str) else origin
    return (F.unix_micros(F.col(time)) - F.unix_micros(start)) / F.lit(3.6e9)


def fourier_columns(
    position: Column, periods: Sequence[tuple[str, float]], order: int
) -> dict[str, Column]:
    """``fourier_<name>_<sin|cos>_<k>`` for each (name, period), period in units of ``position``."""
    columns: dict[str, Column] = {}
    for name, period in periods:
        for k in range(1, order + 1):
            angle = F.lit(2 * pi * k) * position / F.lit(float(period))
            columns[f"fourier_{name}_sin_{k}"] = F.sin(angle)
            columns[f"fourier_{name}_cos_{k}"] = F.cos(angle)
    return columns


def add_fourier_features(
    df: DataFrame,
    time: str = "hour",
    daily_period: float = 24.0,
    weekly_period: float = 168.0,
    order: int = 3,
    origin: str | Column | None = None,
) -> DataFrame:
    """Daily and weekly terms. The phase counts from ``origin``; without one it
    counts from the first hour of ``df``, so give it when scoring new rows."""
    start = origin if origin is not None else df.agg(F.min(time)).scalar()
    periods = [("day", daily_period), ("week", weekly_period)]
    return df.withColumns(fourier_columns(hours_since(time, start), periods, order))


def add_yearly_fourier(
    df: DataFrame, time: str, order: int, origin: str | Column, period_days: float = 365.25
) -> DataFrame:
    """Terms over the year, position in days."""
    days = hours_since(time, origin) / F.lit(24.0)
    return df.withColumns(fourier_columns(days, [("year", period_days)], order))
