"""Sales, calendar and price tables in the wide daily form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sales_tables(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wide sales, calendar, prices) as Parquet folders of those names."""
    return tuple(spark.read.parquet(f"{directory}/{name}") for name in ("sales", "calendar", "prices"))


def day_columns(df: DataFrame, prefix: str = "d_") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def wide_to_long(df: DataFrame, prefix: str = "d_", name: str = "d", value: str = "sales") -> DataFrame:
    """One row per series and day from one column per day."""
    days = day_columns(df, prefix)
    ids = [c for c in df.columns if c not in days]
    return df.unpivot(ids, days, name, value)


def day_number(name: str = "d") -> Column:
    return F.regexp_extract(F.col(name), r"(\d+)$", 1).cast("int")
