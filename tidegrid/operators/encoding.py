"""Category codes, smoothed target means, narrow types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.ordered import label_codes

# Names of the code columns.
CODE_NAMES = {"PULocationID": "zone_enc", "Borough": "borough_enc", "service_zone": "service_zone_enc"}


def add_label_codes(df: DataFrame, names: dict[str, str] | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Add the sorted position of each category; missing values get −1.

    The distinct values of all columns are coded in one go. A stored code table
    (from ``label_codes``) keeps codes stable between runs.
    """
    names = {c: n for c, n in (names or CODE_NAMES).items() if c in df.columns}
    table = codes if codes is not None else label_codes(df, list(names))
    for column, name in names.items():
        part = table.filter(F.col("column") == column).select(
            F.col("value").cast(df.schema[column].dataType).alias(column), F.col("code").alias(name)
        )
        df = df.join(part, column, "left").withColumn(name, F.coalesce(F.col(name), F.lit(-1)))
    return df


def target_means(
    df: DataFrame, target: str, column: str, smoothing: float = 10.0, overall: Column | None = None
) -> DataFrame:
    """Mean per category pulled towards the overall mean by ``smoothing`` rows."""
    overall = overall if overall is not None else df.agg(F.avg(target)).scalar()
    n, mean = F.count(target), F.avg(target)
    return df.groupBy(column).agg(
        ((n * mean + F.lit(float(smoothing)) * overall) / (n + F.lit(float(smoothing)))).alias(
            f"{column}_target_enc"
        )
    )


def add_target_encoding(
    df: DataFrame,
    target: str,
    columns: Sequence[str],
    smoothing: float = 10.0,
    time: str | None = None,
    until: Column | str | None = None,
) -> DataFrame:
    """Join ``target_means``; with ``until`` only rows up to that time are learnt from."""
    source = df if until is None else df.filter(F.col(time) <= (F.lit(until) if isinstance(until, str) else until))
    overall = source.agg(F.avg(target)).scalar()
    for column in columns:
        if column in df.columns:
            df = df.join(target_means(source, target, column, smoothing, overall), column, "left")
    return df


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Numeric columns that are not excluded, in schema order."""
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)
    ]


def existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(0, list(columns) if columns else None)


def smallest_types(df: DataFrame) -> DataFrame:
    """One row per numeric column: range and the smallest type that holds it."""
    numeric = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    ranges = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(f.name).alias("column"),
                    F.lit("whole" if isinstance(f.dataType, whole) else "real").alias("kind"),
                    F.min(f.name).cast("double").alias("low"),
                    F.max(f.name).cast("double").alias("high"),
                )
                for f in numeric
            ]
        ).alias("r")
    ).select(F.explode("r").alias("r")).select("r.*")
    # Limits of the integer types and of single precision.
    fits = lambda bits: (F.col("low") >= -(2.0 ** (bits - 1))) & (F.col("high") <= 2.0 ** (bits - 1) - 1)
    narrow = (
        F.when(fits(8), "tinyint").when(fits(16), "smallint").when(fits(32), "int").otherwise("bigint")
    )
    single = F.when((F.abs("low") <= 3.4028235e38) & (F.abs("high") <= 3.4028235e38), "float").otherwise("double")
    return ranges.withColumn("type", F.when(F.col("kind") == "whole", narrow).otherwise(single))


def shrink_types(df: DataFrame) -> DataFrame:
    """Cast every numeric column to its smallest type. Brings one row per column to the driver."""
    types = {r["column"]: r["type"] for r in smallest_types(df).collect()}
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])
