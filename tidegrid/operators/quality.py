"""Data quality and drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.ordered import quantiles_of_counts, running_totals


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _per_column(df: DataFrame, columns: Sequence[str], facts: dict[str, callable]) -> DataFrame:
    """One aggregate over all columns, turned into one row per column."""
    rows = [
        F.struct(F.lit(c).alias("column"), *[make(F.col(c)).alias(n) for n, make in facts.items()])
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def missing_values(df: DataFrame) -> DataFrame:
    """Missing count and percent of every column."""
    share = lambda c: F.round(F.count_if(c.isNull()) / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 2)
    return _per_column(df, df.columns, {"missing": lambda c: F.count_if(c.isNull()), "pct": share})


def zero_rates(df: DataFrame) -> DataFrame:
    """Percent of zeros per numeric column; a missing value is not a zero."""
    rate = lambda c: F.round(F.avg(F.when(c == 0, 1.0).otherwise(0.0)) * 100, 2)
    return _per_column(df, numeric_names(df), {"zero_pct": rate})


def long_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows of the numeric columns, missing values left out."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter(F.col("value").isNotNull())


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Values beyond 1.5 interquartile ranges per column, with exact quartiles.

    Quartiles and counts both come from the grouped distinct values of all columns.
    """
    columns = list(columns or numeric_names(df))
    values = long_numbers(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    quartiles = quantiles_of_counts(values, "value", {"q1": 0.25, "q3": 0.75}, ["column"])
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    out = (F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach)
    return values.join(quartiles, "column").groupBy("column").agg(
        F.max("q1").alias("q1"), F.max("q3").alias("q3"),
        F.sum(F.when(out, F.col("n")).otherwise(0)).alias("outliers"),
    )


def coverage(df: DataFrame, key: str, time: str) -> DataFrame:
    """Zones, modal step, gaps longer than that step, first and last time.

    Steps are taken inside each zone between distinct hours, so copies of an
    hour do not count as steps of 0.
    """
    hours = df.filter(F.col(time).isNotNull()).groupBy(key, time).agg(F.lit(1).alias("one"))
    before = F.lag(time).over(Window.partitionBy(key).orderBy(time))
    steps = (
        hours.withColumn("step", F.unix_seconds(time) - F.unix_seconds(before))
        .groupBy("step")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("step").isNotNull())
    )
    modal = F.min(F.struct((-F.col("n")).alias("n"), F.col("step").alias("step")))
    usual = steps.agg(modal.alias("m")).select(F.col("m.step")).scalar()
    gaps = steps.agg(F.coalesce(F.sum(F.when(F.col("step") > usual, F.col("n"))), F.lit(0))).scalar()
    return df.agg(
        F.count_distinct(key).alias("unique_zones"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
    ).withColumns({"expected_step_hours": usual / F.lit(3600.0), "gap_count": gaps})


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of extra copies of full rows."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__copies"))
    return copies.agg(F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicate_rows"))


def shape(df: DataFrame) -> DataFrame:
    """Row and column counts and the names of time and numeric columns."""
    times = [f.name for f in df.schema.fields if f.dataType.typeName() in ("timestamp", "timestamp_ntz")]
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumns(
        {
            "column_count": F.lit(len(df.columns)),
            "datetime_columns": F.lit(",".join(times)),
            "numeric_columns": F.lit(",".join(numeric_names(df))),
        }
    )


def top_entries(table: DataFrame, score: str, n: int | None = None) -> DataFrame:
    """The ``n`` highest entries, all without ``n``."""
    return table if n is None else table.orderBy(F.col(score).desc(), "column").limit(n)


def quality_report(df: DataFrame, key: str, time: str, top: int | None = None) -> DataFrame:
    """All checks as tidy rows ``(check, column, value)``; ``top`` keeps the highest zero rates and outlier counts only."""
    row = lambda check, column, value: (F.lit(check).alias("check"), column.alias("column"), value.cast("double").alias("value"))
    none = F.lit(None).cast("string")
    parts = [
        shape(df).select(
            F.explode(F.array(*[F.struct(*row(c, none, F.col(c))) for c in ("row_count", "column_count")])).alias("r")
        ).select("r.*"),
        missing_values(df).filter("missing > 0").select(*row("missing", F.col("column"), F.col("missing"))),
        top_entries(zero_rates(df), "zero_pct", top).select(*row("zero_pct", F.col("column"), F.col("zero_pct"))),
        top_entries(iqr_outliers(df), "outliers", top).select(*row("outliers", F.col("column"), F.col("outliers"))),
        duplicate_rows(df).select(*row("duplicate_rows", none, F.col("duplicate_rows"))),
    ]
    cover = coverage(df, key, time)
    for name in ("unique_zones", "expected_step_hours", "gap_count"):
        parts.append(cover.select(*row(name, none, F.col(name))))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def shared_numeric(a: DataFrame, b: DataFrame) -> list[str]:
    """Numeric columns of ``a`` that ``b`` has too."""
    return [c for c in numeric_names(a) if c in b.columns]


def drift(train: DataFrame, new: DataFrame, columns: Sequence[str] | None = None, terms: int = 100) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p-value per shared column.

    Equal values are counted before anything is ordered; the running counts are
    taken over ranges of the distinct values of all columns at once.
    """
    columns = list(columns or shared_numeric(train, new))
    sides = long_numbers(train, columns).withColumns({"a": F.lit(1), "b": F.lit(0)}).unionByName(
        long_numbers(new, columns).withColumns({"a": F.lit(0), "b": F.lit(1)})
    )
    counted = sides.groupBy("column", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ranked = running_totals(counted, ["value"], ["a", "b"], ["column"])
    distance = F.abs(F.col("cum_a") / F.col("all_a") - F.col("cum_b") / F.col("all_b"))
    table = (
        ranked.filter((F.col("all_a") > 0) & (F.col("all_b") > 0))
        .groupBy("column")
        .agg(F.max(distance).alias("ks_statistic"), F.max("all_a").alias("n_train"), F.max("all_b").alias("n_new"))
    )
    weight = F.col("n_train") * F.col("n_new") / (F.col("n_train") + F.col("n_new"))
    lam2 = weight * F.col("ks_statistic") * F.col("ks_statistic")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * k * k * lam2),
    )
    p = F.when(lam2 < 0.04, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))
    return table.withColumn("p_value", p)


def anomalies(forecast: DataFrame, k: float = 3.0) -> DataFrame:
    """Rows whose residual is larger than ``k`` sample standard deviations of all residuals."""
    limit = F.lit(float(k)) * forecast.agg(F.stddev_samp("residual")).scalar()
    return forecast.filter(F.abs("residual") > limit)


def anomaly_summary(rows: DataFrame) -> DataFrame:
    size = F.abs("residual")
    return rows.agg(
        F.count(F.lit(1)).alias("n_anomalies"),
        F.avg(size).alias("mean_abs_residual"),
        F.max(size).alias("max_abs_residual"),
    )
