"""Global order without a single-task sort.

Running counts, exact quantiles, label codes and distribution distances need a
total order of the values. The values are first grouped (so equal values are one
row, however often they occur), then range-partitioned; each range is summed on
its own and shifted by the totals of the ranges before it. No task ever holds
more than one range of distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import pin

_PART = "__range"


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``cum_<c>`` and ``all_<c>`` for each column ``c`` in ``sums``.

    Rows must be unique per (``by``, ``order``). The ranges are pinned once so
    that offsets and rows are sure to see the same cut.
    """
    by, order = list(by), list(order)
    ranged = pin(df.repartitionByRange(*by, *order).withColumn(_PART, F.spark_partition_id()))

    earlier = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    per_range = ranged.groupBy(*by, _PART).agg(*[F.sum(c).alias(f"__sum_{c}") for c in sums])
    offsets = per_range.select(
        *by,
        _PART,
        *[F.coalesce(F.sum(f"__sum_{c}").over(earlier), F.lit(0)).alias(f"__off_{c}") for c in sums],
        *[F.sum(f"__sum_{c}").over(whole).alias(f"all_{c}") for c in sums],
    )
    inside = Window.partitionBy(*by, _PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(_null_safe(offsets, by), [*_safe_on(ranged, by)], "inner")
        .withColumns({f"cum_{c}": F.col(f"__off_{c}") + F.sum(c).over(inside) for c in sums})
        .drop(*[f"__off_{c}" for c in sums], *[f"__by_{c}" for c in by], "__by_part", _PART)
    )


def _null_safe(offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    return offsets.withColumnsRenamed({_PART: "__by_part", **{c: f"__by_{c}" for c in by}})


def _safe_on(df: DataFrame, by: Sequence[str]) -> list[Column]:
    pairs = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    return [F.col(_PART) == F.col("__by_part"), *pairs]


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Non-null values with their number of rows, column ``n``."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per named probability."""
    return quantiles_of_counts(value_counts(df, value, by), value, probabilities, by)


def quantiles_of_counts(
    counts: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """The same from distinct values with their number of rows ``n``."""
    ranked = running_totals(counts, [value], ["n"], by)
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n")

    picks: list[Column] = [F.max("all_n").alias("__n")]
    for name, p in probabilities.items():
        place = (F.col("all_n") - 1) * F.lit(float(p))
        for end, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            hit = (first <= rank) & (rank < last)
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"__{name}_{end}"))
    table = ranked.groupBy(*by).agg(*picks)

    def between(name: str, p: float) -> Column:
        place = (F.col("__n") - 1) * F.lit(float(p))
        low, high = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        return (low + (high - low) * (place - F.floor(place))).alias(name)

    return table.select(*by, *[between(name, p) for name, p in probabilities.items()])


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    by: Sequence[str] = (),
    approx: bool = False,
    accuracy: int = 10000,
) -> DataFrame:
    """``exact_quantiles``, or the sketch of Spark with ``approx=True``."""
    if not approx:
        return exact_quantiles(df, value, probabilities, by)
    return df.groupBy(*by).agg(
        *[
            F.percentile_approx(value, float(p), accuracy).cast("double").alias(name)
            for name, p in probabilities.items()
        ]
    )


def label_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Code table ``(column, value, code)``: position in the sorted distinct values.

    Numbers sort as numbers and text as text. Values are given as text.
    """
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() not in ("string", "date", "timestamp")}
    pairs = [
        F.struct(
            F.lit(c).alias("column"),
            (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("as_number"),
            F.col(c).cast("string").alias("value"),
        )
        for c in columns
    ]
    distinct = (
        df.select(*columns)
        .distinct()
        .select(F.explode(F.array(*pairs)).alias("p"))
        .select("p.*")
        .filter(F.col("value").isNotNull())
        .distinct()
        .withColumn("n", F.lit(1))
    )
    ranked = running_totals(distinct, ["as_number", "value"], ["n"], ["column"])
    return ranked.select("column", "value", (F.col("cum_n") - 1).cast("int").alias("code"))


def cumulative_share(df: DataFrame, value: str, tie: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Running share of ``value`` from the largest down (columns ``share``, ``cum_share``)."""
    keyed = df.withColumn("__down", -F.col(value))
    ranked = running_totals(keyed, ["__down", *tie], [value], by)
    return ranked.select(
        *df.columns,
        F.try_divide(F.col(value), F.col(f"all_{value}")).alias("share"),
        F.try_divide(F.col(f"cum_{value}"), F.col(f"all_{value}")).alias("cum_share"),
    )
