"""Top-k lists with a stable tie-break."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, by: str, n: int, tie: Sequence[str], largest: bool = True) -> DataFrame:
    """The ``n`` largest (or smallest) rows: a bounded sort in each task, then one merge."""
    first = F.col(by).desc() if largest else F.col(by).asc()
    return df.orderBy(first, *tie).limit(n)


def top_per_group(df: DataFrame, by: str, n: int, group: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """The ``n`` largest rows of each group with their ``rank``."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(by).desc(), *tie))
    return df.withColumn("rank", place).filter(F.col("rank") <= n)


def zone_list(df: DataFrame, key: str, region: str, name: str) -> DataFrame:
    """Distinct zones ordered by region and name."""
    return df.select(key, region, name).distinct().orderBy(region, name, key)


def best_by(df: DataFrame, label: str, score: str, lowest: bool = True) -> DataFrame:
    """One row: the label with the best score; equal scores go to the first label."""
    sign = 1 if lowest else -1
    pair = F.struct((F.col(score) * sign).alias("score"), F.col(label).alias("label"))
    best = df.filter(F.col(score).isNotNull()).agg(F.min(pair).alias("best"))
    return best.select(F.col("best.label").alias(label), (F.col("best.score") * sign).alias(score))


def agreement(
    predictions: DataFrame, key: str, model: str, predicted: str, models: Sequence[str], n: int = 10
) -> DataFrame:
    """Zones in the top ``n`` of at least one model: a flag per model and their number."""
    totals = predictions.groupBy(model, key).agg(F.sum(predicted).alias("total"))
    listed = top_per_group(totals, "total", n, [model], [key])
    flags = [
        F.max((F.col(model) == m).cast("int")).alias(m) for m in models
    ]
    return listed.groupBy(key).agg(*flags, F.count(F.lit(1)).alias("agreement"))


def agreement_summary(table: DataFrame, n_models: int) -> DataFrame:
    return table.agg(
        F.count_if(F.col("agreement") == n_models).alias("all_agree"),
        F.count_if(F.col("agreement") == 1).alias("only_one"),
    )
