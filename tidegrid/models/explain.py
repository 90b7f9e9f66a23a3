"""What drives a model: permutation importance, attributions of linear models and of trees, dependence."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import DEFAULT, DemandConfig
from tidegrid.functions.metrics import rmse
from tidegrid.models.boosting import FittedBoosting, Tree
from tidegrid.operators.blocks import hour_index


def shuffled_columns(
    df: DataFrame, columns: Sequence[str], seed: int = 42, block: int = 168, config: DemandConfig = DEFAULT
) -> DataFrame:
    """``shuffled_<c>``: the value of another row of the same series and week.

    Rows are put in a seeded hash order inside (series, week) and each takes the
    value of the row before it, the first that of the last. All columns share
    one window.
    """
    week = F.floor(hour_index(config.time) / F.lit(block))
    order = Window.partitionBy(config.key, week).orderBy(F.xxhash64(F.col(config.time), F.lit(seed)), config.time)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.row_number().over(order) == 1
    return df.withColumns(
        {
            f"shuffled_{c}": F.when(first, F.last(c).over(whole)).otherwise(F.lag(c).over(order))
            for c in columns
        }
    )


def permutation_importance(
    df: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    features: Sequence[str],
    target: str = DEFAULT.target,
    config: DemandConfig = DEFAULT,
    seed: int = 42,
) -> DataFrame:
    """(feature, rmse, importance): the rise of RMSE when one feature is shuffled."""
    base = shuffled_columns(df, features, seed, config=config)
    plain = df.columns

    def scored(frame: DataFrame, name: str) -> DataFrame:
        return predict(frame).agg(rmse(target, "prediction").alias("rmse")).select(
            F.lit(name).alias("feature"), "rmse"
        )

    table = scored(base.select(*plain), "")
    for f in features:
        swapped = base.select(*[F.col(f"shuffled_{f}").alias(f) if c == f else F.col(c) for c in plain])
        table = table.unionByName(scored(swapped, f))
    reference = F.max(F.when(F.col("feature") == "", F.col("rmse"))).over(Window.partitionBy())
    return (
        table.withColumn("importance", F.col("rmse") - reference)
        .filter(F.col("feature") != "")
        .orderBy(F.col("importance").desc(), "feature")
    )


def contributions(
    df: DataFrame, weights: dict[str, Column | float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact attribution of a linear model: weight · (value − mean), column ``attr_<feature>``.

    Means are over all rows, or per ``by`` group.
    """
    as_column = lambda w: w if isinstance(w, Column) else F.lit(float(w))
    means = [F.avg(F.col(f).cast("double")).alias(f"__mean_{f}") for f in weights]
    if by:
        with_means = df.join(df.groupBy(*by).agg(*means), list(by))
    else:
        struct = df.agg(*means).select(F.struct(*[f"__mean_{f}" for f in weights])).scalar()
        with_means = df.withColumn("__m", struct).select("*", "__m.*").drop("__m")
    return with_means.withColumns(
        {f"attr_{f}": as_column(w) * (F.col(f).cast("double") - F.col(f"__mean_{f}")) for f, w in weights.items()}
    ).drop(*[f"__mean_{f}" for f in weights])


def path_means(tree: Tree) -> np.ndarray:
    """Mean value under each node of a tree, by the rows each leaf was grown from."""
    rows, value = np.maximum(tree.rows, 0.0).astype(float), tree.value.astype(float).copy()
    for i in range(len(value) - 1, -1, -1):  # children come after their parent
        if tree.feature[i] >= 0:
            a, b = tree.left[i], tree.right[i]
            whole = rows[a] + rows[b]
            value[i] = (rows[a] * value[a] + rows[b] * value[b]) / whole if whole else (value[a] + value[b]) / 2.0
    return value


def path_moves(tree: Tree, means: np.ndarray) -> dict[int, np.ndarray]:
    """Per feature of the tree: what the steps that ask for it move the mean by, on the path to each node."""
    moves = {f: np.zeros(len(means)) for f in sorted(set(tree.feature[tree.feature >= 0].tolist()))}
    for i, f in enumerate(tree.feature.tolist()):  # parents come before their children
        if f >= 0:
            for child in (int(tree.left[i]), int(tree.right[i])):
                for move in moves.values():
                    move[child] = move[i]
                moves[f][child] += means[child] - means[i]
    return moves


def tree_contributions(df: DataFrame, model: FittedBoosting) -> DataFrame:
    """Attributions of boosted trees, in the columns of ``contributions``, and ``attr_base``.

    Each step of a row's path through a tree moves the mean of the rows that got there;
    the move belongs to the feature the step asked for. ``attr_base`` (the model's mean
    over the rows it was grown from) and all ``attr_<feature>`` add up to the prediction.
    """
    means = [path_means(t) for t in model.trees]
    trees = [(t, path_moves(t, m)) for t, m in zip(model.trees, means)]
    features = model.spec.features
    base = float(model.base + sum(m[0] for m in means))

    @F.pandas_udf("array<double>")
    def shares(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            x = [part.iloc[:, i].to_numpy(float) for i in range(part.shape[1])]
            moved = np.zeros((len(features), len(part)))
            for tree, moves in trees:
                leaf = tree.leaves(x, tree.threshold)
                for f, move in moves.items():
                    moved[f] += move[leaf]
            moved = np.ascontiguousarray(moved.T)
            yield pd.Series(list(moved))

    with_shares = df.withColumn("__shares", shares(F.struct(*(F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)))))
    return with_shares.withColumns(
        {f"attr_{f}": F.col("__shares")[i] for i, f in enumerate(features)} | {"attr_base": F.lit(base)}
    ).drop("__shares")


def mean_attribution(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    rows = [F.struct(F.lit(f).alias("feature"), F.avg(F.abs(f"attr_{f}")).alias("importance")) for f in features]
    return (
        df.agg(F.array(*rows).alias("r"))
        .select(F.explode("r").alias("r"))
        .select("r.*")
        .orderBy(F.col("importance").desc(), "feature")
    )


def waterfall(
    df: DataFrame, features: Sequence[str], prediction: str, keys: Sequence[str], highest: bool = True
) -> DataFrame:
    """Attributions of the row with the highest (or lowest) prediction, largest first."""
    sign = -1 if highest else 1
    pick = F.min(
        F.struct(
            (F.col(prediction) * sign).alias("p"), *keys,
            F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"attr_{f}").alias("value")) for f in features]).alias("parts"),
        )
    )
    row = df.agg(pick.alias("b")).select(*[F.col(f"b.{k}").alias(k) for k in keys], (F.col("b.p") * sign).alias(prediction), F.explode("b.parts").alias("x"))
    return row.select(*keys, prediction, "x.feature", "x.value").orderBy(F.abs("value").desc(), "feature")


def dependence(
    df: DataFrame, feature: str, outcome: str, edges: Sequence[float], second: str | None = None,
    second_edges: Sequence[float] = (),
) -> DataFrame:
    """Mean outcome per bin of a feature (and of a second one). Bin i is (edge i−1, edge i]."""
    place = lambda name, cuts: F.size(F.filter(F.array(*[F.lit(float(e)) for e in cuts]), lambda e: e < F.col(name)))
    by = [place(feature, edges).alias("bin")]
    if second:
        by.append(place(second, second_edges).alias("second_bin"))
    return df.filter(F.col(feature).isNotNull()).groupBy(*by).agg(
        F.avg(outcome).alias("mean_outcome"), F.avg(feature).alias("mean_value"), F.count(F.lit(1)).alias("n")
    )


def quantile_edges(df: DataFrame, feature: str, bins: int = 10, error: float = 0.001) -> list[float]:
    """Inner bin edges: approximate quantiles, ``bins`` − 1 numbers on the driver."""
    cuts = [i / bins for i in range(1, bins)]
    return sorted(set(df.approxQuantile(feature, cuts, error)))
