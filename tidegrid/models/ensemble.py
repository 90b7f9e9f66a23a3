"""Weighted, stacked and per-series combinations of model predictions.

Inputs are long prediction tables ``(key, hour, actual, model, predicted)`` or
the wide form with one column per model.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.config import DEFAULT, DemandConfig
from tidegrid.functions.metrics import METRICS
from tidegrid.models.linear import moment_table, unpack_moments
from tidegrid.operators.series import tail_start
from tidegrid.operators.splits import hold_out, series_folds
from tidegrid.session import stored


# --- weights ---------------------------------------------------------------

def simplex_weights(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Weights ≥ 0 with sum 1 that minimise w'Gw − 2w'c, exactly, for a few models.

    For each subset of models the equality-constrained minimum is a small linear
    system; the best one without a negative weight is the answer.
    """
    k = len(cross)
    best, weights = np.inf, np.full(k, 1.0 / k)
    for size in range(1, k + 1):
        for chosen in combinations(range(k), size):
            idx = list(chosen)
            system = np.zeros((size + 1, size + 1))
            system[:size, :size] = gram[np.ix_(idx, idx)]
            system[:size, size] = system[size, :size] = 1.0
            solution = np.linalg.lstsq(system, np.append(cross[idx], 1.0), rcond=None)[0][:size]
            if (solution < -1e-9).any() or abs(solution.sum() - 1.0) > 1e-6:
                continue
            w = np.zeros(k)
            w[idx] = np.clip(solution, 0.0, None)
            w /= w.sum()
            loss = float(w @ gram @ w - 2 * w @ cross)
            if loss < best - 1e-9 * max(abs(best), 1.0) or not np.isfinite(best):
                best, weights = loss, w
    return weights


def ensemble_weights(wide: DataFrame, models: Sequence[str], actual: str = "actual") -> DataFrame:
    """(model, weight), largest first. Spark sums the cross products of the hold-out
    predictions; the driver solves the k × k problem."""
    row = moment_table(wide, list(models), actual).first().asDict()
    xtx, xty, _, _ = unpack_moments(row, len(models))
    weights = simplex_weights(xtx[1:, 1:], xty[1:])
    rows = [(m, float(w)) for m, w in zip(models, weights)]
    return wide.sparkSession.createDataFrame(rows, "model string, weight double").orderBy(
        F.col("weight").desc(), "model"
    )


def pair_weight(wide: DataFrame, first: str, second: str, actual: str = "actual") -> DataFrame:
    """The same for two models in closed form, without leaving Spark."""
    d = F.col(first) - F.col(second)
    w = F.try_divide(F.sum((F.col(actual) - F.col(second)) * d), F.sum(d * d))
    bounded = F.least(F.greatest(F.coalesce(w, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    known = wide.filter(F.col(first).isNotNull() & F.col(second).isNotNull() & F.col(actual).isNotNull())
    return known.agg(bounded.alias(first)).withColumn(second, F.lit(1.0) - F.col(first))


def weighted_prediction(wide: DataFrame, weights: DataFrame, models: Sequence[str], name: str = "prediction") -> DataFrame:
    """Weighted sum of the model columns."""
    table = weights.agg(F.map_from_entries(F.collect_list(F.struct("model", "weight")))).scalar()
    value = F.lit(0.0)
    for m in models:
        value = value + F.col("__w")[m] * F.col(m)
    return wide.withColumn("__w", table).withColumn(name, value).drop("__w")


Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def model_columns(df: DataFrame, fitted: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """One prediction column per fitted model, appended to the rows of ``df``."""
    for name, predict in fitted.items():
        df = predict(df).withColumnRenamed("prediction", name)
    return df


class WeightedEnsemble:
    """Weights from a per-series hold-out, then all models fitted again on everything."""

    def __init__(self, models: dict[str, Fit], val_size: int = 28, config: DemandConfig = DEFAULT):
        self.models, self.val_size, self.config = models, val_size, config

    def fit(self, train: DataFrame) -> "WeightedEnsemble":
        c = self.config
        marked = hold_out(train, [c.key], c.time, self.val_size)
        past = marked.filter(~F.col("is_val")).drop("is_val")
        held = marked.filter("is_val").drop("is_val").withColumn("actual", F.col(c.target).cast("double"))
        wide = model_columns(held, {n: fit(past) for n, fit in self.models.items()})
        self.weights = ensemble_weights(wide, list(self.models))
        self.fitted = {n: fit(train) for n, fit in self.models.items()}
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        wide = model_columns(df, self.fitted)
        return weighted_prediction(wide, self.weights, list(self.models)).select(*df.columns, "prediction")


# --- stacking --------------------------------------------------------------

def ridge(wide: DataFrame, models: Sequence[str], actual: str = "actual", alpha: float = 1.0):
    """Ridge meta-learner. Spark ML scales its penalty by the label deviation and the
    number of rows, so ``alpha`` is converted."""
    row = wide.agg(F.stddev_pop(actual).alias("s"), F.count(actual).alias("n")).first()
    strength = alpha * (row["s"] or 0.0) / max(row["n"], 1)
    return LinearRegression(
        featuresCol="__meta", labelCol=actual, predictionCol="prediction", solver="normal",
        regParam=strength, elasticNetParam=0.0, standardization=False,
    )


def boosted_meta(actual: str = "actual", iterations: int = 200):
    return GBTRegressor(
        featuresCol="__meta", labelCol=actual, predictionCol="prediction",
        maxIter=iterations, maxDepth=4, stepSize=0.1, seed=42,
    )


class StackedModel:
    def __init__(self, models: Sequence[str], meta):
        self.models, self.meta = list(models), meta
        self.assembler = VectorAssembler(inputCols=self.models, outputCol="__meta", handleInvalid="keep")

    def predict(self, wide: DataFrame) -> DataFrame:
        """All rows; the prediction is NULL where a base prediction is missing."""
        missing = reduce(lambda a, b: a | b, (F.col(m).isNull() | F.isnan(m) for m in self.models))
        answered = self.meta.transform(self.assembler.transform(wide)).drop("__meta")
        return answered.withColumn("prediction", F.when(~missing, F.col("prediction")))

    def weights(self, spark: SparkSession) -> DataFrame:
        """Coefficient or importance per model, NULL when the meta-learner has neither."""
        values = getattr(self.meta, "coefficients", None)
        values = values if values is not None else getattr(self.meta, "featureImportances", None)
        numbers = values.toArray() if values is not None else [None] * len(self.models)
        rows = [(m, None if v is None else float(v)) for m, v in zip(self.models, numbers)]
        return spark.createDataFrame(rows, "model string, weight double")


def fit_stack(
    wide: DataFrame, models: Sequence[str], actual: str = "actual", meta: str | Estimator = "ridge"
) -> StackedModel:
    """Meta-learner on out-of-fold predictions: ``ridge``, ``boosted`` or any estimator
    that reads ``__meta``."""
    if meta == "ridge":
        estimator = ridge(wide, models, actual)
    elif meta == "boosted":
        estimator = boosted_meta(actual)
    elif isinstance(meta, str):
        raise ValueError(f"unknown meta-learner {meta!r}; use 'ridge' or 'boosted'")
    else:
        estimator = meta
    assembler = VectorAssembler(inputCols=list(models), outputCol="__meta", handleInvalid="skip")
    return StackedModel(models, estimator.fit(assembler.transform(wide)))


class StackingEnsemble:
    """Out-of-fold base predictions over expanding folds of every series, then a meta-learner."""

    def __init__(
        self, models: dict[str, Fit], meta: str | Estimator = "ridge", n_splits: int = 5,
        test_size: int = 28, config: DemandConfig = DEFAULT,
    ):
        self.models, self.meta, self.n_splits, self.test_size, self.config = models, meta, n_splits, test_size, config

    def out_of_fold(self, train: DataFrame) -> DataFrame:
        c = self.config
        folds = series_folds(train, [c.key], c.time, self.n_splits, self.test_size)
        parts = []
        for fold in range(1, self.n_splits + 1):
            rows = folds.filter(F.col("fold") == fold)
            past = rows.filter("role = 'train'").drop("fold", "role")
            held = rows.filter("role = 'validate'").withColumn("actual", F.col(c.target).cast("double"))
            wide = model_columns(held, {n: fit(past) for n, fit in self.models.items()})
            # A fold is written before the next one begins: the meta-learner reads it several times,
            # and the plans of all folds and models together would weigh on the driver.
            parts.append(stored(wide.select(c.key, c.time, "fold", "actual", *self.models), "out-of-fold"))
        table = parts[0]
        for part in parts[1:]:
            table = table.unionByName(part)
        return table

    def fit(self, train: DataFrame) -> "StackingEnsemble":
        self.stack = fit_stack(self.out_of_fold(train), list(self.models), meta=self.meta)
        self.fitted = {n: fit(train) for n, fit in self.models.items()}
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.stack.predict(model_columns(df, self.fitted)).select(*df.columns, "prediction")


# --- selection per series --------------------------------------------------

def held_out_rows(predictions: DataFrame, n: int, config: DemandConfig = DEFAULT) -> DataFrame:
    """Last ``n`` hours of every (series, model); series that are not longer are left out."""
    by = [config.key, "model"]
    cut = tail_start(predictions, n, by, config.time, "__cut")
    return predictions.join(cut, by).filter(F.col(config.time) >= F.col("__cut")).drop("__cut")


def selection_scores(
    predictions: DataFrame, models: Sequence[str], metric: str = "rmse", config: DemandConfig = DEFAULT
) -> DataFrame:
    """Score per (series, model); a model that failed on a series scores infinity."""
    scored = predictions.groupBy(config.key, "model").agg(METRICS[metric]("actual", "predicted").alias("score"))
    order = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    usable = F.col("score").isNotNull() & ~F.isnan("score")
    return scored.withColumns(
        {"score": F.when(usable, F.col("score")).otherwise(F.lit(float("inf"))), "order": order}
    )


def select_models(scores: DataFrame, config: DemandConfig = DEFAULT) -> DataFrame:
    """Winner per series; equal scores go to the earlier model, no winner if all failed."""
    best = F.min(F.struct("score", "order", "model")).alias("b")
    finite = scores.filter(F.col("score") < float("inf"))
    return finite.groupBy(config.key).agg(best).select(
        config.key, F.col("b.model").alias("best_model"), F.col("b.score").alias("best_score")
    )


def selection_summary(scores: DataFrame, models: Sequence[str], config: DemandConfig = DEFAULT) -> DataFrame:
    """Winner, its score and one score column per model, per series."""
    wide = scores.groupBy(config.key).agg(
        *[F.max(F.when(F.col("model") == m, F.col("score"))).alias(f"{m}_score") for m in models]
    )
    return select_models(scores, config).join(wide, config.key)


def winner_counts(winners: DataFrame) -> DataFrame:
    return winners.groupBy("best_model").agg(F.count(F.lit(1)).alias("n"))


def route(predictions: DataFrame, winners: DataFrame, rows: DataFrame, config: DemandConfig = DEFAULT) -> DataFrame:
    """Prediction of the winning model for each row of ``rows``, NULL for unseen series."""
    chosen = predictions.join(
        winners.select(config.key, F.col("best_model").alias("model")), [config.key, "model"]
    ).select(config.key, config.time, "model", "predicted")
    return rows.join(chosen, [config.key, config.time], "left")


def unseen_series(rows: DataFrame, winners: DataFrame, key: str = DEFAULT.key) -> DataFrame:
    return rows.select(key).distinct().join(winners.select(key), key, "left_anti")
