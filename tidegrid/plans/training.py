"""Train all models, compare them on the last hours, keep the best."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.config import DEFAULT, DemandConfig
from tidegrid.functions.metrics import evaluate
from tidegrid.models.ensemble import StackingEnsemble, WeightedEnsemble
from tidegrid.models.trees import FittedTrees, presets
from tidegrid.operators.encoding import feature_columns
from tidegrid.operators.ranking import best_by
from tidegrid.operators.splits import sample_keys, split_last_hours
from tidegrid.sources.tables import log_run

# Columns that are never model inputs.
NOT_FEATURES = (
    "pickup_count", "hour", "PULocationID", "DOLocationID", "Borough", "zone_name", "service_zone", "panel_month",
)


@dataclass
class Comparison:
    fitted: dict[str, FittedTrees]
    ensembles: dict[str, object]
    predictions: DataFrame
    metrics: DataFrame
    features: list[str]

    def best(self) -> DataFrame:
        return best_by(self.metrics, "model", "rmse")


def compare_models(
    featured: DataFrame,
    n_zones: int | None = None,
    features: Sequence[str] | None = None,
    with_ensembles: bool = True,
    val_size: int = 28,
    n_splits: int = 5,
    config: DemandConfig = DEFAULT,
    **tree_params,
) -> Comparison:
    """Fit the tree models and both ensembles, score them on the last test hours."""
    df = sample_keys(featured, config.key, n_zones) if n_zones else featured
    names = list(features or feature_columns(df, NOT_FEATURES))
    train, test = split_last_hours(df, config.time, config.test_hours)
    specs = presets(names, **tree_params)
    fitted = {s.name: s.fit(train) for s in specs}
    predictors: dict[str, object] = dict(fitted)
    ensembles: dict[str, object] = {}
    if with_ensembles:
        fits = {s.name: (lambda t, s=s: s.fit(t).predict) for s in specs}
        ensembles = {
            "weighted": WeightedEnsemble(fits, val_size, config).fit(train),
            "stacked": StackingEnsemble(fits, "ridge", n_splits, val_size, config).fit(train),
        }
        predictors |= ensembles
    parts = [
        model.predict(test).select(
            config.key, config.time, F.col(config.target).cast("double").alias("actual"),
            F.lit(name).alias("model"), F.col("prediction").alias("predicted"),
        )
        for name, model in predictors.items()
    ]
    predictions = parts[0]
    for part in parts[1:]:
        predictions = predictions.unionByName(part)
    metrics = evaluate(predictions, "actual", "predicted", by=["model"])
    return Comparison(fitted, ensembles, predictions, metrics, names)


def train_and_save(featured: DataFrame, models_dir: str, runs_path: str, run: str, **options) -> Comparison:
    """``compare_models``, then store every tree model and log its metrics."""
    spark = featured.sparkSession
    result = compare_models(featured, **options)
    for row in result.metrics.collect():  # one row per model
        name = row["model"]
        params = {}
        if name in result.fitted:
            result.fitted[name].save(f"{models_dir}/{name}", spark)
            params = {r["param"]: r["value"] for r in result.fitted[name].params(spark).collect()}
        log_run(spark, runs_path, run, name, params, {m: row[m] for m in ("rmse", "mae", "smape")})
    return result
