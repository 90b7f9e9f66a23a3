import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.config import DemandConfig
from tidegrid.functions import metrics
from tidegrid.models.autoregression import SeasonalAutoregression
from tidegrid.models.ensemble import ensemble_weights, fit_stack, simplex_weights
from tidegrid.models.linear import fit_groups
from tidegrid.models.trees import TreeForecaster, load_trees
from tidegrid.operators.diagnostics import adf, durbin_levinson
from tidegrid.operators.ordered import exact_quantiles, running_totals
from tidegrid.operators.quality import drift
from tidegrid.operators.series import drop_tail, tail
from tidegrid.operators.splits import date_folds, series_folds, split_last_hours

CONFIG = DemandConfig()


@pytest.fixture(scope="module")
def train(spark):
    return spark.range(500).selectExpr(
        "161 as PULocationID", "timestamp'2024-07-01' + make_dt_interval(0, cast(id as int)) as hour",
        "randn(1) as feature_1", "randn(2) as feature_2", "10 * rand(3) as feature_3",
    ).withColumn("pickup_count", 20 + 3 * F.col("feature_1") + F.col("feature_3")).persist()


def test_trees_fit_predict_importance_and_round_trip(spark, train, tmp_path):
    past, future = split_last_hours(train, "hour", 100)
    features = ("feature_1", "feature_2", "feature_3")
    fitted = TreeForecaster(features, iterations=5, max_depth=3, val_size=24).fit(past)
    got = fitted.predict(future).orderBy("hour").toPandas()["prediction"]
    assert len(got) == 100 and not got.isna().any()
    importance = fitted.importance(spark, 3).toPandas()
    assert len(importance) == 3 and importance.iloc[-1]["feature"] == "feature_2"  # not in the target
    fitted.save(str(tmp_path / "m"), spark)
    again = load_trees(spark, str(tmp_path / "m")).predict(future).orderBy("hour").toPandas()["prediction"]
    np.testing.assert_allclose(got, again)


def test_folds_do_not_overlap(train):
    folds = series_folds(train, ["PULocationID"], "hour", 3, 24).groupBy("fold", "role").agg(
        F.count("*").alias("n"), F.min("hour").alias("lo"), F.max("hour").alias("hi")
    ).toPandas().set_index(["fold", "role"])
    for fold in (1, 2, 3):
        assert folds.loc[(fold, "validate"), "n"] == 24
        assert folds.loc[(fold, "train"), "hi"] < folds.loc[(fold, "validate"), "lo"]
    assert folds.loc[(3, "validate"), "hi"] > folds.loc[(1, "validate"), "hi"]
    with pytest.raises(ValueError):
        date_folds(train, "hour", 5, 100)


def test_tails(train):
    assert tail(train, 24, ["PULocationID"], "hour").count() == 24
    assert drop_tail(train, 24, ["PULocationID"], "hour").count() == 476
    assert drop_tail(train, 500, ["PULocationID"], "hour").count() == 0


def test_metric_values(spark):
    pairs = spark.createDataFrame([(0.0, 0.0), (4.0, 2.0)], "actual double, predicted double")
    row = metrics.evaluate(pairs, "actual", "predicted").first()
    assert row["mae"] == 1.0 and row["rmse"] == pytest.approx(2**0.5)
    assert row["smape"] == pytest.approx(100 * (0 + 4 / 6) / 2)
    with pytest.raises(ValueError):
        metrics.evaluate(pairs, "actual", "predicted", ["mape"])
    series = spark.range(13).selectExpr("1 as PULocationID", "timestamp'2024-01-01' + make_dt_interval(0, cast(id as int)) as hour",
                                        "double(id + 1) as actual", "id + 1.5 as predicted")
    got = metrics.mase(series.filter("actual > 10"), series.filter("actual <= 10"), "actual", "predicted", season=1).first()
    assert got["mase"] == pytest.approx(0.5)


def test_running_totals_and_quantiles_with_a_hot_key(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 7)) as k", "double(pmod(xxhash64(id), 500)) as v")
    got = exact_quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.93}, ["k"]).toPandas().set_index("k")
    values = df.toPandas()
    for k, part in values.groupby("k"):
        np.testing.assert_allclose(got.loc[k, ["a", "b", "c"]].astype(float), part["v"].quantile([0.1, 0.5, 0.93]))
    counts = values.groupby("v").size().cumsum()
    run = running_totals(df.groupBy("v").agg(F.count("*").alias("n")), ["v"], ["n"]).toPandas().sort_values("v")
    assert list(run["cum_n"]) == list(counts) and set(run["all_n"]) == {3000}


def test_drift_statistic(spark):
    a = spark.range(400).selectExpr("double(pmod(xxhash64(id), 97)) as x")
    b = spark.range(300).selectExpr("double(pmod(xxhash64(id + 7), 80) + 10) as x")
    row = drift(a, b).first()
    va, vb = np.sort(a.toPandas()["x"]), np.sort(b.toPandas()["x"])
    grid = np.concatenate([va, vb])
    want = np.abs(np.searchsorted(va, grid, "right") / 400 - np.searchsorted(vb, grid, "right") / 300).max()
    assert row["ks_statistic"] == pytest.approx(want) and 0 <= row["p_value"] <= 1


def test_least_squares_matches_numpy(train):
    names = ["feature_1", "feature_2", "feature_3"]
    coef = fit_groups(train, names, "pickup_count", ["PULocationID"]).first()["coef"]
    pdf = train.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf[names]])
    np.testing.assert_allclose(coef, np.linalg.lstsq(x, pdf["pickup_count"], rcond=None)[0], atol=1e-8)


def test_simplex_weights_beat_a_grid():
    rng = np.random.default_rng(0)
    p, y = rng.normal(size=(200, 3)), rng.normal(size=200)
    gram, cross = p.T @ p, p.T @ y
    w = simplex_weights(gram, cross)
    assert w.min() >= 0 and w.sum() == pytest.approx(1)
    loss = lambda v: v @ gram @ v - 2 * v @ cross
    grid = [np.array([i, j, 40 - i - j]) / 40 for i in range(41) for j in range(41 - i)]
    assert loss(w) <= min(loss(v) for v in grid) + 1e-9


def test_ensembles_find_the_right_model(train):
    wide = train.select(F.col("pickup_count").alias("actual"), F.col("pickup_count").alias("good"), F.lit(5.0).alias("bad"))
    weights = {r["model"]: r["weight"] for r in ensemble_weights(wide, ["good", "bad"]).collect()}
    assert weights["good"] == pytest.approx(1, abs=1e-6)
    stacked = fit_stack(wide.withColumn("bad", F.rand(3)), ["good", "bad"])
    assert stacked.weights(train.sparkSession).filter("model = 'good'").first()["weight"] == pytest.approx(1, abs=0.01)


def test_autoregression_continues_a_perfect_season(spark):
    days = spark.range(24 * 20).selectExpr("1 as PULocationID", "timestamp'2024-01-01' + make_dt_interval(0, cast(id as int)) as hour",
                                           "cast(id % 24 as int) as pickup_count")
    got = SeasonalAutoregression(config=CONFIG).fit(days).forecast(days, 48).orderBy("step").toPandas()
    np.testing.assert_allclose(got["predicted"], [h % 24 for h in range(48)], atol=1e-6)


def test_partial_autocorrelation_of_a_first_order_process():
    got = durbin_levinson(0.6 ** np.arange(6))
    np.testing.assert_allclose(got, [1, 0.6, 0, 0, 0, 0], atol=1e-12)


def test_unit_root_against_direct_regression(spark, panel):
    got = adf(panel, "pickup_count", max_lag=0, config=CONFIG).toPandas().set_index("PULocationID")
    for zone, part in panel.toPandas().sort_values("hour").groupby("PULocationID"):
        y = part["pickup_count"].to_numpy(float)
        x = np.column_stack([np.ones(len(y) - 1), y[:-1]])
        beta, rest = np.linalg.lstsq(x, np.diff(y), rcond=None)[:2]
        spread = np.sqrt(rest[0] / (len(y) - 3) * np.linalg.inv(x.T @ x)[1, 1])
        assert got.loc[zone, "statistic"] == pytest.approx(beta[1] / spread)


class _Shifted:
    """A forecast that is wrong by a known amount, however it is fitted."""

    def __init__(self, off):
        self.off = off

    def fit(self, train):
        return self

    def predict(self, df):
        return df.withColumn("prediction", F.col("pickup_count") + F.lit(self.off))


def test_halving_finds_the_winner_of_the_full_search(panel):
    from tidegrid.models.backtest import halve, tune

    options = dict(n_trials=6, n_splits=4, test_size=24, space={"off": (0.1, 9.0, "real")}, seed=7, config=CONFIG)
    best, scores = halve(panel, lambda p: _Shifted(p["off"]), **options)
    full, every = tune(panel, lambda p: _Shifted(p["off"]), **options)
    assert best == full and every.count() == 24
    per_trial = sorted(r["count"] for r in scores.groupBy("trial").count().collect())
    assert per_trial == [1, 1, 1, 2, 3, 4]  # 6, 3, 2, 1 trials on the folds: half of the full search
    known = {(r.trial, r.fold): r.rmse for r in every.collect()}
    assert all(abs(known[r.trial, r.fold] - r.rmse) < 1e-9 for r in scores.collect())
