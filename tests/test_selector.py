import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.config import DemandConfig
from tidegrid.models.boosting import BoostedTrees
from tidegrid.models.selector import ColumnForecast, LinearPerSeries, SeriesSelector, linear_candidates
from tidegrid.models.store import load_model, save_model
from tidegrid.streaming.ring import history_table

CONFIG = DemandConfig()


@pytest.fixture(scope="module")
def table(spark):
    """Series 1 follows a, series 2 follows b, 3 is shorter than the hold-out, 4 has no value of b in the end."""
    rng = np.random.default_rng(0)
    rows = []
    for key, n in ((1, 120), (2, 120), (3, 10), (4, 120)):
        for i in range(n):
            a, b = float(rng.integers(0, 20)), float(rng.integers(0, 20))
            y = int(2 * a + 1 if key in (1, 4) else 3 * b)
            rows.append((key, i, y, a, None if key == 4 and i > 110 else b, "x"))
    df = spark.createDataFrame(rows, "PULocationID int, n int, pickup_count int, a double, b double, best_model string")
    return df.withColumn("hour", F.expr("timestamp'2024-07-01' + make_dt_interval(0, n)")).drop("n").persist()


class Broken:
    def fit(self, train):
        raise RuntimeError("no fit")


def test_each_series_gets_its_model(spark, table, tmp_path):
    candidates = {"broken": Broken(), **linear_candidates({"b": ["b"], "a": ["a"], "again": ["a"]}), "raw": ColumnForecast("a")}
    chosen = SeriesSelector(candidates, 28, config=CONFIG).fit(table)
    winners = {r["PULocationID"]: r["best_model"] for r in chosen.winners.collect()}
    assert winners == {1: "a", 2: "b", 4: "a"}  # equal scores: the earlier one; 3 is too short
    summary = {r["PULocationID"]: r for r in chosen.summary().collect()}
    assert np.isinf(summary[1]["broken_score"]) and np.isinf(summary[4]["b_score"]) and summary[2]["b_score"] < 1e-6
    got = chosen.predict(table).toPandas()
    assert len(got) == table.count() and got[got.PULocationID == 3][["best_model", "prediction"]].isna().all().all()
    fitted = got[got.PULocationID != 3]
    np.testing.assert_allclose(fitted["prediction"], fitted["pickup_count"], atol=1e-6)
    assert set(got.columns) == {*table.columns, "prediction"}

    path = str(tmp_path / "s")
    save_model(chosen, path, spark)
    again = load_model(spark, path, "selector", CONFIG)
    order = ["PULocationID", "hour"]
    pd.testing.assert_frame_equal(again.predict(table).toPandas().sort_values(order, ignore_index=True), got.sort_values(order, ignore_index=True))
    with pytest.raises(TypeError):
        load_model(spark, path, "linear")
    with pytest.raises(FileNotFoundError):
        load_model(spark, str(tmp_path / "none"))
    with pytest.raises(TypeError):
        save_model(object(), path, spark)


class NoSpace:
    def fit(self, train):
        raise OSError("no space left")


class BrokenTask:
    def fit(self, train):
        return self

    def predict(self, df):
        return df.withColumn("prediction", F.expr("cast(raise_error('lost') as double)"))


@pytest.mark.parametrize("failing", [ColumnForecast("absent"), BrokenTask(), NoSpace()])
def test_a_failed_job_is_no_score(table, failing):
    with pytest.raises(Exception, match="absent|lost|no space left"):
        SeriesSelector({"failing": failing, "raw": ColumnForecast("a")}, 28, config=CONFIG).fit(table)


def test_candidates_that_raise_are_told(spark, table, tmp_path):
    candidates = {"raw": ColumnForecast("a"), "broken": Broken()}
    chosen = SeriesSelector(candidates, 28, config=CONFIG).fit(table)
    save_model(chosen, str(tmp_path / "s"), spark)
    for model in (chosen, load_model(spark, str(tmp_path / "s"), "selector", CONFIG)):
        assert model.failures == {"broken": "RuntimeError: no fit"}
    for strict, tried in ((True, candidates), (False, {"one": Broken(), "two": Broken()})):
        with pytest.raises(RuntimeError, match="no fit"):
            SeriesSelector(tried, 28, config=CONFIG, strict=strict).fit(table)


def test_selector_without_candidates_or_rows(table):
    with pytest.raises(ValueError):
        SeriesSelector({})
    none = SeriesSelector({"a": LinearPerSeries(("a",))}, 28, config=CONFIG).fit(table.limit(0))
    assert none.winners.count() == 0 and none.predict(table).filter("prediction is not null").count() == 0


def test_boosted_trees_can_be_a_candidate(table):
    boosted = BoostedTrees(("a", "b"), iterations=2, max_depth=2, val_size=0)
    chosen = SeriesSelector({"trees": boosted, "a": LinearPerSeries(("a",))}, 28, config=CONFIG).fit(table.filter("PULocationID < 3"))
    assert {r["PULocationID"]: r["best_model"] for r in chosen.winners.collect()}[1] == "a"
    assert chosen.predict(table).filter("best_model is not null and prediction is null").count() == 0


def test_history_goes_on_from_any_cut():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 9, 400).astype(float)
    whole = history_table(np.array([]), y, CONFIG)
    frame = pd.Series(y).shift(1)
    for n in CONFIG.windows:
        rolled = frame.rolling(n, min_periods=1)
        np.testing.assert_allclose(whole[f"rolling_mean_{n}h"], rolled.mean())
        np.testing.assert_allclose(whole[f"rolling_std_{n}h"], rolled.std(), atol=1e-9)
        np.testing.assert_allclose(whole[f"rolling_min_{n}h"], rolled.min())
        np.testing.assert_allclose(whole[f"rolling_max_{n}h"], rolled.max())
    for n in CONFIG.lags:
        np.testing.assert_array_equal(whole[f"lag_{n}h"], pd.Series(y).shift(n))
    for cut in (1, 24, 168, 169, 399):
        part = history_table(y[:cut][-168:], y[cut:], CONFIG)
        for name, values in whole.items():
            np.testing.assert_allclose(part[name], values[cut:], atol=1e-9)


def test_meta_learners_read_candidates_written_once(spark, tmp_path):
    """The windows are not made again by the bounds of the split or by any pass of the meta-learner."""
    from tidegrid.catalog import all_queries

    queries = all_queries()
    events = spark.sql(
        "select id as event_id, timestamp'2024-01-01' + make_dt_interval(0, cast(id % 400 as int)) as ts, id % 3 as user_id, 'view' as event_type, 1D as value, '' as props from range(1500)"
    )
    tables = {
        "events": events, "customer": spark.sql("select id as c_custkey, 0 as c_nationkey, 'BUILDING' as c_mktsegment from range(3)"),
        "nation": spark.sql("select 0 as n_nationkey, 'A' as n_name, 0 as n_regionkey"), "region": spark.sql("select 0 as r_regionkey, 'B' as r_name"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    made = queries["m12_stacked_predictions"](spark, str(tmp_path))
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() == 3 * 168 and made.filter("prediction is null").count() == 0
    assert queries["m13_meta_weights"](spark, str(tmp_path)).count() == 3
