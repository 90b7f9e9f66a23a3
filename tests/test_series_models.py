"""Moving averages, sparse bends, smoothing against a plain loop, attributions of trees."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.config import DemandConfig
from tidegrid.models.autoregression import SeasonalAutoregression
from tidegrid.models.boosting import BoostedTrees
from tidegrid.models.explain import mean_attribution, path_means, tree_contributions, waterfall
from tidegrid.models.smoothing import Smoothing
from tidegrid.models.trend import TrendSeason

CONFIG = DemandConfig(months=("2024-01",))


def hours_frame(spark, series: dict[int, np.ndarray]):
    parts = [
        pd.DataFrame({"PULocationID": np.int32(k), "hour": pd.date_range("2024-01-01", periods=len(v), freq="h"), "pickup_count": np.asarray(v, float)})
        for k, v in series.items()
    ]
    return spark.createDataFrame(pd.concat(parts), "PULocationID int, hour timestamp, pickup_count double")


def mixed(n, seed, phi, theta, season=24):
    """A series whose seasonal difference is an autoregression of order 1 with one moving-average term."""
    shocks = np.random.default_rng(seed).normal(size=n)
    z = np.zeros(n)
    for i in range(1, n):
        z[i] = phi * z[i - 1] + shocks[i] + theta * shocks[i - 1]
    y = np.zeros(n)
    for i in range(n):
        y[i] = z[i] + (y[i - season] if i >= season else 50.0)
    return y, shocks


def test_moving_average_finds_its_coefficients(spark):
    told = {1: (0.5, 0.6), 2: (0.7, -0.4)}
    panel = hours_frame(spark, {k: mixed(6000, k, *v)[0] for k, v in told.items()})
    spec = SeasonalAutoregression(order=1, seasonal_order=0, ma=1, long_order=12, config=CONFIG)
    fitted = spec.fit(panel)
    for row in fitted.coefficients.collect():
        assert row["coef"][1:] == pytest.approx(list(told[row["PULocationID"]]), abs=0.06)
    plain = SeasonalAutoregression(order=1, seasonal_order=0, config=CONFIG).fit(panel).coefficients
    worse = {r["PULocationID"]: r["sse"] / r["n"] for r in plain.collect()}
    for row in fitted.coefficients.collect():
        # phi and theta of opposite signs nearly cancel, so there an autoregression alone comes close
        share = 0.9 if row["PULocationID"] == 1 else 0.99
        assert row["sse"] / row["n"] < share * worse[row["PULocationID"]]


def test_moving_average_forecast_equals_a_loop(spark):
    y, _ = mixed(900, 5, 0.6, 0.5)
    panel = hours_frame(spark, {1: y})
    spec = SeasonalAutoregression(order=1, seasonal_order=1, ma=2, seasonal_ma=1, long_order=5, config=CONFIG)
    fitted = spec.fit(panel)
    coef, long = fitted.coefficients.first()["coef"], fitted.long.first()["coef"]
    z = [np.nan] * 24 + list(y[24:] - y[:-24])
    shocks = [z[i] - long[0] - sum(long[1 + k] * z[i - lag] for k, lag in enumerate([1, 2, 3, 4, 5, 24])) for i in range(48, 900)]
    shocks, past = [np.nan] * 48 + shocks, list(y)
    for i in range(900, 930):
        ahead = coef[0] + coef[1] * z[i - 1] + coef[2] * z[i - 24] + coef[3] * shocks[i - 1] + coef[4] * shocks[i - 2] + coef[5] * shocks[i - 24]
        z.append(ahead)
        shocks.append(0.0)
        past.append(past[i - 24] + ahead)
    got = fitted.forecast(panel, 30).orderBy("step").toPandas()
    np.testing.assert_allclose(got["predicted"], past[900:], atol=1e-6)


def test_trend_bends_where_it_was_bent(spark):
    n, noise = 1200, np.random.default_rng(3)
    t = np.arange(n) / (n - 1)
    bends = [0.8 * i / 11 for i in (3, 8)]
    day = 4 * np.sin(np.arange(n) * 2 * np.pi / 24)
    bent = 100 + 30 * t - 90 * np.maximum(t - bends[0], 0) + 120 * np.maximum(t - bends[1], 0) + day + noise.normal(size=n)
    straight = {k: 100 + 30 * t + day + noise.normal(size=n) for k in range(2, 8)}
    flat = np.full(n, 7.0)
    fitted = TrendSeason(config=CONFIG).fit(hours_frame(spark, {1: bent, 20: flat} | straight))
    coef = {r["PULocationID"]: np.array(r["coef"][2:12]) for r in fitted.coefficients.collect()}
    assert np.flatnonzero(coef[1]).tolist() == [2, 7]
    np.testing.assert_allclose(coef[1][[2, 7]], [-90, 120], atol=8)
    assert not coef[20].any()
    assert sum(coef[k].any() for k in straight) == 0
    error = fitted.predict(hours_frame(spark, {1: bent})).agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("pickup_count"), 2)))).first()[0]
    assert error < 1.1


def smoothed(y, spec, grid):
    """One series by a plain loop: sse and the state."""
    alpha, beta, gamma, phi = grid
    p = spec.season_length
    seasonal = bool(spec.seasonal) and len(y) >= 2 * p
    mul = spec.seasonal == "mul"
    if seasonal:
        level, after = np.mean(y[:p]), np.mean(y[p : 2 * p])
        slope = {"add": (after - level) / p, "mul": (after / level) ** (1 / p), None: 0.0}[spec.trend]
        season = [v / level if mul else v - level for v in y[:p]]
    else:
        level, second = y[0], y[1] if len(y) > 1 else y[0]
        slope, season = {"add": second - level, "mul": second / level if level else 1.0, None: 0.0}[spec.trend], []
    sse = 0.0
    for v in y[p if seasonal else 1 :]:
        ahead = {"add": level + phi * slope, "mul": level * abs(slope) ** phi, None: level}[spec.trend]
        s = season.pop(0) if seasonal else None
        sse += (v - (ahead if s is None else ahead * s if mul else ahead + s)) ** 2
        plain = v if s is None else (v / s if s else 0.0) if mul else v - s
        new = alpha * plain + (1 - alpha) * ahead
        slope = {"add": beta * (new - level) + (1 - beta) * phi * slope, "mul": beta * new / level + (1 - beta) * slope**phi if level else 1.0, None: 0.0}[spec.trend]
        if seasonal:
            season.append(gamma * ((v / ahead if ahead else 1.0) if mul else v - ahead) + (1 - gamma) * s)
        level = new
    return sse, level, slope, season


@pytest.mark.parametrize("trend, seasonal, damped", [("add", "add", False), ("add", "mul", True), ("mul", "mul", False), (None, "add", False), ("add", None, True)])
def test_smoothing_equals_a_loop(spark, trend, seasonal, damped):
    noise = np.random.default_rng(1)
    series = {k: 20 + 5 * np.sin(np.arange(n) / 4) + noise.normal(size=n) for k, n in enumerate([300, 75, 48, 47, 200, 75, 1, 2])}
    spec = Smoothing(trend=trend, seasonal=seasonal, damped=damped, config=CONFIG)
    got = {r["PULocationID"]: r for r in spec.fit(hours_frame(spark, series)).states.collect()}
    assert len(got) == len(series)
    for k, y in series.items():
        best = min(spec.grid(), key=lambda g: (smoothed(y, spec, g)[0], g))
        sse, level, slope, season = smoothed(y, spec, best)
        row = got[k]
        assert (row["alpha"], row["beta"], row["gamma"], row["phi"]) == best
        assert [row["sse"], row["level"], row["slope"]] == pytest.approx([sse, level, slope], rel=1e-9)
        assert row["season"] == pytest.approx(season, rel=1e-9)


def test_smoothing_in_small_blocks_and_of_nothing(spark, monkeypatch):
    from tidegrid.models import smoothing

    series = {k: np.arange(n) % 24 + k for k, n in enumerate([120, 60, 30, 120])}
    panel = hours_frame(spark, series)
    spec = Smoothing(config=CONFIG)
    whole = spec._best([list(map(float, v)) for v in series.values()])
    monkeypatch.setattr(smoothing, "_BLOCK_NUMBERS", 1)
    assert spec._best([list(map(float, v)) for v in series.values()]) == whole
    assert spec.fit(panel.filter("false")).states.count() == 0
    gaps = panel.withColumn("pickup_count", F.when(F.col("PULocationID") > 0, F.col("pickup_count")))
    assert [r["PULocationID"] for r in spec.fit(gaps).states.filter("PULocationID = 0").collect()] == []


def test_tree_attributions_add_up(spark):
    rows = spark.range(4000).selectExpr(
        "cast(id % 4 as int) as PULocationID", "timestamp'2024-01-01' + make_dt_interval(0, cast(id as int)) as hour",
        "cast(id % 17 as double) as a", "if(id % 11 = 0, null, cast(id % 11 as double)) as b", "cast(id % 3 as double) as idle",
        "cast(3 * (id % 17) + if(id % 11 > 5, 40, 0) as double) as pickup_count",
    )
    spec = BoostedTrees(("a", "b", "idle"), iterations=6, max_depth=3, step=0.5, subsample=1.0, feature_fraction=1.0, val_size=0)
    fitted = spec.fit(rows)
    told = tree_contributions(fitted.predict(rows), fitted)
    got = told.toPandas()
    np.testing.assert_allclose(got["attr_base"] + got["attr_a"] + got["attr_b"] + got["attr_idle"], got["prediction"], atol=1e-9)
    assert got["attr_base"][0] == pytest.approx(got["prediction"].mean(), abs=1e-9)
    assert got["attr_idle"].abs().max() < 0.5
    order = [r["feature"] for r in mean_attribution(told, spec.features).collect()]
    assert order[2] == "idle"
    top = waterfall(told, spec.features, "prediction", ["PULocationID", "hour"]).collect()
    assert sum(r["value"] for r in top) + got["attr_base"][0] == pytest.approx(got["prediction"].max())
    assert all(np.isfinite(path_means(t)).all() for t in fitted.trees)


def test_moments_are_matrix_products_of_batches(spark):
    """Groups over several batches, rows out of order, a null group, rows with a missing value."""
    from tidegrid.models.linear import moment_table, unpack_moments

    rows = spark.range(0, 900, 1, 3).selectExpr("if(id % 4 = 3, null, id % 4) as g", "cast(id % 11 as double) as a", "if(id % 50 = 0, null, id % 13) as b", "id % 5 as y")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        table = moment_table(rows, ["a", "b"], "y", ["g"])
        got = {r["g"]: r.asDict() for r in table.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "MapInArrow" in table._jdf.queryExecution().executedPlan().toString()
    frame = rows.toPandas().dropna(subset=["b"])
    for g in (0, 1, 2, None):
        part = frame[frame["g"].isna() if g is None else frame["g"] == g]
        x = np.column_stack([np.ones(len(part)), part["a"], part["b"]])
        xtx, xty, yty, n = unpack_moments(got[g], 2)
        np.testing.assert_allclose(xtx, x.T @ x)
        np.testing.assert_allclose(xty, x.T @ part["y"])
        assert (yty, n) == ((part["y"] ** 2).sum(), len(part))
    empty = moment_table(rows.filter("false"), ["a", "b"], "y").first()
    assert empty["n"] == 0 and empty["m"][0] is None


def test_user_models_see_whole_series_cut_from_batches(spark):
    from tidegrid.models.plugin import per_series

    rows = spark.range(500).selectExpr("cast(if(id % 5 = 4, null, id % 5) as int) as PULocationID", "timestamp'2024-01-01' + make_dt_interval(0, cast((id * 7) % 500 as int)) as hour", "if(id = 3, null, cast(id as int)) as pickup_count")
    one = rows.union(spark.sql("select 9, timestamp'2024-01-01', 5"))

    def told(series):
        ordered = bool(series["hour"].is_monotonic_increasing) and series.index.tolist() == list(range(len(series)))
        kind = series["pickup_count"].dtype.kind
        return pd.DataFrame({"n": [len(series)], "key": [series["PULocationID"].iloc[0]], "fine": [ordered and kind == ("f" if series["pickup_count"].isna().any() else "i")]})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in (7, 100, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            made = per_series(one, told, "key double, n long, fine boolean")
            got = sorted((-1.0 if r.key is None or r.key != r.key else r.key, r.n, r.fine) for r in made.collect())
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert got == [(-1.0, 100, True), (0.0, 100, True), (1.0, 100, True), (2.0, 100, True), (3.0, 100, True), (9.0, 1, True)]
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()


def test_errors_of_nested_fits_come_from_one_factor():
    from tidegrid.operators.diagnostics import _nested_errors

    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 6)) * [1, 50, 3, 1e3, 2, 1], rng.normal(size=200)
    got = _nested_errors(x.T @ x, x.T @ y, y @ y)
    want = [np.square(y - x[:, :i] @ np.linalg.lstsq(x[:, :i], y, rcond=None)[0]).sum() for i in range(1, 7)]
    np.testing.assert_allclose(got, want)
    x[:, 3] = x[:, 1] + x[:, 2]
    assert _nested_errors(x.T @ x, x.T @ y, y @ y) is None and _nested_errors(np.zeros((2, 2)), np.zeros(2), 0.0) is None
