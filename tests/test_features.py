import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.catalog.base import Tables
from tidegrid.config import DemandConfig
from tidegrid.functions.calendar import add_calendar_features, add_holiday_features, holiday_calendar, join_holidays
from tidegrid.functions.seasonal import add_fourier_features
from tidegrid.operators.encoding import add_label_codes, add_target_encoding
from tidegrid.operators.panel import attach_zones, clean_trips, dense_grid, hourly_counts, recent_grid
from tidegrid.operators.series import add_history_features, add_lag_features, add_rolling_features
from tidegrid.operators.splits import last_horizon
from tidegrid.plans.features import build_features

CONFIG = DemandConfig()


def ordered(df):
    return df.toPandas().sort_values(["PULocationID", "hour"]).reset_index(drop=True)


@pytest.mark.parametrize("block_hours", [168, 200, 8760])
def test_history_equals_pandas_for_any_block_length(panel, block_hours):
    config = DemandConfig(block_hours=block_hours)
    got = ordered(add_history_features(panel, "pickup_count", config))
    assert len(got) == 672
    by = got.groupby("PULocationID")["pickup_count"]
    for n in config.lags:
        np.testing.assert_allclose(got[f"lag_{n}h"], by.shift(n), equal_nan=True)
    for n in config.windows:
        for stat in config.stats:
            want = by.transform(lambda x: getattr(x.shift(1).rolling(n, min_periods=1), stat)())
            np.testing.assert_allclose(got[f"rolling_{stat}_{n}h"], want, equal_nan=True, atol=1e-9)


def test_rolling_on_real_values_and_min_periods(panel):
    real = panel.withColumn("x", F.col("pickup_count") * 0.37 + 0.1)
    got = ordered(add_rolling_features(real, "x", [5, 24], ["mean", "std", "min", "max"], CONFIG, min_periods=4))
    by = got.groupby("PULocationID")["x"]
    for n in (5, 24):
        for stat in ("mean", "std", "min", "max"):
            want = by.transform(lambda x: getattr(x.shift(1).rolling(n, min_periods=4), stat)())
            np.testing.assert_allclose(got[f"rolling_{stat}_{n}h"], want, equal_nan=True, atol=1e-9)


def test_first_row_has_no_history_and_lag_168_misses_a_week(panel):
    got = ordered(add_lag_features(panel, "pickup_count", [1, 168], CONFIG, dense=True))
    assert got.groupby("PULocationID").head(1)["lag_1h"].isna().all()
    assert got["lag_168h"].isna().sum() == 2 * 168


def test_calendar_flags(panel):
    got = add_calendar_features(panel).toPandas()
    for flag in ("is_weekend", "is_rush_hour", "is_late_night"):
        assert set(got[flag]) == {0, 1}
    assert got[(got.is_weekend == 1)]["is_rush_hour"].sum() == 0


def test_fourier_is_bounded(panel):
    got = add_fourier_features(panel).toPandas().filter(like="fourier_")
    assert got.shape[1] == 12 and got.abs().max().max() <= 1 + 1e-12


def test_holidays(spark):
    days = ["2024-07-04 12:00:00", "2024-12-30 05:00:00", "2024-12-31 05:00:00", "2025-01-01 05:00:00",
            "2024-06-19 00:00:00", "2020-06-19 00:00:00", "2021-12-31 00:00:00", "2021-07-05 00:00:00",
            "2024-11-27 00:00:00", "2024-12-02 00:00:00", "2024-10-31 00:00:00"]
    df = spark.createDataFrame([(d,) for d in days], "t string").select(F.to_timestamp("t").alias("hour"))
    got = add_holiday_features(df).toPandas().sort_values("hour").set_index(pd.Index(sorted(days)))
    fed = got["is_federal_holiday"].to_dict()
    assert fed["2024-07-04 12:00:00"] == 1 and fed["2024-06-19 00:00:00"] == 1
    assert fed["2020-06-19 00:00:00"] == 0  # before its first year
    assert fed["2021-12-31 00:00:00"] == 1  # New Year 2022 fell on a Saturday
    assert fed["2021-07-05 00:00:00"] == 1  # July 4 fell on a Sunday
    assert list(got.loc[days[1:4], "is_nye"]) == [0, 1, 0] and list(got.loc[days[1:4], "is_nyd"]) == [0, 0, 1]
    assert list(got.loc[["2024-11-27 00:00:00", "2024-12-02 00:00:00"], "is_thanksgiving_week"]) == [1, 0]
    assert got.loc["2024-10-31 00:00:00", "is_halloween_eve"] == 1
    assert got.loc["2024-12-30 05:00:00", "days_to_christmas"] == 5
    assert got.loc["2024-07-04 12:00:00", "days_to_christmas"] == 99
    joined = join_holidays(df, holiday_calendar(spark, 2019, 2025)).toPandas().sort_values("hour")
    assert list(joined["is_federal_holiday"]) == list(got["is_federal_holiday"])


def test_encodings(panel):
    got = add_target_encoding(add_label_codes(panel), "pickup_count", ["PULocationID", "Borough"]).toPandas()
    assert set(zip(got.PULocationID, got.zone_enc)) == {(132, 0), (161, 1)}
    assert set(got.service_zone_enc) == {0}
    assert np.isfinite(got["PULocationID_target_enc"]).all()


def test_trips_to_panel(spark):
    trips = spark.createDataFrame(
        [("2024-07-01 00:10:00", 5), ("2024-07-01 00:20:00", 5), ("2024-07-01 03:00:00", 7), ("bad", 5),
         (None, 5), ("2024-07-01 01:00:00", None), ("2024-06-30 23:59:59", 5), ("2024-12-31 23:59:59", 264)],
        "pickup_dt string, PULocationID int",
    )
    lookup = spark.createDataFrame([(5, "Queens", None, "Boro")], "LocationID int, Borough string, Zone string, service_zone string")
    panel = attach_zones(dense_grid(hourly_counts(clean_trips(trips, DemandConfig(min_zone=1, max_zone=263)))), lookup)
    got = ordered(panel)
    assert len(got) == 8 and got["pickup_count"].sum() == 3
    assert set(got[got.PULocationID == 7]["Borough"]) == {"Unknown"} and set(got["zone_name"]) == {"Unknown"}


def test_zones_are_valid_when_the_lookup_has_them(spark):
    trips = spark.sql("select timestamp'2024-07-01 00:10:00' as pickup_dt, cast(id as int) as PULocationID from range(0, 40001, 8000)")
    zones = spark.sql("select cast(id as int) as LocationID from range(0, 40001, 16000)")
    assert clean_trips(trips).count() == 6
    assert sorted(r.PULocationID for r in clean_trips(trips, zones=zones).collect()) == [0, 16000, 32000]

from tidegrid.operators.panel import dense_grid as _dense
from tidegrid.operators.series import add_history_features as _features
from tidegrid.streaming.live import feature_writer


def test_live_features_equal_the_batch_features_over_several_batches(spark, tmp_path):
    """Quiet hours between batches, a key that comes later, and a batch that is run again."""
    counts = spark.sql(
        "select cast(k as int) as PULocationID, timestamp'2024-07-01 00:00:00' + make_dt_interval(0, h) as hour, cast(1 + (h * 7 + k) % 5 as int) as pickup_count, h "
        "from (select explode(sequence(0, 229)) as h) lateral view explode(array(1, 2, 3)) as k "
        "where not h between 60 and 66 and h % 5 <> k and (k < 3 or h >= 120)"
    )
    process = feature_writer(str(tmp_path / "panel"), str(tmp_path / "features"))
    for i, (a, b) in enumerate([(0, 60), (60, 150), (150, 230)]):
        part = counts.filter((counts.h >= a) & (counts.h < b)).drop("h")
        process(part, i)
        process(part, i)
    got = spark.read.parquet(str(tmp_path / "features")).drop("batch")
    want = _features(_dense(counts.drop("h"), DemandConfig()), "pickup_count", DemandConfig()).select(*got.columns)
    assert got.count() == want.count() == 3 * 230
    rounded = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in ((*(str(v) if i < 2 else (-1e9 if v is None else v) for i, v in enumerate(r)),) for r in df.select("PULocationID", "hour", *[c for c in got.columns if c not in ("PULocationID", "hour")]).collect()))
    assert rounded(got) == rounded(want)


def test_recent_grid_is_the_end_of_the_dense_grid(spark):
    times = ["2024-01-01 05:10:00", "2024-01-02 00:59:59", "2024-01-02 07:00:00", "2024-01-02 07:30:00"]
    trips = spark.createDataFrame([(k, t) for k, t in zip((1, 2, 2, 2), times)], "PULocationID int, t string").select(
        "PULocationID", F.col("t").cast("timestamp").alias("pickup_dt")
    )
    whole = sorted(dense_grid(hourly_counts(trips)).collect())
    for hours in (1, 8, 20, 500):  # key 1 has no trip in the shorter ones, the longest begins before the first trip
        last = sorted({r.hour for r in whole})[-hours:]
        assert sorted(recent_grid(trips, hours).collect()) == [r for r in whole if r.hour >= last[0]]
    assert recent_grid(trips.filter("false"), 5).count() == 0


def test_last_hours_are_cut_below_the_windows(spark):
    """The forecast of the last day counts no trip before the week it looks back to."""
    table = Tables(spark, "/root/testdata/sf0.001")
    assert sorted(table.last_forecast(24).collect()) == sorted(last_horizon(table.forecast, "hour", 24).collect())
    plan = table.last_candidates(24)._jdf.queryExecution().optimizedPlan().toString()
    window, bound = plan.index("Window ["), plan.rindex("pickup_dt")
    assert window < bound and "scalar-subquery" in plan[window:]


@pytest.mark.parametrize("batch", [1, 37, 10_000])
def test_history_of_whole_numbers_is_one_pass_over_batches_of_any_size(spark, panel, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        gaps = panel.filter("hour < '2024-07-05'").withColumn("pickup_count", F.when(F.hour("hour") != 7, F.col("pickup_count")))
        made = add_history_features(gaps, "pickup_count", CONFIG, dense=False)
        got = ordered(made)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    by = got.groupby("PULocationID")["pickup_count"]
    np.testing.assert_allclose(got["lag_24h"], by.shift(24), equal_nan=True)
    for stat in CONFIG.stats:
        want = by.transform(lambda x: getattr(x.shift(1).rolling(24, min_periods=1), stat)())
        np.testing.assert_allclose(got[f"rolling_{stat}_24h"], want, equal_nan=True, atol=1e-9)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan


def test_a_null_key_is_a_series_of_its_own(spark):
    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 6), (3, 1, 7), (3, 2, 8)], "PULocationID int, h int, pickup_count int")
    rows = rows.withColumn("hour", F.expr("timestamp'2024-01-01' + make_dt_interval(0, h)")).drop("h")
    got = add_rolling_features(rows, "pickup_count", [2], ["mean"], CONFIG).filter("rolling_mean_2h is not null").collect()
    assert sorted((r.PULocationID or 0, r.rolling_mean_2h) for r in got) == [(0, 5.0), (3, 7.0)]


def test_hours_of_few_keys_are_made_by_many_tasks(spark):
    rows = spark.range(40).selectExpr("cast(id as int) as PULocationID", "timestamp'2024-01-01' + make_dt_interval(0, cast(id as int)) as hour", "1 as pickup_count")
    plan = dense_grid(rows)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_out_of_fold_predictions_are_written_fold_by_fold(panel):
    from tidegrid.models.ensemble import StackingEnsemble

    last = lambda rows: lambda df: df.withColumn("prediction", F.lit(1.0))
    made = StackingEnsemble({"a": last, "b": last}, "ridge", 3, 28, CONFIG).out_of_fold(panel)
    assert made.groupBy("fold").count().filter("count = 56").count() == 3
    assert len({f.split("/out-of-fold-")[1].split("/")[0] for f in made.inputFiles()}) == 3


def test_the_grid_is_made_without_a_join_and_stays_dealt_by_key(spark):
    """A repeated, a null and an unused key, an hour off the grid, two counts of one hour."""
    hour = "timestamp'2024-01-01' + make_dt_interval(0, 0, m)"
    counts = spark.createDataFrame([(1, 120, 3), (1, 120, 4), (1, 300, 1), (2, 0, 2), (None, 60, 9), (3, 210, 7), (4, 240, None)], "PULocationID int, m int, pickup_count int")
    counts = counts.select("PULocationID", F.expr(hour).alias("hour"), "pickup_count")
    made = dense_grid(counts)
    got = sorted((r.PULocationID or 0, r.hour.hour, r.pickup_count) for r in made.collect())
    want = {(k, h): 0 for k in range(5) for h in range(6)} | {(1, 5): 1, (2, 0): 2}
    del want[1, 2]
    assert got == sorted([(k, h, n) for (k, h), n in want.items()] + [(1, 2, 3), (1, 2, 4)])
    keys = spark.createDataFrame([(1,), (1,), (None,), (9,)], "PULocationID int")
    again = dense_grid(counts, keys=keys).groupBy("PULocationID").agg(F.count("hour").alias("n"), F.sum("pickup_count").alias("s")).collect()
    assert {r.PULocationID: (r.n, r.s) for r in again} == {1: (14, 16), None: (6, 0), 9: (6, 0)}
    plan = made.groupBy("PULocationID").count()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.index("Generate") < plan.index("Exchange")


def test_columns_of_the_time_are_made_once_per_hour(spark, panel):
    rows = panel.union(spark.createDataFrame([(161, None, 1, "Manhattan", "Midtown Center", "Yellow Zone")], panel.schema))
    made = build_features(rows, None, CONFIG, include_target_encoding=False, include_codes=False, dense=False, drop_incomplete=False)
    assert "next_day" not in made._jdf.queryExecution().optimizedPlan().toString()
    start = rows.agg(F.min("hour")).scalar()
    one_by_one = add_holiday_features(add_fourier_features(add_calendar_features(rows), origin=start))
    names = one_by_one.columns
    text = lambda df: sorted(str(r) for r in df.select(*names).collect())
    assert text(made) == text(one_by_one) and [c for c in made.columns if c in names] == names


def test_ring_state_serves_groups_of_keys(spark, tmp_path, monkeypatch):
    """Two ingests of several files, more keys than groups, quiet hours between, a key that comes later and one that is null."""
    from tidegrid.sources.trips import trip_stream
    from tidegrid.streaming import live, ring

    monkeypatch.setattr(ring, "GROUPS", 2)
    monkeypatch.setattr(ring, "SPAN", 50)
    trips = spark.sql(
        "select cast(if(k = 9, null, k) as int) as PULocationID, timestamp'2024-07-01 00:10:00' + make_dt_interval(0, h) as pickup_dt, h "
        "from (select explode(sequence(0, 259)) as h) lateral view explode(array(1, 2, 3, 4, 9)) as k "
        "lateral view explode(sequence(0, (h * 7 + k) % 3)) as again where not h between 50 and 60 and (h + k) % 4 <> 0 and (k < 4 or h >= 120)"
    )
    given = trips.drop("h")
    origin = 1719792000  # 2024-07-01 00:00:00
    with ring.keyed_state(spark):
        for a, b in ((0, 100), (100, 260)):
            given.filter((trips.h >= a) & (trips.h < b)).repartition(3).write.mode("append").parquet(f"{tmp_path}/trips")
            stream = ring.live_ring_features(trip_stream(spark, f"{tmp_path}/trips", given.schema), origin)
            got = live.run_to_table(stream, f"{tmp_path}/table", f"{tmp_path}/state")
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "ring").load(f"{tmp_path}/state")
    assert state.count() <= 2
    counts = hourly_counts(given, DemandConfig())
    counts = counts.filter("hour < timestamp'2024-07-11 17:00:00'")  # two hours before the last trip
    want = _features(_dense(counts), "pickup_count", DemandConfig()).select(*got.columns)
    shown = lambda df: sorted(tuple(round(-1.0 if v is None else v, 6) if i > 1 else str(v) for i, v in enumerate(r)) for r in df.fillna(-1, ["PULocationID"]).collect())
    assert got.count() == 5 * 257 and shown(got) == shown(want)
