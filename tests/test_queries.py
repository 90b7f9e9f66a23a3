"""Every SQL twin agrees with its query on the smallest data (a spread of queries; ``check.py`` runs all)."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
CHOSEN = [
    "top_zones_by_rolling_mean", "preprocess_trips", "w2_rolling_features", "w15_series_folds", "f6_holiday_features",
    "a16_region_zone_rollup", "a27_drift", "u2_model_agreement", "m14_best_model_per_zone", "e11_acf",
    "m8_holt_winters_fit", "t4_live_hourly_counts", "t5_live_trailing_day", "t6_ring_features", "m14_selector_predictions",
    "m1_first_splits", "s14_stored_linear_model", "s14_stored_selector", "s3_zone_lookup",
    "s4_absent_sources", "s5_missing_months", "s11_stored_features", "s16_sales_tables", "p17_feature_list", "a15_hot_cold", "p27_residual_band",
    "p28_global_band",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, db, name):
    mine = entry_module.queries()[name](spark, FOLDER).toPandas()
    other = db.execute(entry_module.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows_of(mine) == rows_of(other)


def test_every_twin_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
