"""Searches read the rows of a fold no more often than they have to."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.config import DemandConfig
from tidegrid.models.backtest import halve, tune
from tidegrid.models.boosting import BoostedTrees
from tidegrid.models.trees import TreeForecaster
from tidegrid.operators.splits import series_folds

NAMES = ("a", "b", "c")
CONFIG = DemandConfig()


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = [(i % 2, i, *(float(v) for v in rng.integers(0, 10, 3)), float(rng.integers(0, 5))) for i in range(400)]
    df = spark.createDataFrame(data, "PULocationID int, n int, a double, b double, c double, pickup_count double")
    return df.withColumn("hour", F.expr("timestamp'2024-01-01' + make_dt_interval(0, n)")).drop("n").persist()


def test_searches_prepare_the_rows_of_a_fold_once(spark, rows, monkeypatch):
    made = {}
    for kind in (BoostedTrees, TreeForecaster):
        def counted(self, train, kind=kind, plain_prepare=kind.prepare):
            made[kind] = made.get(kind, 0) + 1
            return plain_prepare(self, train)

        monkeypatch.setattr(kind, "prepare", counted)
    space = {"max_depth": (1, 3, "int"), "step": (0.1, 0.5, "log")}
    base = BoostedTrees(NAMES, iterations=2, val_size=0, trees_per_cache=1)
    _, scores = halve(rows, lambda p: base.with_params(**p), 4, 2, 20, space, config=CONFIG)
    assert made[BoostedTrees] == 2 and scores.count() == 6
    forecaster = TreeForecaster(NAMES, iterations=1)
    _, scores = tune(rows, lambda p: forecaster.with_params(**p), 3, 2, 20, space, config=CONFIG)
    assert made[TreeForecaster] == 2
    assert [(r["trial"], r["fold"]) for r in scores.collect()] == [(t, f) for t in range(3) for f in (1, 2)]


def test_rows_of_folds_are_dealt_once(spark, rows):
    """A join that deals the rows anew is not left to every reader of a fold."""
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lazy, once = (series_folds(rows, ["PULocationID"], "hour", 2, 20, many_reads=m) for m in (False, True))
        plans = ["SortMergeJoin" in f._jdf.queryExecution().executedPlan().toString() for f in (lazy, once)]
        assert plans == [True, False]
        assert lazy.columns == once.columns and lazy.exceptAll(once).count() == 0 == once.exceptAll(lazy).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
