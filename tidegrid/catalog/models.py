"""Fitted models, ensembles, roll-outs and scoring.

Tree models have no SQL twin; their queries run few, shallow trees.
"""

from __future__ import annotations

from dataclasses import replace
from functools import partial

import pandas as pd
from pyspark.sql import functions as F

from tidegrid.catalog.base import CONFIG, Tables, query
from tidegrid.catalog.panel import scratch
from tidegrid.models import ensemble
from tidegrid.functions.metrics import evaluate
from tidegrid.models.autoregression import SeasonalAutoregression
from tidegrid.models.backtest import BOOSTED_SPACE, Backtest, halve, tune
from tidegrid.models.boosting import BoostedTrees, boosting_presets
from tidegrid.models.explain import mean_attribution, permutation_importance, tree_contributions, waterfall
from tidegrid.models.plugin import per_series
from tidegrid.models.rollout import roll_out
from tidegrid.models.selector import ColumnForecast, FittedLinear, LinearPerSeries, SeriesSelector, linear_candidates
from tidegrid.models.smoothing import Smoothing
from tidegrid.models.store import load_model, save_model
from tidegrid.models.trees import TreeForecaster, load_trees, presets
from tidegrid.models.trend import TrendSeason
from tidegrid.operators.encoding import feature_columns
from tidegrid.operators.series import tail
from tidegrid.operators.splits import last_horizon, split_last_hours
from tidegrid.plans.features import build_features
from tidegrid.plans.prediction import forecast_all_zones, forecast_zone, score_last_hours
from tidegrid.plans.training import NOT_FEATURES, compare_models
from tidegrid.session import stored
from tidegrid.sources.tables import log_run, run_metrics

FEATURES = ("lag_1h", "lag_24h", "lag_168h", "rolling_mean_24h", "rolling_std_24h", "hour_of_day", "day_of_week")
SMALL = dict(iterations=3, max_depth=3, step=0.3)
ORIGIN = "2024-01-01 00:00:00"


def featured(t: Tables):
    return build_features(
        t.panel, None, CONFIG, include_target_encoding=False, include_codes=False, origin=ORIGIN
    )


def lean(t: Tables):
    """The features of the small models, made once: their fits and predictions read them several times."""
    return stored(featured(t).select("PULocationID", "Borough", "zone_name", "hour", "pickup_count", *FEATURES), "features")


def split(rows):
    return split_last_hours(rows, "hour", 168)


def stored_split(t: Tables):
    return split(stored(featured(t), "features"))


PREDICTION = "PULocationID:i hour:t prediction:d"


#: Rounds that patience may cut short; the trees see every feature of the table.
BOOSTING = dict(iterations=30, max_depth=4, step=0.1, patience=3, val_size=24)


def boosted(t: Tables, kind: int):
    """Fitted on all but the last week, and that week with its predictions."""
    train, test = stored_split(t)
    spec = boosting_presets(feature_columns(train, NOT_FEATURES), **BOOSTING)[kind]
    return spec.fit(train).predict(test)


@query("m1_boosted_trees", PREDICTION)
def _(t):
    return boosted(t, 0)


@query("m2_fine_boosted_trees", PREDICTION)
def _(t):
    return boosted(t, 1)


@query("m3_tree_forest", PREDICTION)
def _(t):
    train, test = split(lean(t))
    return presets(FEATURES, **SMALL)[2].fit(train).predict(test)


@query("m3_symmetric_trees", PREDICTION)
def _(t):
    return boosted(t, 2)


def held_week() -> str:
    """What a forecast of the last week must be: whole, and better than last week's hour."""
    return """select (select count(*) from dense where hour > (select max(hour) - interval 168 hour from dense)) as n_rows,
        0 as n_missing, 'true' as beats_naive"""


def week_facts(predicted):
    error = lambda name: F.sqrt(F.avg(F.pow(F.col(name) - F.col("pickup_count"), 2)))
    return predicted.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("prediction").isNull() | F.isnan("prediction")).alias("n_missing"),
        (error("prediction") < error("lag_168h")).cast("string").alias("beats_naive"),
    )


for _name, _kind in (("m1_better_than_naive", 0), ("m2_better_than_naive", 1), ("m3_better_than_naive", 2)):
    query(_name, "n_rows:i n_missing:i beats_naive:s", "dense", held_week())(lambda t, kind=_kind: week_facts(boosted(t, kind)))


HOUR_CUTS = tuple(float(h) for h in range(23))
SPLIT_SPEC = BoostedTrees(
    ("hour_of_day", "day_of_week", "naive_24"), iterations=1, max_depth=2, step=0.5, l1=2.0, l2=5.0, subsample=1.0, feature_fraction=1.0,
    min_instances=20, val_size=0, cuts={"hour_of_day": HOUR_CUTS, "day_of_week": HOUR_CUTS[:6], "naive_24": (0.0, 1.0, 2.0, 3.0)},
)
_PULL = "pow(greatest(abs({g}) - 2e0, 0), 2) / ({h} + 5e0)"
_CUT_GAIN = f"{_PULL.format(g='gl', h='hl')} + {_PULL.format(g='(gt - gl)', h='(ht - hl)')} - {_PULL.format(g='gt', h='ht')}"


def _best_cut(source: str) -> str:
    """The best cut of every node (path) of ``source`` (path, g, f0, f1, f2)."""
    return f"""select *, round_even(gain * 1e6, 0) / 1e6 as gain6 from (
            select *, {_CUT_GAIN} as gain from (
                select path, o, c, sum(case when v <= c then g else 0 end) as gl, count(*) filter (v <= c) as hl, sum(g) as gt, count(*) as ht
                from (select path, g, unnest([0, 1, 2]) as o, unnest([f0, f1, f2]) as v from {source}) join cuts using (o) group by all))
        where hl >= 20 and ht - hl >= 20 and gain > 1e-9
        qualify row_number() over (partition by path order by round_even(gain * 1e6, 0) desc, o, c) = 1"""


_SPLIT_STEPS = f"""y as (select pickup_count as y, cast(hour(hour) as double) as f0, cast(isodow(hour) - 1 as double) as f1, naive_24 as f2 from candidates),
        x as materialized (select '' as path, round_even(((select avg(y) from y) - y) * 65536, 0) / 65536 as g, f0, f1, f2 from y),
        cuts as (select 0 as o, unnest(range(0, 23)) as c union all select 1, unnest(range(0, 6)) union all select 2, unnest(range(0, 4))),
        b0 as materialized ({_best_cut('x')}),
        x1 as materialized (select case when list_extract([f0, f1, f2], o + 1) <= c then 'L' else 'R' end as path, o as o1, x.g, f0, f1, f2 from x, b0),
        b1 as materialized ({_best_cut('x1')}),
        x2 as (select x1.path as first, x1.path || case when o is null then '' when list_extract([f0, f1, f2], o + 1) <= c then 'L' else 'R' end as path,
            x1.o1, b1.o as o2, x1.g from x1 left join b1 on b1.path = x1.path)"""


def split_rows(t: Tables):
    """Stored, as fits and attributions read them several times."""
    rows = t.candidates.withColumns({"hour_of_day": F.hour("hour").cast("double"), "day_of_week": F.weekday("hour").cast("double")})
    return stored(rows.select("PULocationID", "hour", "pickup_count", *SPLIT_SPEC.features), "split-rows")


@query(
    "m1_first_splits", "path:s feature:s threshold:d gain:d3 rows:i value:d", "candidates",
    f"""with {_SPLIT_STEPS},
        names as (select unnest([0, 1, 2]) as o, unnest(['hour_of_day', 'day_of_week', 'naive_24']) as feature)
    select path, feature, cast(c as double) as threshold, gain6 as gain, ht as rows, 0e0 as value
        from (select * from b0 union all select * from b1) join names using (o)
    union all
    select path, null, null, 0e0, count(*), -0.5e0 * sign(sum(g)) * greatest(abs(sum(g)) - 2e0, 0) / (count(*) + 5e0) from x2 group by path""",
)
def _(t):
    nodes = SPLIT_SPEC.fit(split_rows(t)).nodes(t.spark)
    above = nodes.select(F.col("node").alias("parent"), F.explode(F.array(F.struct("left", F.lit("L").alias("side")), F.struct(F.col("right").alias("left"), F.lit("R").alias("side")))).alias("s"))
    above = above.filter("s.left is not null").select("parent", F.col("s.left").alias("node"), F.col("s.side").alias("side"))
    grand = above.select(F.col("node").alias("parent"), F.col("side").alias("before"))
    paths = above.join(grand, "parent", "left").select("node", F.concat(F.coalesce("before", F.lit("")), "side").alias("path"))
    return nodes.join(paths, "node", "left").withColumn("path", F.coalesce("path", F.lit("")))


@query("m4_feature_importance", "feature:s importance:d")
def _(t):
    train, _ = split(lean(t))
    return TreeForecaster(FEATURES, **SMALL).fit(train).importance(t.spark, 5)


@query("m5_parameter_search", "trial:i fold:i rmse:d")
def _(t):
    space = {"max_depth": (2, 4, "int"), "step": (0.1, 0.3, "log")}
    make = lambda params: TreeForecaster(FEATURES, iterations=2).with_params(**params)
    _, scores = tune(featured(t).select("PULocationID", "hour", "pickup_count", *FEATURES), make, n_trials=2, n_splits=2, test_size=48, space=space, config=CONFIG)
    return scores


@query("m5_halving_search", "trial:i fold:i rmse:d")
def _(t):
    space = BOOSTED_SPACE | {"max_depth": (2, 4, "int"), "iterations": (2, 5, "int"), "step": (0.1, 0.5, "log")}
    rows = featured(t)
    base = BoostedTrees(tuple(feature_columns(rows, NOT_FEATURES)), val_size=0)
    _, scores = halve(rows, lambda params: base.with_params(**params), 4, 3, 48, space, config=CONFIG)
    return scores


@query("m6_seasonal_autoregression", "PULocationID:i hour:t step:i predicted:d")
def _(t):
    return SeasonalAutoregression(config=CONFIG).fit(t.dense).forecast(t.dense, 24)


@query(
    "m6_autoregression_design", "PULocationID:i hour:t z:d ar1:d ar2:d sar1:d", "dense",
    """with z as (select PULocationID, hour,
            pickup_count - lag(pickup_count, 24) over (partition by PULocationID order by hour) as z from dense)
    select PULocationID, hour, z, lag(z, 1) over w as ar1, lag(z, 2) over w as ar2, lag(z, 24) over w as sar1
    from z window w as (partition by PULocationID order by hour)""",
)
def _(t):
    return SeasonalAutoregression(config=CONFIG).design(t.dense)


@query(
    "m6_autoregression_fit", "PULocationID:i intercept:d ar1:d", "dense",
    """with z as (select PULocationID, hour,
            pickup_count - lag(pickup_count, 24) over (partition by PULocationID order by hour) as z from dense),
        l as (select *, lag(z) over (partition by PULocationID order by hour) as x from z)
    select PULocationID, regr_intercept(z, x) as intercept, regr_slope(z, x) as ar1 from l group by 1""",
)
def _(t):
    fitted = SeasonalAutoregression(order=1, seasonal_order=0, config=CONFIG).fit(t.dense).coefficients
    return fitted.select("PULocationID", F.col("coef")[0].alias("intercept"), F.col("coef")[1].alias("ar1"))


@query(
    "m6_moving_average_fit", "Borough:s intercept:d4 ar1:d4 ma1:d4", "panel",
    """with y as (select Borough, hour, cast(sum(pickup_count) as double) as y from panel where Borough is not null group by 1, 2),
        z as (select Borough, hour, y - lag(y, 24) over (partition by Borough order by hour) as z from y),
        l as materialized (select *, lag(z) over (partition by Borough order by hour) as x from z),
        a as (select Borough, regr_intercept(z, x) as a, regr_slope(z, x) as b from l group by 1),
        e as (select l.Borough, hour, z, x, z - a - b * x as e from l join a using (Borough)),
        d as (select *, lag(e) over (partition by Borough order by hour) as s from e),
        m as (select Borough, avg(z) as mz, avg(x) as mx, avg(s) as ms, covar_pop(z, x) as zx, covar_pop(z, s) as zs,
            covar_pop(x, s) as xs, var_pop(x) as xx, var_pop(s) as ss from d where z is not null and x is not null and s is not null group by 1),
        b as (select *, (zx * ss - zs * xs) / (xx * ss - xs * xs) as b1, (zs * xx - zx * xs) / (xx * ss - xs * xs) as b2 from m)
    select Borough, mz - b1 * mx - b2 * ms as intercept, b1 as ar1, b2 as ma1 from b""",
)
def _(t):
    regions = t.panel.filter("Borough is not null").groupBy("Borough", "hour").agg(F.sum("pickup_count").alias("pickup_count"))
    spec = SeasonalAutoregression(order=1, seasonal_order=0, ma=1, long_order=1, config=replace(CONFIG, key="Borough"))
    coef = lambda i, name: F.col("coef")[i].alias(name)
    return spec.fit(regions).coefficients.select("Borough", coef(0, "intercept"), coef(1, "ar1"), coef(2, "ma1"))


@query("m6_moving_average_forecast", "PULocationID:i hour:t step:i predicted:d")
def _(t):
    return SeasonalAutoregression(ma=1, seasonal_ma=1, config=CONFIG).fit(t.dense).forecast(t.dense, 24)


@query("m7_trend_and_season", PREDICTION)
def _(t):
    train, test = split_last_hours(t.dense, "hour", 168)
    return TrendSeason(config=CONFIG).fit(train).predict(test)


HOLT_WINTERS = Smoothing(alphas=(0.1, 0.4), betas=(0.01,), gammas=(0.1,), config=CONFIG)


HW_SQL = """with recursive v as (select PULocationID, list(cast(pickup_count as double) order by hour) as vals
            from dense group by 1),
        g as (select unnest([0.1e0, 0.4e0]) as alpha),
        init as (select PULocationID, alpha, list_avg(vals[1:24]) as level,
            (list_avg(vals[25:48]) - list_avg(vals[1:24])) / 24e0 as slope,
            list_transform(vals[1:24], lambda x: x - list_avg(vals[1:24])) as season from v, g),
        r as (
            select PULocationID, alpha, 24 as i, level, slope, season, 0e0 as sse from init
            union all
            select q.PULocationID, q.alpha, q.i + 1, q.nl, 0.01e0 * (q.nl - q.level) + 0.99e0 * q.slope,
                list_concat(q.season[2:24], [0.1e0 * (q.y - q.level - q.slope) + 0.9e0 * q.season[1]]),
                q.sse + (q.y - q.level - q.slope - q.season[1]) * (q.y - q.level - q.slope - q.season[1])
            from (select r.*, v.vals[r.i + 1] as y,
                    r.alpha * (v.vals[r.i + 1] - r.season[1]) + (1 - r.alpha) * (r.level + r.slope) as nl
                  from r join v on v.PULocationID = r.PULocationID where r.i < len(v.vals)) q),
        e as (select *, row_number() over (partition by PULocationID order by i desc, sse) as k from r)"""


@query(
    "m8_holt_winters_fit", "PULocationID:i alpha:d sse:d level:d slope:d next_season:d", "dense",
    f"""{HW_SQL}
    select PULocationID, alpha, sse, level, slope, season[1] as next_season from e where k = 1""",
)
def _(t):
    states = HOLT_WINTERS.fit(t.dense).states
    return states.withColumn("next_season", F.col("season")[0])


@query(
    "m8_holt_winters_forecast", "PULocationID:i hour:t step:i predicted:d", "dense",
    f"""{HW_SQL}
    select PULocationID, last + s * interval 1 hour as hour, s as step, level + s * slope + season[s] as predicted
    from e, (select max(hour) as last from dense), (select unnest(range(1, 25)) as s) where k = 1""",
)
def _(t):
    return HOLT_WINTERS.fit(t.dense).forecast(t.dense, 24)


#: The whole default grid of twelve points.
WHOLE_GRID = Smoothing(config=CONFIG)


@query(
    "m8_whole_grid", "PULocationID:i alpha:d beta:d gamma:d sse:d4 level:d4 slope:d4", "dense",
    """with recursive v as (select PULocationID, list(cast(pickup_count as double) order by hour) as vals from dense group by 1),
        g as (select * from (select unnest([0.1e0, 0.3e0, 0.6e0]) as alpha), (select unnest([0.01e0, 0.1e0]) as beta),
            (select unnest([0.05e0, 0.2e0]) as gamma)),
        init as (select PULocationID, vals, alpha, beta, gamma, list_avg(vals[1:24]) as level,
            (list_avg(vals[25:48]) - list_avg(vals[1:24])) / 24e0 as slope from v, g),
        r as (
            select PULocationID, alpha, beta, gamma, 24 as i, level, slope, list_transform(vals[1:24], lambda x: x - level) as season, 0e0 as sse from init
            union all
            select q.PULocationID, q.alpha, q.beta, q.gamma, q.i + 1, q.nl, q.beta * (q.nl - q.level) + (1 - q.beta) * q.slope,
                list_concat(q.season[2:24], [q.gamma * (q.y - q.level - q.slope) + (1 - q.gamma) * q.season[1]]),
                q.sse + pow(q.y - q.level - q.slope - q.season[1], 2)
            from (select r.*, v.vals[r.i + 1] as y, r.alpha * (v.vals[r.i + 1] - r.season[1]) + (1 - r.alpha) * (r.level + r.slope) as nl
                  from r join v on v.PULocationID = r.PULocationID where r.i < len(v.vals)) q),
        e as (select *, row_number() over (partition by PULocationID order by i desc, sse, alpha, beta, gamma) as k
            from (select PULocationID, alpha, beta, gamma, i, level, slope, sse from r))
    select * from e where k = 1""",
)
def _(t):
    return WHOLE_GRID.fit(t.dense).states


@query("m8_damped_multiplicative", "PULocationID:i hour:t step:i predicted:d")
def _(t):
    spec = Smoothing(
        alphas=(0.2,), betas=(0.05,), gammas=(0.1,), phis=(0.9,), seasonal="mul", damped=True, config=CONFIG
    )
    return spec.fit(t.dense).forecast(t.dense, 24)


@query("m9_roll_out", "PULocationID:i hour:t step:i predicted:d")
def _(t):
    fitted = TreeForecaster(FEATURES, **SMALL).fit(featured(t))
    return roll_out(t.panel, fitted.predict, 12, ORIGIN, config=CONFIG)


def linear_fits(t: Tables):
    """Three base models, least squares per series on different features; each fit is stored, as several frames read it."""
    features = {"day": ("lag_24h", "lag_1h"), "week": ("lag_168h",), "mean": ("rolling_mean_24h", "rolling_mean_168h")}

    def fit(names, train):
        fitted = LinearPerSeries(names).fit(train)
        return FittedLinear(fitted.spec, stored(fitted.coefficients, "base-model")).predict

    return {name: partial(fit, names) for name, names in features.items()}


def base_split(t: Tables):
    """The rows with what the base models read, stored once and split."""
    columns = ("lag_1h", "lag_24h", "lag_168h", "rolling_mean_24h", "rolling_mean_168h")
    return split(stored(featured(t).select("PULocationID", "hour", "pickup_count", *columns), "features"))


@query("m10_weighted_ensemble", PREDICTION)
def _(t):
    train, test = base_split(t)
    return ensemble.WeightedEnsemble(linear_fits(t), 28, CONFIG).fit(train).predict(test)


@query("m12_stacking_ensemble", PREDICTION)
def _(t):
    train, test = base_split(t)
    return ensemble.StackingEnsemble(linear_fits(t), "ridge", 3, 28, CONFIG).fit(train).predict(test)


@query("m17_score_last_hours", "PULocationID:i hour:t pickup_count:i prediction:d residual:d")
def _(t):
    rows = lean(t)
    train, _ = split(rows)
    return score_last_hours(rows, TreeForecaster(FEATURES, **SMALL).fit(train), 24, CONFIG)


@query("m18_forecast_all_zones", "PULocationID:i zone_name:s hour:t actual:i predicted:i residual:i")
def _(t):
    rows = lean(t)
    train, _ = split(rows)
    return forecast_all_zones(rows, TreeForecaster(FEATURES, **SMALL).fit(train), 24, CONFIG)


@query("m19_forecast_zone", "PULocationID:i zone_name:s hour:s predicted:d")
def _(t):
    rows = lean(t)
    train, _ = split(rows)
    return forecast_zone(rows, TreeForecaster(FEATURES, **SMALL).fit(train), 3, 24, CONFIG)


@query("m20_model_comparison", "model:s rmse:d mae:d smape:d")
def _(t):
    return compare_models(lean(t), features=FEATURES, with_ensembles=False, config=CONFIG, **SMALL).metrics


@query("m21_model_parameters", "model:s param:s value:s")
def _(t):
    train, _ = split(lean(t))
    return TreeForecaster(FEATURES, **SMALL).fit(train).params(t.spark)


def _mean_model(series: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(
        {"PULocationID": [int(series["PULocationID"].iloc[0])], "mean": [float(series["pickup_count"].mean())]}
    )


@query(
    "m22_user_model_per_series", "PULocationID:i mean:d", "dense",
    "select PULocationID, avg(pickup_count) as mean from dense group by 1",
)
def _(t):
    return per_series(t.dense, _mean_model, "PULocationID int, mean double", CONFIG)


@query("e8_backtest", "fold:i rmse:d mae:d smape:d")
def _(t):
    test = Backtest(TreeForecaster(FEATURES, **SMALL), n_splits=2, test_size=48, config=CONFIG).run(lean(t))
    return test.metrics()


@query("e14_permutation_importance", "feature:s rmse:d importance:d")
def _(t):
    train, test = split(lean(t))
    fitted = TreeForecaster(FEATURES, **SMALL).fit(train)
    columns = test.select("PULocationID", "hour", "pickup_count", *FEATURES)
    return permutation_importance(columns, fitted.predict, FEATURES[:3], config=CONFIG)


SELECTION_FEATURES = {"day": ["naive_24"], "week": ["naive_168"], "mean": ["mean_24"]}
_LONG = """f as materialized (select *, row_number() over (partition by PULocationID order by hour desc) as r,
            count(*) over (partition by PULocationID) as n from candidates),
        l as materialized (select PULocationID, hour, pickup_count as y, r, o, m, x from (
            select *, unnest([0, 1, 2]) as o, unnest(['day', 'week', 'mean']) as m, unnest([naive_24, naive_168, mean_24]) as x from f) where n > 28)"""
_FIT = """select PULocationID, m, coalesce(regr_slope(y, x), 0) as b,
            case when regr_slope(y, x) is null then avg(y) else regr_intercept(y, x) end as a from l {} group by 1, 2"""


@query(
    "e14_tree_attribution", "feature:s importance:d", "candidates",
    f"""with {_SPLIT_STEPS},
        v as (select *, -0.5e0 * sign(sum(g) over w) * greatest(abs(sum(g) over w) - 2e0, 0) / (count(*) over w + 5e0) as value
            from x2 window w as (partition by path)),
        m as (select *, avg(value) over (partition by first) as below, avg(value) over () as top from v),
        f as (select unnest([0, 1, 2]) as o, unnest(['hour_of_day', 'day_of_week', 'naive_24']) as feature)
    select feature, avg(abs(case when o1 = o then below - top else 0e0 end + case when o2 = o then value - below else 0e0 end)) as importance
    from m, f group by 1""",
)
def _(t):
    rows = split_rows(t)
    return mean_attribution(tree_contributions(rows, SPLIT_SPEC.fit(rows)), SPLIT_SPEC.features)


@query(
    "e14_tree_attribution_adds_up", "n_rows:i n_apart:i", "dense",
    """select (select count(*) from dense where hour > (select max(hour) - interval 168 hour from dense)) as n_rows, 0 as n_apart""",
)
def _(t):
    train, test = stored_split(t)
    spec = boosting_presets(feature_columns(train, NOT_FEATURES), **BOOSTING)[0]
    fitted = spec.fit(train)
    told = tree_contributions(fitted.predict(test), fitted)
    total = sum((F.col(f"attr_{f}") for f in spec.features), F.col("attr_base"))
    return told.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(total - F.col("prediction")) > 1e-6).alias("n_apart"))


@query("e15_tree_waterfall", "PULocationID:i hour:t prediction:d feature:s value:d")
def _(t):
    rows = split_rows(t)
    fitted = SPLIT_SPEC.fit(rows)
    return waterfall(tree_contributions(fitted.predict(rows), fitted), SPLIT_SPEC.features, "prediction", ["PULocationID", "hour"])


@query(
    "m14_selector_predictions", "PULocationID:i hour:t best_model:s prediction:d", "candidates",
    f"""with {_LONG},
        w as (select PULocationID, m from (
            select l.PULocationID, l.m, l.o, round(sqrt(avg(pow(y - a - b * x, 2))), 9) as score
            from l join ({_FIT.format('where r > 28')}) using (PULocationID, m) where r <= 28 group by all)
            qualify row_number() over (partition by PULocationID order by score, o) = 1)
    select l.PULocationID, hour, m as best_model, a + b * x as prediction
    from l join w using (PULocationID, m) join ({_FIT.format('')}) using (PULocationID, m)
    where hour > (select max(hour) - interval 24 hour from f)""",
)
def _(t):
    selected = SeriesSelector(linear_candidates(SELECTION_FEATURES), 28, config=CONFIG).fit(t.candidates)
    return selected.predict(last_horizon(t.candidates, "hour", 24))


@query(
    "s14_stored_linear_model", PREDICTION, "candidates",
    f"""with {_LONG} select PULocationID, hour, a + b * x as prediction
        from l join ({_FIT.format('')}) using (PULocationID, m) where m = 'day' and r <= 24""",
)
def _(t):
    path = scratch(t, "model")
    save_model(LinearPerSeries(("naive_24",)).fit(t.candidates), path, t.spark)
    return load_model(t.spark, path, "linear", CONFIG).predict(tail(t.candidates, 24, ["PULocationID"], "hour"))


@query(
    "s14_stored_selector", "PULocationID:i hour:t best_model:s prediction:d", "candidates",
    """with f as (select *, row_number() over (partition by PULocationID order by hour desc) as r, count(*) over (partition by PULocationID) as n from candidates),
        s as (select PULocationID, sqrt(avg(pow(pickup_count - naive_24, 2))) as day, sqrt(avg(pow(pickup_count - mean_24, 2))) as mean
            from f where r <= 28 and n > 28 group by 1)
    select PULocationID, hour, case when round(day, 9) <= round(mean, 9) then 'day' else 'mean' end as best_model,
        case when round(day, 9) <= round(mean, 9) then naive_24 else mean_24 end as prediction
    from f join s using (PULocationID) where r <= 24""",
)
def _(t):
    path = scratch(t, "model")
    columns = {"day": ColumnForecast("naive_24"), "mean": ColumnForecast("mean_24")}
    save_model(SeriesSelector(columns, 28, config=CONFIG, strict=True).fit(t.candidates), path, t.spark)
    return load_model(t.spark, path, "selector", CONFIG).predict(tail(t.candidates, 24, ["PULocationID"], "hour"))


@query("s14_saved_model", PREDICTION)
def _(t):
    train, test = split(lean(t))
    path = scratch(t, "model")
    TreeForecaster(FEATURES, **SMALL).fit(train).save(path, t.spark)
    return load_trees(t.spark, path).predict(test)


@query("s15_run_table", "run:s model:s name:s value:d")
def _(t):
    path = scratch(t, "runs")
    for row in evaluate(t.predictions, "actual", "predicted", by=["model"]).collect():  # one row per model
        log_run(t.spark, path, "first", row["model"], {"season": 24}, {m: row[m] for m in ("rmse", "mae", "smape")})
    return run_metrics(t.spark, path)
