"""Metrics, back-tests, selection and time-series diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalog.base import CONFIG, query
from tidegrid.functions import metrics
from tidegrid.functions.text import feature_family
from tidegrid.models import ensemble
from tidegrid.models.backtest import fold_metrics, ranked_models
from tidegrid.models.explain import contributions, dependence, mean_attribution, waterfall
from tidegrid.models.linear import apply_groups, fit_groups, moment_table
from tidegrid.models.naive import CANDIDATES, seasonal_naive
from tidegrid.operators import diagnostics, explore, splits
from tidegrid.operators.ordered import cumulative_share
from tidegrid.operators.ranking import best_by, top
from tidegrid.operators.timetravel import as_of
from tidegrid.session import stored

METRIC_SPEC = "rmse:d mae:d smape:d"
METRIC_SQL = """sqrt(avg((actual - predicted) * (actual - predicted))) as rmse, avg(abs(actual - predicted)) as mae,
    100 * avg(case when abs(actual) + abs(predicted) = 0 then 0e0
        else 2 * abs(actual - predicted) / (abs(actual) + abs(predicted)) end) as smape"""
CUT = "2024-01-24 00:00:00"


@query("e1_e3_metrics_by_model", f"model:s {METRIC_SPEC}", "predictions", f"select model, {METRIC_SQL} from predictions group by 1")
def _(t):
    return metrics.evaluate(t.predictions, "actual", "predicted", by=["model"])


@query(
    "e7_metrics_by_region", "Borough:s rmse:d mae:d", "forecast",
    """select Borough, sqrt(avg(residual * residual)) as rmse, avg(abs(residual)) as mae from forecast group by 1""",
)
def _(t):
    return metrics.evaluate(t.forecast, "actual", "predicted", ["rmse", "mae"], ["Borough"])


MASE = f"""sc as (select PULocationID, avg(abs(pickup_count - b)) as scale from (
        select *, lag(pickup_count, 24) over (partition by PULocationID order by hour) as b from dense
        where hour <= timestamp '{CUT}') group by 1),
    er as (select PULocationID, avg(abs(residual)) as mae from forecast where hour > timestamp '{CUT}' group by 1),
    ms as (select e.PULocationID, e.mae, s.scale,
        case when s.scale = 0 then cast('infinity' as double) else e.mae / s.scale end as mase
        from er e join sc s on s.PULocationID = e.PULocationID)"""


@query(
    "e4_mase_by_zone", "PULocationID:i mae:d scale:d mase:d", "forecast dense", f"with {MASE} select * from ms"
)
def _(t):
    train = as_of(t.dense, "hour", CUT).withColumn("actual", F.col("pickup_count"))
    test = t.forecast.filter(F.col("hour") > F.lit(CUT).cast("timestamp"))
    return metrics.mase(test, train, "actual", "predicted", block_hours=CONFIG.block_hours)


def series_weights(t):
    """Share of demand and mean squared daily difference of each zone before the cut."""
    naive = seasonal_naive(as_of(t.dense, "hour", CUT), 24, CONFIG)
    error = F.col("pickup_count") - F.col("prediction")
    total = as_of(t.dense, "hour", CUT).agg(F.sum("pickup_count")).scalar()
    return naive.groupBy("PULocationID").agg(
        (F.sum("pickup_count") / total).alias("weight"), F.avg(error * error).alias("scale")
    )


WEIGHTS = f"""wt as (select PULocationID, sum(pickup_count) * 1e0 / any_value(total) as weight,
        avg((pickup_count - b) * (pickup_count - b)) as scale from (
            select *, lag(pickup_count, 24) over (partition by PULocationID order by hour) as b,
                sum(pickup_count) over () as total from dense where hour <= timestamp '{CUT}') group by 1),
    mse as (select PULocationID, avg(residual * residual) as mse from forecast where hour > timestamp '{CUT}' group by 1),
    wr as (select sum(weight * sqrt(mse / case when scale = 0 then 1 else scale end)) as wrmsse
        from mse join wt on wt.PULocationID = mse.PULocationID)"""


@query("e5_wrmsse", "wrmsse:d", "forecast dense", f"with {WEIGHTS} select * from wr")
def _(t):
    test = t.forecast.filter(F.col("hour") > F.lit(CUT).cast("timestamp"))
    return metrics.wrmsse(test, series_weights(t), "actual", "predicted")


@query(
    "e6_all_metrics", f"{METRIC_SPEC} mase:d wrmsse:d", "forecast dense",
    f"""with {MASE}, {WEIGHTS} select {METRIC_SQL}, (select avg(mase) from ms) as mase,
        (select wrmsse from wr) as wrmsse from forecast where hour > timestamp '{CUT}'""",
)
def _(t):
    test = t.forecast.filter(F.col("hour") > F.lit(CUT).cast("timestamp"))
    train = as_of(t.dense, "hour", CUT).withColumn("actual", F.col("pickup_count"))
    return metrics.compute_all_metrics(test, "actual", "predicted", train, series_weights(t))


FOLD_METRICS = f"""folds as (select unnest(range(1, 6)) as fold),
    mx as (select max(hour) as m from forecast),
    fr as (select fold, f.* from forecast f, folds, mx where date_diff('hour', hour, m) // 24 = 5 - fold),
    pf as (select cast(fold as varchar) as fold, {METRIC_SQL} from fr group by 1)"""


@query(
    "e8_fold_metrics", f"fold:s {METRIC_SPEC}", "forecast",
    f"""with {FOLD_METRICS} select * from pf
    union all select 'mean', avg(rmse), avg(mae), avg(smape) from pf""",
)
def _(t):
    folds = splits.date_folds(t.forecast, "hour", 5, 24)
    rows = splits.fold_rows(t.forecast, folds, "hour").filter("role = 'test'")
    return fold_metrics(rows).withColumn("fold", F.coalesce(F.col("fold").cast("string"), F.lit("mean")))


@query(
    "k7_best_model", "model:s rmse:d", "predictions",
    """select model, sqrt(avg((actual - predicted) * (actual - predicted))) as rmse from predictions
    group by 1 order by rmse, model limit 1""",
)
def _(t):
    return best_by(metrics.evaluate(t.predictions, "actual", "predicted", ["rmse"], ["model"]), "model", "rmse")


@query("k9_ranked_models", f"model:s {METRIC_SPEC}", "predictions", f"select model, {METRIC_SQL} from predictions group by 1")
def _(t):
    return ranked_models(t.predictions)


@query(
    "e18_models_of_zones", f"PULocationID:i model:s {METRIC_SPEC}", "predictions",
    f"""select PULocationID, model, {METRIC_SQL} from predictions
    where hour > (select max(hour) - interval 24 hour from predictions) group by 1, 2""",
)
def _(t):
    rows = t.last_predictions(24)
    return metrics.evaluate(rows, "actual", "predicted", by=["PULocationID", "model"])


@query(
    "e20_best_model_summary", "model:s rmse:d mae:d n_models:i", "predictions",
    """with m as (select model, sqrt(avg((actual - predicted) * (actual - predicted))) as rmse,
        avg(abs(actual - predicted)) as mae from predictions group by 1)
    select model, rmse, mae, (select count(*) from m) as n_models from m order by rmse, model limit 1""",
)
def _(t):
    table = metrics.evaluate(t.predictions, "actual", "predicted", ["rmse", "mae"], ["model"])
    return top(table, "rmse", 1, ["model"], largest=False).withColumn("n_models", table.agg(F.count(F.lit(1))).scalar())


@query(
    "m16_seasonal_naive", "PULocationID:i hour:t prediction:d", "dense",
    """select PULocationID, hour, lag(pickup_count, 168) over (partition by PULocationID order by hour) as prediction
    from dense""",
)
def _(t):
    return seasonal_naive(t.dense, 168, CONFIG)


# --- selection and ensembles ----------------------------------------------

SELECTION = """held as (select * from (
        select *, row_number() over (partition by PULocationID, model order by hour desc) as r from predictions)
        where r <= 72),
    sc as (select PULocationID, model, round(sqrt(avg((actual - predicted) * (actual - predicted))), 9) as score,
        case model when 'naive_24' then 1 when 'naive_168' then 2 else 3 end as o from held group by 1, 2),
    best as (select PULocationID, model as best_model, score as best_score from (
        select *, row_number() over (partition by PULocationID order by score, o) as r from sc) where r = 1)"""


def scores(t):
    """Scores rounded so that equal models tie in both engines."""
    table = ensemble.selection_scores(ensemble.held_out_rows(t.predictions, 72, CONFIG), CANDIDATES, config=CONFIG)
    return table.withColumn("score", F.round("score", 9))


@query("m14_best_model_per_zone", "PULocationID:i best_model:s best_score:d", "predictions", f"with {SELECTION} select * from best")
def _(t):
    return ensemble.select_models(scores(t), CONFIG)


@query(
    "m15_selection_summary",
    "PULocationID:i best_model:s best_score:d " + " ".join(f"{m}_score:d" for m in CANDIDATES), "predictions",
    f"""with {SELECTION} select b.*, {", ".join(f"max(s.score) filter (s.model = '{m}') as {m}_score" for m in CANDIDATES)}
    from best b join sc s on s.PULocationID = b.PULocationID group by all""",
)
def _(t):
    return ensemble.selection_summary(scores(t), CANDIDATES, CONFIG)


@query(
    "a28_winner_counts", "best_model:s n:i", "predictions",
    f"with {SELECTION} select best_model, count(*) as n from best group by 1",
)
def _(t):
    return ensemble.winner_counts(ensemble.select_models(scores(t), CONFIG))


@query(
    "j8_routed_predictions", "PULocationID:i hour:t model:s predicted:d", "predictions dense",
    f"""with {SELECTION}, chosen as (select p.* from predictions p
        join best b on b.PULocationID = p.PULocationID and b.best_model = p.model)
    select d.PULocationID, d.hour, c.model, c.predicted from dense d
    left join chosen c on c.PULocationID = d.PULocationID and c.hour = d.hour""",
)
def _(t):
    winners = ensemble.select_models(scores(t), CONFIG)
    return ensemble.route(t.predictions, winners, t.dense.select("PULocationID", "hour"), CONFIG)


@query(
    "j9_unseen_series", "PULocationID:i", "trips",
    """select distinct c_custkey as PULocationID from customer
    where c_custkey not in (select PULocationID from trips)""",
)
def _(t):
    seen = t.trips.select("PULocationID").distinct()
    return ensemble.unseen_series(t.zones.select(F.col("LocationID").alias("PULocationID")), seen)


@query(
    "m10_pair_weights", "naive_24:d mean_24:d", "candidates",
    """select w as naive_24, 1 - w as mean_24 from (select least(greatest(
        sum((pickup_count - mean_24) * (naive_24 - mean_24)) / sum((naive_24 - mean_24) * (naive_24 - mean_24)), 0), 1) as w
        from candidates)""",
)
def _(t):
    wide = t.candidates.withColumn("actual", F.col("pickup_count").cast("double"))
    return ensemble.pair_weight(wide, "naive_24", "mean_24")


@query(
    "m10_cross_products", "n:i " + " ".join(f"m{i:02d}:d4" for i in range(14)), "candidates",
    "select count(*) as n, " + ", ".join(
        f"sum({expr}) as m{i:02d}" for i, expr in enumerate(
            [*CANDIDATES, "pickup_count"]
            + [f"{a} * {b}" for k, a in enumerate([*CANDIDATES, "pickup_count"]) for b in [*CANDIDATES, "pickup_count"][k:]]
        )
    ) + " from candidates",
)
def _(t):
    row = moment_table(t.candidates, list(CANDIDATES), "pickup_count")
    return row.select("n", *[F.col("m")[i].alias(f"m{i:02d}") for i in range(14)])


@query("m11_ensemble_weights", "model:s weight:d")
def _(t):
    wide = t.candidates.withColumn("actual", F.col("pickup_count").cast("double"))
    return ensemble.ensemble_weights(wide, CANDIDATES)


def stored_candidates(t):
    """Written once: the bounds of the split and every pass of the meta-learner would make the windows again."""
    narrow = t.candidates.select("PULocationID", "hour", F.col("pickup_count").cast("double").alias("actual"), *CANDIDATES)
    return stored(narrow, "candidates")


@query("m12_stacked_predictions", "PULocationID:i hour:t prediction:d")
def _(t):
    wide = stored_candidates(t)
    train, test = splits.split_last_hours(wide, "hour", 168)
    return ensemble.fit_stack(train, CANDIDATES).predict(test)


@query("m13_meta_weights", "model:s weight:d")
def _(t):
    return ensemble.fit_stack(stored_candidates(t), CANDIDATES).weights(t.spark)


# --- least squares ---------------------------------------------------------

@query(
    "linear_fit_per_zone", "PULocationID:i n:i intercept:d slope:d", "candidates",
    """select PULocationID, count(*) as n, regr_intercept(pickup_count, mean_24) as intercept,
        regr_slope(pickup_count, mean_24) as slope from candidates group by 1""",
)
def _(t):
    fitted = fit_groups(t.candidates, ["mean_24"], "pickup_count", ["PULocationID"])
    return fitted.select("PULocationID", "n", F.col("coef")[0].alias("intercept"), F.col("coef")[1].alias("slope"))


@query(
    "linear_predictions_per_zone", "PULocationID:i hour:t prediction:d", "candidates",
    """with c as (select PULocationID, regr_intercept(pickup_count, mean_24) as a,
        regr_slope(pickup_count, mean_24) as b from candidates group by 1)
    select p.PULocationID, hour, a + b * mean_24 as prediction from candidates p
    join c on c.PULocationID = p.PULocationID""",
)
def _(t):
    fitted = fit_groups(t.candidates, ["mean_24"], "pickup_count", ["PULocationID"])
    return apply_groups(t.candidates, fitted, ["mean_24"], ["PULocationID"])


# --- diagnostics -----------------------------------------------------------

ACF = """st as (select PULocationID, avg(pickup_count) as m, count(*) as n from dense group by 1),
    dv as (select d.PULocationID, date_diff('hour', timestamp '2024-01-01', hour) as i, pickup_count - m as x, n
        from dense d join st on st.PULocationID = d.PULocationID),
    c0 as (select PULocationID, sum(x * x) as c0 from dv group by 1),
    ac as (select a.PULocationID, a.lag, any_value(a.n) as n, sum(a.x * b.x) as c
        from (select PULocationID, n, x, i, unnest(range(0, {lags} + 1)) as lag from dv) a
        join dv b on b.PULocationID = a.PULocationID and b.i = a.i - a.lag group by 1, 2),
    acf as (select ac.PULocationID, lag, c / c0 as acf, 1.96e0 / sqrt(n) as bound
        from ac join c0 on c0.PULocationID = ac.PULocationID)"""


@query("e11_acf", "PULocationID:i lag:i acf:d bound:d", "dense", f"with {ACF.format(lags=72)} select * from acf")
def _(t):
    return diagnostics.acf(t.dense, "pickup_count", 72, CONFIG)


@query(
    "e12_pacf", "PULocationID:i lag:i pacf:d", "dense",
    f"""with {ACF.format(lags=2)}, r as (select PULocationID, max(acf) filter (lag = 1) as r1,
        max(acf) filter (lag = 2) as r2 from acf group by 1)
    select PULocationID, 0 as lag, 1e0 as pacf from r union all select PULocationID, 1, r1 from r
    union all select PULocationID, 2, (r2 - r1 * r1) / (1 - r1 * r1) from r""",
)
def _(t):
    return diagnostics.pacf(diagnostics.acf(t.dense, "pickup_count", 2, CONFIG), CONFIG)


@query("e12_pacf_72", "PULocationID:i lag:i pacf:d bound:d")
def _(t):
    return diagnostics.pacf(diagnostics.acf(t.dense, "pickup_count", 72, CONFIG), CONFIG)


@query(
    "e13_unit_root_no_lags", "PULocationID:i statistic:d n_obs:i", "dense",
    """with s as (select PULocationID, lag(pickup_count) over w as x, pickup_count - lag(pickup_count) over w as y
            from dense window w as (partition by PULocationID order by hour)),
        r as (select PULocationID, count(*) as n, regr_slope(y, x) as b, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy
            from s where x is not null group by 1)
    select PULocationID, b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) as statistic, n as n_obs from r""",
)
def _(t):
    return diagnostics.adf(t.dense, "pickup_count", max_lag=0, config=CONFIG)


@query("e13_unit_root", "PULocationID:i statistic:d p_value:d lags:i n_obs:i critical_5pct:d is_stationary:s")
def _(t):
    return diagnostics.adf(t.dense, "pickup_count", config=CONFIG)


DECOMPOSED = """tr as (select PULocationID, hour, pickup_count as y, case when count(*) over f = 25 then
        (avg(pickup_count) over (w rows between 12 preceding and 11 following)
         + avg(pickup_count) over (w rows between 11 preceding and 12 following)) / 2 end as trend
        from dense window w as (partition by PULocationID order by hour),
            f as (partition by PULocationID order by hour rows between 12 preceding and 12 following)),
    ph as (select PULocationID, hour(hour) as phase, {centre}(y - trend) as p from tr group by 1, 2),
    lv as (select PULocationID, avg(p) as l from ph group by 1),
    parts as (select tr.PULocationID, tr.hour, y, trend, p - l as seasonal, y - trend - (p - l) as residual
        from tr join ph on ph.PULocationID = tr.PULocationID and ph.phase = hour(tr.hour)
        join lv on lv.PULocationID = tr.PULocationID)"""


# Values have small denominators: nine digits hold them apart, six would end on ties.
@query(
    "e9_decomposition", "PULocationID:i hour:t trend:d9 seasonal:d9 residual:d9", "dense",
    f"with {DECOMPOSED.format(centre='avg')} select * from parts",
)
def _(t):
    return diagnostics.decompose(t.dense, "pickup_count", 24, config=CONFIG)


@query(
    "e9_robust_decomposition", "PULocationID:i hour:t trend:d9 seasonal:d9 residual:d9", "dense",
    f"with {DECOMPOSED.format(centre='median')} select * from parts",
)
def _(t):
    return diagnostics.decompose(t.dense, "pickup_count", 24, robust=True, config=CONFIG)


@query(
    "e10_variance_shares", "PULocationID:i trend_share:d seasonal_share:d residual_share:d", "dense",
    f"""with {DECOMPOSED.format(centre='avg')} select PULocationID, var_samp(trend) / var_samp(y) * 100 as trend_share,
        var_samp(seasonal) / var_samp(y) * 100 as seasonal_share,
        var_samp(residual) / var_samp(y) * 100 as residual_share from parts group by 1""",
)
def _(t):
    parts = diagnostics.decompose(t.dense, "pickup_count", 24, config=CONFIG)
    return diagnostics.variance_shares(parts, "pickup_count", ["PULocationID"])


# --- explanation -----------------------------------------------------------

# Weights of a made linear model over the candidates.
WEIGHT = {"naive_24": 0.2, "naive_168": 0.1, "mean_24": 0.7}
ATTRIBUTED = "attributed as (select *, " + ", ".join(
    f"{w}e0 * ({f} - (select avg({f}) from candidates)) as attr_{f}" for f, w in WEIGHT.items()
) + ", 0.2e0 * naive_24 + 0.1e0 * naive_168 + 0.7e0 * mean_24 as p from candidates)"


def attributed(t):
    value = sum((F.lit(w) * F.col(f) for f, w in WEIGHT.items()), F.lit(0.0))
    return contributions(t.candidates.withColumn("p", value), WEIGHT)


IMPORTANCE = " union all ".join(
    f"select '{f}' as feature, avg(abs(attr_{f})) as importance from attributed" for f in WEIGHT
)


@query("e14_mean_attribution", "feature:s importance:d", "candidates", f"with {ATTRIBUTED} {IMPORTANCE}")
def _(t):
    return mean_attribution(attributed(t), list(WEIGHT))


@query(
    "k6_top_features", "feature:s importance:d", "candidates",
    f"with {ATTRIBUTED}, i as ({IMPORTANCE}) select * from i order by importance desc, feature limit 2",
)
def _(t):
    return top(mean_attribution(attributed(t), list(WEIGHT)), "importance", 2, ["feature"])


@query(
    "e15_waterfall", "PULocationID:i hour:t p:d feature:s value:d", "candidates",
    f"""with {ATTRIBUTED}, b as (select * from attributed order by round(p, 9) desc, PULocationID, hour limit 1)
    {" union all ".join(f"select PULocationID, hour, p, '{f}' as feature, attr_{f} as value from b" for f in WEIGHT)}""",
)
def _(t):
    rows = attributed(t).withColumn("p", F.round("p", 9))
    return waterfall(rows, list(WEIGHT), "p", ["PULocationID", "hour"])


@query(
    "e16_dependence", "bin:i second_bin:i mean_outcome:d mean_value:d n:i", "candidates",
    f"""with {ATTRIBUTED} select
        (mean_24 > 0.06)::int + (mean_24 > 0.11)::int + (mean_24 > 0.15)::int as bin,
        (naive_24 > 0.5)::int as second_bin, avg(attr_mean_24) as mean_outcome, avg(mean_24) as mean_value,
        count(*) as n from attributed group by 1, 2""",
)
def _(t):
    return dependence(attributed(t), "mean_24", "attr_mean_24", [0.06, 0.11, 0.15], "naive_24", [0.5])


@query(
    "f17_feature_families", "feature:s family:s", "candidates",
    f"""with {ATTRIBUTED}, i as ({IMPORTANCE}) select feature, case when feature like '%mean%'
        then 'Rolling Statistics' else 'Other' end as family from i""",
)
def _(t):
    return mean_attribution(attributed(t), list(WEIGHT)).withColumn("family", feature_family("feature"))


@query(
    "e17_family_shares", "family:s importance:d pct:d", "candidates",
    f"""with {ATTRIBUTED}, i as ({IMPORTANCE}) select case when feature like '%mean%'
        then 'Rolling Statistics' else 'Other' end as family, sum(importance) as importance,
        sum(importance) / (select sum(importance) from i) * 100 as pct from i group by 1""",
)
def _(t):
    table = mean_attribution(attributed(t), list(WEIGHT))
    return explore.family_shares(table, feature_family("feature"), "importance")


@query(
    "e17_cumulative_importance", "feature:s importance:d cum_share:d", "candidates",
    f"""with {ATTRIBUTED}, i as ({IMPORTANCE}) select feature, importance,
        sum(importance) over (order by importance desc) / sum(importance) over () as cum_share from i""",
)
def _(t):
    return cumulative_share(mean_attribution(attributed(t), list(WEIGHT)), "importance", ["feature"])
