"""Data quality, drift, exploration and residual analysis."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tidegrid.catalog.base import CONFIG, query
from tidegrid.functions.metrics import add_errors
from tidegrid.operators import explore, quality
from tidegrid.operators.operations import histogram
from tidegrid.operators.ordered import cumulative_share, exact_quantiles, quantiles


def gappy(t):
    """Events with holes, zeros and copies, made from the table itself."""
    rows = t.trips.select(
        "PULocationID", F.date_trunc("hour", "pickup_dt").alias("hour"), "event_type",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_type") == "click", F.lit(0.0)).otherwise(F.col("value")).alias("spend"),
    )
    return rows.unionByName(rows.filter("event_type = 'signup'"))


GAPPY = """base as (select PULocationID, date_trunc('hour', pickup_dt) as hour, event_type,
        case when event_type <> 'error' then value end as value,
        case when event_type = 'click' then 0 else value end as spend from trips),
    gappy as (select * from base union all select * from base where event_type = 'signup')"""
NUMERIC = ("PULocationID", "value", "spend")


def per_column(parts: str, columns) -> str:
    return " union all ".join("select '{c}' as \"column\", ".format(c=c) + parts.replace("{c}", c) for c in columns)


@query(
    "a21_missing_values", "column:s missing:i pct:d", "trips",
    f"with {GAPPY} " + per_column(
        "count(*) filter ({c} is null) as missing, round(count(*) filter ({c} is null) * 100e0 / count(*), 2) as pct "
        "from gappy", ("PULocationID", "hour", "event_type", "value", "spend"),
    ),
)
def _(t):
    return quality.missing_values(gappy(t))


ZERO_SQL = per_column("round(avg(case when {c} = 0 then 1e0 else 0e0 end) * 100, 2) as zero_pct from gappy", NUMERIC)


@query("a22_zero_rates", "column:s zero_pct:d", "trips", f"with {GAPPY} {ZERO_SQL}")
def _(t):
    return quality.zero_rates(gappy(t))


@query(
    "k8_top_zero_rates", "column:s zero_pct:d", "trips",
    f"with {GAPPY}, z as ({ZERO_SQL}) select * from z order by zero_pct desc, \"column\" limit 5",
)
def _(t):
    return quality.top_entries(quality.zero_rates(gappy(t)), "zero_pct", n=5)


OUTLIER_SQL = per_column(
    """any_value(q1) as q1, any_value(q3) as q3,
    count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as outliers from gappy,
    (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from gappy where {c} is not null)""",
    NUMERIC,
)


@query("a23_iqr_outliers", "column:s q1:d q3:d outliers:i", "trips", f"with {GAPPY} {OUTLIER_SQL}")
def _(t):
    return quality.iqr_outliers(gappy(t))


COVERAGE_SQL = """steps as (select date_diff('hour', lag(hour) over (partition by PULocationID order by hour), hour) as s
        from (select distinct PULocationID, hour from gappy)),
    modal as (select s from steps where s is not null group by 1 order by count(*) desc, s limit 1)"""


@query(
    "a24_coverage", "unique_zones:i first_time:t last_time:t expected_step_hours:d gap_count:i", "trips",
    f"""with {GAPPY}, {COVERAGE_SQL}
    select count(distinct PULocationID) as unique_zones, min(hour) as first_time, max(hour) as last_time,
        (select s from modal) as expected_step_hours,
        (select count(*) from steps where s > (select s from modal)) as gap_count from gappy""",
)
def _(t):
    return quality.coverage(gappy(t), "PULocationID", "hour")


@query(
    "a25_duplicate_rows", "duplicate_rows:i", "trips",
    f"""with {GAPPY} select sum(n - 1) as duplicate_rows from (
        select count(*) as n from gappy group by PULocationID, hour, event_type, value, spend)""",
)
def _(t):
    return quality.duplicate_rows(gappy(t))


@query(
    "a26_shape", "row_count:i column_count:i datetime_columns:s numeric_columns:s", "trips",
    f"""with {GAPPY} select count(*) as row_count, 5 as column_count, 'hour' as datetime_columns,
        'PULocationID,value,spend' as numeric_columns from gappy""",
)
def _(t):
    return quality.shape(gappy(t))


@query(
    "e21_quality_report", "check:s column:s value:d", "trips",
    f"""with {GAPPY}, {COVERAGE_SQL}, o as ({OUTLIER_SQL}), z as ({ZERO_SQL}),
    m as ({per_column("count(*) filter ({c} is null) as n from gappy", ("PULocationID", "hour", "event_type", "value", "spend"))})
    select 'row_count' as "check", null as "column", count(*) as value from gappy
    union all select 'column_count', null, 5
    union all select 'missing', "column", n from m where n > 0
    union all select 'zero_pct', "column", zero_pct from z
    union all select 'outliers', "column", outliers from o
    union all select 'duplicate_rows', null, sum(n - 1) from (
        select count(*) as n from gappy group by PULocationID, hour, event_type, value, spend)
    union all select 'unique_zones', null, count(distinct PULocationID) from gappy
    union all select 'expected_step_hours', null, s from modal
    union all select 'gap_count', null, (select count(*) from steps where s > (select s from modal))""",
)
def _(t):
    return quality.quality_report(gappy(t), "PULocationID", "hour")


@query(
    "a27_drift", "column:s ks_statistic:d p_value:d n_train:i n_new:i", "trips",
    """with l as (
        select 'value' as c, value as v, pickup_dt < timestamp '2024-01-16' as a from trips
        union all select 'PULocationID', PULocationID, pickup_dt < timestamp '2024-01-16' from trips),
    g as (select c, v, count(*) filter (a) as a, count(*) filter (not a) as b from l where v is not null group by 1, 2),
    r as (select c, sum(a) over w as ca, sum(b) over w as cb, sum(a) over (partition by c) as na,
            sum(b) over (partition by c) as nb from g window w as (partition by c order by v)),
    k as (select c, max(abs(ca * 1e0 / na - cb * 1e0 / nb)) as d, any_value(na) as na, any_value(nb) as nb
        from r group by 1),
    p as (select *, na * nb * 1e0 / (na + nb) * d * d as lam2 from k)
    select c as "column", d as ks_statistic, na as n_train, nb as n_new,
        case when lam2 < 0.04 then 1e0 else least(greatest((select sum(case when k % 2 = 1 then 2e0 else -2e0 end
            * exp(-2e0 * k * k * lam2)) from (select unnest(range(1, 101)) as k)), 0e0), 1e0) end as p_value from p""",
)
def _(t):
    early = t.trips.filter("pickup_dt < timestamp'2024-01-16'")
    late = t.trips.filter("pickup_dt >= timestamp'2024-01-16'")
    return quality.drift(early, late)


# --- exploration -----------------------------------------------------------

@query(
    "a34_feature_correlations", "feature:s corr:d", "candidates",
    " union all ".join(
        f"select '{m}' as feature, corr({m}, pickup_count) as corr from candidates"
        for m in ("naive_24", "naive_168", "mean_24")
    ),
)
def _(t):
    return explore.correlations(t.candidates, ["naive_24", "naive_168", "mean_24"], "pickup_count")


@query(
    "a35_zero_share_by_zone", "PULocationID:i zero_share:d", "dense",
    "select PULocationID, avg(case when pickup_count = 0 then 1e0 else 0e0 end) as zero_share from dense group by 1",
)
def _(t):
    return explore.zero_share(t.dense, "pickup_count", ["PULocationID"])


@query(
    "a35_zero_share_by_region", "Borough:s zero_share:d", "panel",
    "select Borough, avg(case when pickup_count = 0 then 1e0 else 0e0 end) as zero_share from panel group by 1",
)
def _(t):
    return explore.zero_share(t.panel, "pickup_count", ["Borough"])


@query(
    "a36_price_variation", "item_id:i std:d4 mean:d4 cv:d", "prices",
    """select item_id, stddev_samp(sell_price) as std, avg(sell_price) as mean,
        stddev_samp(sell_price) / avg(sell_price) as cv from prices group by 1""",
)
def _(t):
    return explore.variation(t.prices, "sell_price", "item_id")


@query(
    "a36_items_that_vary", "varying:i items:i", "prices",
    """select count(*) filter (cv > 0.01) as varying, count(*) as items from (
        select stddev_samp(sell_price) / avg(sell_price) as cv from prices group by item_id)""",
)
def _(t):
    return explore.items_that_vary(explore.variation(t.prices, "sell_price", "item_id"))


DAYS = """days as (select cast(o_orderdate as date) as d, count(*) as sales,
        count(*) filter (o_orderpriority = '1-URGENT') * 5 > count(*) as event, max(o_orderpriority) as kind
    from orders group by 1)"""


def order_days(t):
    urgent = F.count_if(F.col("o_orderpriority") == "1-URGENT")
    return t.read("orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(
        F.count(F.lit(1)).alias("sales"),
        (urgent * 5 > F.count(F.lit(1))).alias("event"),
        F.max("o_orderpriority").alias("kind"),
    )


@query(
    "a37_event_lift", "with_event:d without_event:d lift_pct:d", "",
    f"""with {DAYS} select avg(sales) filter (event) as with_event, avg(sales) filter (not event) as without_event,
        (avg(sales) filter (event) / avg(sales) filter (not event) - 1) * 100 as lift_pct from days""",
)
def _(t):
    return explore.event_lift(order_days(t), "sales", "event")


@query(
    "a37_mean_by_event_type", "kind:s mean:d", "",
    f"with {DAYS} select kind, avg(sales) as mean from days where event group by 1",
)
def _(t):
    return explore.mean_by(order_days(t).filter("event"), "sales", ["kind"])


@query(
    "a38_mean_by_weekday", "position:i name:s mean:d", "",
    f"with {DAYS} select isodow(d) - 1 as position, dayname(d) as name, avg(sales) as mean from days group by 1, 2",
)
def _(t):
    return explore.by_calendar_name(order_days(t), "sales", "d", "weekday")


@query(
    "a38_mean_by_month", "position:i name:s mean:d", "",
    f"with {DAYS} select month(d) as position, monthname(d) as name, avg(sales) as mean from days group by 1, 2",
)
def _(t):
    return explore.by_calendar_name(order_days(t), "sales", "d", "month")


@query(
    "a39_totals_by_series", "series_id:i total:i", "daily_sales",
    "select series_id, sum(sales) as total from daily_sales group by 1",
)
def _(t):
    return explore.sum_by(t.daily_sales, "sales", ["series_id"])


@query(
    "a39_totals_over_time", "d:D total:i", "daily_sales", "select d, sum(sales) as total from daily_sales group by 1"
)
def _(t):
    return explore.sum_by(t.daily_sales, "sales", ["d"])


@query(
    "j13_calendar_days", "d:D total:i event:s", "daily_sales",
    f"""with {DAYS} select c.d, c.total, case when days.event then 'true' else 'false' end as event from (
        select d, sum(sales) as total from daily_sales group by 1) c join days on days.d = c.d""",
)
def _(t):
    return explore.sum_by(t.daily_sales, "sales", ["d"]).join(order_days(t).select("d", "event"), "d")


@query(
    "a40_dimension_profile",
    "rows:i n_c_nationkey:i n_c_mktsegment:i n_c_custkey:i min_c_acctbal:d max_c_acctbal:d", "",
    """select count(*) as "rows", count(distinct c_nationkey) as n_c_nationkey,
        count(distinct c_mktsegment) as n_c_mktsegment, count(distinct c_custkey) as n_c_custkey,
        min(c_acctbal) as min_c_acctbal, max(c_acctbal) as max_c_acctbal from customer""",
)
def _(t):
    return explore.profile(t.read("customer"), ["c_nationkey", "c_mktsegment", "c_custkey"], ["c_acctbal"])


@query(
    "a43_most_frequent_key", "PULocationID:i n:i", "trips",
    "select PULocationID, count(*) as n from trips group by 1 order by n desc, PULocationID limit 1",
)
def _(t):
    return explore.most_frequent(t.trips, "PULocationID")


@query(
    "a18_price_histogram", "bin:i n:i", "prices",
    """with r as (select min(sell_price) as lo, max(sell_price) as hi from prices)
    select least(cast(floor((sell_price - lo) / ((hi - lo) / 100)) as int), 99) as bin, count(*) as n
    from prices, r group by 1""",
)
def _(t):
    return histogram(t.prices, "sell_price", 100)


@query(
    "w11_cumulative_share", "PULocationID:i total:i share:d cum_share:d", "dense",
    """with z as (select PULocationID, sum(pickup_count) as total from dense group by 1)
    select PULocationID, total, total * 1e0 / sum(total) over () as share,
        sum(total) over (order by total desc, PULocationID) * 1e0 / sum(total) over () as cum_share from z""",
)
def _(t):
    totals = t.dense.groupBy("PULocationID").agg(F.sum("pickup_count").alias("total"))
    return cumulative_share(totals, "total", ["PULocationID"])


@query(
    "exact_price_quantiles", "p01:d p50:d p99:d", "",
    """select quantile_cont(l_extendedprice, 0.01) as p01, quantile_cont(l_extendedprice, 0.5) as p50,
        quantile_cont(l_extendedprice, 0.99) as p99 from lineitem""",
)
def _(t):
    return exact_quantiles(t.read("lineitem"), "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p99": 0.99})


@query("approximate_price_quantiles", "p01:d p50:d p99:d")
def _(t):
    return quantiles(t.read("lineitem"), "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p99": 0.99}, approx=True)


# --- residuals -------------------------------------------------------------

@query(
    "a29_residuals_over_time", "hour:t mean_residual:d mean_abs_error:d", "forecast",
    "select hour, avg(residual) as mean_residual, avg(abs(residual)) as mean_abs_error from forecast group by 1",
)
def _(t):
    return explore.residuals_over_time(t.forecast, "hour")


BOX_SQL = ", ".join(f"quantile_cont(residual, {p}) as {n}" for n, p in explore.BOX.items())
BOX_SPEC = " ".join(f"{n}:d" for n in explore.BOX)


@query(
    "a30_residual_spread_by_weekday", f"dow:i {BOX_SPEC}", "forecast",
    f"select isodow(hour) - 1 as dow, {BOX_SQL} from forecast group by 1",
)
def _(t):
    return explore.spread_by(t.forecast.withColumn("dow", F.weekday("hour")), "residual", ["dow"])


@query(
    "a30_residual_spread_by_category", f"service_zone:s {BOX_SPEC}", "forecast",
    f"select service_zone, {BOX_SQL} from forecast group by 1",
)
def _(t):
    return explore.spread_by(t.forecast, "residual", ["service_zone"])


@query(
    "a30_residual_spread_of_worst", f"PULocationID:i {BOX_SPEC}", "forecast",
    f"""with w as (select PULocationID from forecast group by 1
        order by round(avg(abs(residual)), 9) desc, PULocationID limit 10)
    select PULocationID, {BOX_SQL} from forecast where PULocationID in (select * from w) group by 1""",
)
def _(t):
    return explore.spread_of_worst(t.forecast, "PULocationID")


ERRORS_SQL = """errors as (select PULocationID, avg(abs(residual)) as mean_abs_error,
        quantile_cont(abs(residual), 0.5) as median_abs_error,
        avg(abs(residual) / greatest(actual, 1) * 100) as mean_pct_error, count(*) as n_obs from forecast group by 1)"""


@query(
    "a31_series_errors", "PULocationID:i mean_abs_error:d median_abs_error:d mean_pct_error:d n_obs:i", "forecast",
    f"with {ERRORS_SQL} select * from errors",
)
def _(t):
    return explore.series_errors(add_errors(t.forecast, "actual", "predicted"), ["PULocationID"])


@query(
    "a31_best_worst_median", "role:s PULocationID:i mean_abs_error:d", "forecast",
    f"""with {ERRORS_SQL}, r as (select *, row_number() over (order by mean_abs_error desc, PULocationID) as r,
        count(*) over () as n from errors)
    select case when r = 1 then 'worst' when r = n then 'best' else 'median' end as role, PULocationID,
        mean_abs_error from r where r = 1 or r = n or r - 1 = n // 2""",
)
def _(t):
    table = t.forecast.groupBy("PULocationID").agg(F.avg(F.abs("residual")).alias("mean_abs_error"))
    return explore.best_worst_median(table, "PULocationID", "mean_abs_error")


@query(
    "a32_residual_moments", "n:i mean:d std:d skewness:d kurtosis:d", "forecast",
    """select count(*) as n, avg(residual) as mean, stddev_samp(residual) as std, skewness(residual) as skewness,
        kurtosis(residual) as kurtosis from forecast""",
)
def _(t):
    return explore.residual_moments(t.forecast)


QQ = [(i + 1) / 100 for i in range(99)]


@query(
    "a33_qq_points", "p:d normal:d sample:d", "forecast",
    " union all ".join(
        f"select {p}e0 as p, {NormalDist().inv_cdf(p)!r}e0 as normal, quantile_cont(residual, {p}) as sample from forecast"
        for p in QQ
    ).replace("e-", "e-"),
)
def _(t):
    return explore.qq_points(t.forecast, "residual")
