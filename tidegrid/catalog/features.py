"""Window functions and the full feature build."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalog.base import CONFIG, query
from tidegrid.catalog.panel import CALENDAR, FOURIER_SPEC, FOURIER_SQL, WEATHER, WEATHER_SQL, calendar_sql
from tidegrid.operators import series, splits
from tidegrid.operators.operations import city_totals
from tidegrid.operators.timetravel import as_of, features_between, time_range, trailing_hours
from tidegrid.plans.features import build_features

KEY = ["PULocationID"]
LAGS = " ".join(f"lag_{n}h:d" for n in CONFIG.lags)
LAGS_SQL = ", ".join(f"lag(pickup_count, {n}) over w as lag_{n}h" for n in CONFIG.lags)
ROLLING = " ".join(f"rolling_{s}_{n}h:d" for n in CONFIG.windows for s in CONFIG.stats)
_SQL_STAT = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
ROLLING_SQL = ", ".join(
    f"{_SQL_STAT[s]}(pickup_count) over (w rows between {n} preceding and 1 preceding) as rolling_{s}_{n}h"
    for n in CONFIG.windows for s in CONFIG.stats
)
BY_ZONE = "window w as (partition by PULocationID order by hour)"


@query("w1_lag_features", f"PULocationID:i hour:t {LAGS}", "dense", f"select PULocationID, hour, {LAGS_SQL} from dense {BY_ZONE}")
def _(t):
    return series.add_lag_features(t.dense, "pickup_count", CONFIG.lags, CONFIG, dense=True)


@query(
    "w2_rolling_features", f"PULocationID:i hour:t {ROLLING}", "dense",
    f"select PULocationID, hour, {ROLLING_SQL} from dense {BY_ZONE}",
)
def _(t):
    return series.add_rolling_features(t.dense, "pickup_count", CONFIG.windows, CONFIG.stats, CONFIG, dense=True)


@query(
    "w2_rolling_min_periods", "PULocationID:i hour:t rolling_mean_24h:d", "counts",
    """select PULocationID, hour, case when count(pickup_count) over f >= 12 then avg(pickup_count) over f end
        as rolling_mean_24h
    from counts window f as (partition by PULocationID order by hour rows between 24 preceding and 1 preceding)""",
)
def _(t):
    return series.add_rolling_features(t.counts, "pickup_count", [24], ["mean"], CONFIG, min_periods=12)


@query(
    "w3_trailing_rain", "hour:t rain:d", "weather",
    """select hour, sum(precipitation) over (order by hour rows between 2 preceding and current row) as rain
    from weather""",
)
def _(t):
    from tidegrid.functions.weather import derive_weather_features

    return derive_weather_features(t.weather).withColumnRenamed("rolling_precip_3h", "rain")


@query(
    "w4_city_rolling_mean", "hour:t total:i mean_24:d", "dense",
    """with c as (select hour, sum(pickup_count) as total from dense group by 1)
    select hour, total, avg(total) over (order by hour rows between 23 preceding and current row) as mean_24 from c""",
)
def _(t):
    return series.trailing_mean(city_totals(t.dense), "total", 24, "mean_24", [], "hour")


@query(
    "w5_moving_average_crossover", "PULocationID:i hour:t ma_short:d ma_long:d signal:i", "dense",
    """with m as (select PULocationID, hour,
            avg(pickup_count) over (w rows between 23 preceding and current row) as ma_short,
            avg(pickup_count) over (w rows between 167 preceding and current row) as ma_long,
            avg(pickup_count) over (w rows between 24 preceding and 1 preceding) as s0,
            avg(pickup_count) over (w rows between 168 preceding and 1 preceding) as l0
        from dense window w as (partition by PULocationID order by hour))
    select PULocationID, hour, ma_short, ma_long, case when ma_short > ma_long and s0 <= l0 then 1
        when ma_short < ma_long and s0 >= l0 then -1 else 0 end as signal from m""",
)
def _(t):
    return series.moving_average_crossover(t.dense, "pickup_count", config=CONFIG)


@query(
    "w6_strict_rolling_mean", "series_id:i d:D mean_28:d", "daily_sales",
    """select series_id, d, case when count(*) over f >= 28 then avg(sales) over f end as mean_28 from daily_sales
    window f as (partition by series_id order by d rows between 27 preceding and current row)""",
)
def _(t):
    return series.trailing_mean(t.daily_sales, "sales", 28, "mean_28", ["series_id"], "d", strict=True)


@query(
    "w7_last_rows_per_zone", "PULocationID:i hour:t pickup_count:i", "counts",
    """select PULocationID, hour, pickup_count from (
        select *, row_number() over (partition by PULocationID order by hour desc) as r from counts) where r <= 24""",
)
def _(t):
    return series.tail(t.counts, 24, KEY, "hour")


@query(
    "w8_all_but_last_rows", "PULocationID:i hour:t pickup_count:i", "counts",
    """select PULocationID, hour, pickup_count from (
        select *, row_number() over (partition by PULocationID order by hour desc) as r from counts) where r > 24""",
)
def _(t):
    return series.drop_tail(t.counts, 24, KEY, "hour")


@query(
    "w9_first_row_per_zone", "PULocationID:i hour:t pickup_count:i", "counts",
    """select PULocationID, hour, pickup_count from (
        select *, row_number() over (partition by PULocationID order by hour) as r from counts) where r = 1""",
)
def _(t):
    return series.head(t.counts, 1, KEY, "hour")


@query(
    "w10_step_between_rows", "PULocationID:i hour:t step_hours:d", "counts",
    """select PULocationID, hour, date_diff('hour', lag(hour) over (partition by PULocationID order by hour), hour)
        as step_hours from counts""",
)
def _(t):
    return series.step_between(t.counts, KEY, "hour")


@query(
    "w12_input_sequences", "PULocationID:i hour:t n:i first:d last:d total:d next_value:d", "dense",
    """select * from (select PULocationID, hour, count(*) over f as n, first_value(pickup_count) over f as first,
            last_value(pickup_count) over f as last, sum(pickup_count) over f as total, pickup_count as next_value
        from dense window f as (partition by PULocationID order by hour rows between 24 preceding and 1 preceding))
    where n = 24""",
)
def _(t):
    made = series.sequences(t.dense, ["pickup_count"], "pickup_count", 24, CONFIG)
    values = F.transform("window", lambda s: s["pickup_count"])
    return made.select(
        "PULocationID", "hour", F.size("window").alias("n"), values[0].alias("first"), values[23].alias("last"),
        F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("total"), "next_value",
    )


@query(
    "w13_time_index", "PULocationID:i hour:t time_idx:i", "counts",
    """select PULocationID, hour, date_diff('hour', min(hour) over (partition by PULocationID), hour) as time_idx
    from counts""",
)
def _(t):
    return series.time_index(t.counts, KEY, "hour")


@query(
    "w14_standardised", "PULocationID:i hour:t scaled:d restored:d", "dense",
    """with s as (select PULocationID, avg(pickup_count) as m, stddev_pop(pickup_count) as s from dense
        where hour <= timestamp '2024-01-20' group by 1)
    select d.PULocationID, hour, (pickup_count - m) / case when s = 0 then 1 else s end as scaled,
        cast(pickup_count as double) as restored
    from dense d left join s on s.PULocationID = d.PULocationID""",
)
def _(t):
    train = as_of(t.dense, "hour", "2024-01-20 00:00:00")
    return series.unstandardise(series.standardise(t.dense, "pickup_count", KEY, fit_on=train), "scaled")


@query(
    "w15_series_folds", "PULocationID:i fold:i role:s n:i first_hour:t last_hour:t", "counts",
    """with r as (select *, row_number() over (partition by PULocationID order by hour desc) as r,
            count(*) over (partition by PULocationID) as n from counts),
        f as (select PULocationID, any_value(n) as n,
            list_filter([1, 2, 3], lambda k: k * 8 < any_value(n)) as ages from r group by 1),
        x as (select PULocationID, unnest(ages) as age, len(ages) as m from f)
    select r.PULocationID, x.m - x.age + 1 as fold,
        case when r.r > x.age * 8 then 'train' else 'validate' end as role,
        count(*) as n, min(hour) as first_hour, max(hour) as last_hour
    from r join x on x.PULocationID = r.PULocationID and r.r > (x.age - 1) * 8 group by 1, 2, 3""",
)
def _(t):
    folds = splits.series_folds(t.counts, KEY, "hour", 3, 8)
    return folds.groupBy("PULocationID", "fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour")
    )


def _date_fold_sql(first: str) -> str:
    return f"""with h as (select hour, row_number() over (order by hour) - 1 as i, count(*) over () as n
            from (select distinct hour from dense)),
        f as (select unnest(range(1, 4)) as fold),
        x as (select fold, n - 72 + (fold - 1) * 24 as s, n from f, (select any_value(n) as n from h))
    select fold, min(hour) filter (i >= {first} and i < s) as train_from, max(hour) filter (i < s) as train_to,
        min(hour) filter (i >= s) as test_from, max(hour) filter (i < s + 24) as test_to
    from x, h where h.i < s + 24 group by 1"""


@query("w16_date_folds", "fold:i train_from:t train_to:t test_from:t test_to:t", "dense", _date_fold_sql("0"))
def _(t):
    return splits.date_folds(t.dense, "hour", 3, 24)


@query(
    "w16_date_folds_sliding", "fold:i train_from:t train_to:t test_from:t test_to:t", "dense",
    _date_fold_sql("s - (x.n - 72)"),
)
def _(t):
    return splits.date_folds(t.dense, "hour", 3, 24, "sliding_window")


@query(
    "j7_rows_of_folds", "fold:i role:s n:i total:i", "dense",
    """with f as (select unnest(range(1, 4)) as fold), m as (select max(hour) as m from dense),
        x as (select fold, m - (72 - (fold - 1) * 24) * interval 1 hour as last_train from f, m)
    select fold, case when hour > last_train then 'test' else 'train' end as role, count(*) as n,
        sum(pickup_count) as total
    from dense, x where hour <= last_train + interval 24 hour group by 1, 2""",
)
def _(t):
    rows = splits.fold_rows(t.dense, splits.date_folds(t.dense, "hour", 3, 24), "hour")
    return rows.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("pickup_count").alias("total"))


@query(
    "w17_tail_hold_out", "PULocationID:i hour:t is_val:s", "counts",
    """select PULocationID, hour, case when n > 28 and r <= 28 then 'true' else 'false' end as is_val from (
        select *, row_number() over (partition by PULocationID order by hour desc) as r,
            count(*) over (partition by PULocationID) as n from counts)""",
)
def _(t):
    return splits.hold_out(t.counts, KEY, "hour", 28)


# --- time travel -----------------------------------------------------------

@query(
    "t1_as_of", "PULocationID:i hour:t pickup_count:i", "dense",
    "select * from dense where hour <= timestamp '2024-01-15 12:00:00'",
)
def _(t):
    return as_of(t.dense, "hour", "2024-01-15 12:00:00")


@query(
    "t2_trailing_hours", "PULocationID:i hour:t pickup_count:i", "dense",
    """select * from dense where hour > timestamp '2024-01-14 12:00:00'
        and hour <= timestamp '2024-01-15 12:00:00'""",
)
def _(t):
    return trailing_hours(t.dense, "hour", "2024-01-15 12:00:00", 24)


@query(
    "t3_time_range", "first:t last:t replay_start:t", "dense",
    "select min(hour) as first, max(hour) as last, min(hour) + interval 7 day as replay_start from dense",
)
def _(t):
    return time_range(t.dense, "hour")


@query(
    "t3_features_between", f"PULocationID:i hour:t {LAGS} {ROLLING}", "dense",
    f"""select * from (select PULocationID, hour, {LAGS_SQL}, {ROLLING_SQL} from dense {BY_ZONE})
    where hour between timestamp '2024-01-20' and timestamp '2024-01-21 12:00:00'""",
)
def _(t):
    return features_between(
        t.dense, "hour", "2024-01-20 00:00:00", "2024-01-21 12:00:00", 168,
        lambda rows: series.add_history_features(rows, "pickup_count", CONFIG),
    )


# --- full build ------------------------------------------------------------

HOLIDAY_2024 = """case when cast(p.hour as date) in (date '2024-01-01', date '2024-01-15') then 1 else 0 end
        as is_federal_holiday,
    case when cast(p.hour as date) = date '2024-01-01' then 1 else 0 end as is_christmas_week,
    case when cast(p.hour as date) = date '2024-01-01' then 1 else 0 end as is_nyd,
    99 as days_to_christmas"""


@query(
    "f14_build_features",
    f"PULocationID:i hour:t pickup_count:i Borough:s {LAGS} {ROLLING} {CALENDAR} {FOURIER_SPEC} zone_enc:i "
    f"borough_enc:i service_zone_enc:i is_federal_holiday:i is_christmas_week:i is_nyd:i days_to_christmas:i "
    f"{WEATHER} PULocationID_target_enc:d Borough_target_enc:d",
    "panel weather",
    f"""with h as (select *, {LAGS_SQL}, {ROLLING_SQL} from panel {BY_ZONE}),
        g as (select avg(pickup_count) as m from panel),
        z as (select PULocationID, (count(*) * avg(pickup_count) + 10e0 * any_value(m)) / (count(*) + 10e0) as e
              from panel, g group by 1),
        b as (select Borough, (count(*) * avg(pickup_count) + 10e0 * any_value(m)) / (count(*) + 10e0) as e
              from panel, g group by 1),
        k as (select *, dense_rank() over (order by PULocationID) - 1 as zone_enc,
                dense_rank() over (order by Borough) - 1 as borough_enc,
                dense_rank() over (order by service_zone) - 1 as service_zone_enc
              from (select distinct PULocationID, Borough, service_zone from panel)),
        f as ({WEATHER_SQL})
    select p.* exclude (service_zone, zone_name), {calendar_sql('p.hour')}, {FOURIER_SQL.replace(', hour)', ', p.hour)')},
        k.zone_enc, k.borough_enc, k.service_zone_enc, {HOLIDAY_2024},
        {", ".join(f"coalesce(f.{c.split(':')[0]}, 0) as {c.split(':')[0]}" for c in WEATHER.split())},
        z.e as "PULocationID_target_enc", b.e as "Borough_target_enc"
    from h p join k on k.PULocationID = p.PULocationID join z on z.PULocationID = p.PULocationID
    join b on b.Borough = p.Borough left join f on f.hour = p.hour, (select min(hour) as lo from panel)
    where p.lag_168h is not null""",
)
def _(t):
    return build_features(t.panel, t.weather, CONFIG)
