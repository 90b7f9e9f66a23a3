"""Sources, panel building, joins, set operations, scalar functions."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tidegrid.catalog.base import CONFIG, Tables, query
from tidegrid.functions import calendar as cal
from tidegrid.functions import text
from tidegrid.functions.seasonal import add_fourier_features, add_yearly_fourier
from tidegrid.functions.weather import attach_weather, derive_weather_features
from tidegrid.operators import panel as op
from tidegrid.operators import splits
from tidegrid.operators.encoding import add_label_codes, add_target_encoding, feature_columns, fill_zero, smallest_types
from tidegrid.operators.ranking import top, zone_list
from tidegrid.operators.series import tail
from tidegrid.plans.preprocess import build_panel
from tidegrid.session import shared_folder
from tidegrid.sources import sales, tables, trips as trip_files, weather as weather_files
from tidegrid.sources.zones import read_zone_lookup

PANEL = "PULocationID:i hour:t pickup_count:i Borough:s zone_name:s service_zone:s"


def scratch(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid4().hex}"


# --- sources and sinks -----------------------------------------------------

@query(
    "s1_read_trip_files", "PULocationID:i trips:i first_pickup:t", "trips",
    "select PULocationID, count(*) as trips, min(pickup_dt) as first_pickup from trips group by 1",
)
def _(t):
    path = scratch(t, "trips")
    t.trips.select(
        F.col("pickup_dt").alias("tpep_pickup_datetime"), "PULocationID", "event_type"
    ).write.parquet(f"{path}/yellow_tripdata_2024-01.parquet")
    return trip_files.read_trips(t.spark, path, "yellow").groupBy("PULocationID").agg(
        F.count(F.lit(1)).alias("trips"), F.min("pickup_dt").alias("first_pickup")
    )


@query(
    "s5_missing_months", "month:s", "",
    """select distinct strftime(m, '%Y-%m') as month from (select o_orderdate as m from orders union all select ts from events)
    where strftime(m, '%Y-%m') not in (select strftime(min(ts), '%Y-%m') from events)""",
)
def _(t):
    # Wanted: the months of orders and trips. Stored: the first month of trips.
    path, month = scratch(t, "trips"), F.date_format("m", "yyyy-MM").alias("month")
    times = t.read("orders").select(F.col("o_orderdate").cast("timestamp").alias("m")).unionByName(t.trips.select(F.col("pickup_dt").alias("m")))
    wanted = [r.month for r in times.select(month).distinct().collect()]  # one row per month of the calendar
    first = t.trips.agg(F.date_format(F.min("pickup_dt"), "yyyy-MM")).first()[0]
    t.trips.select("pickup_dt", "PULocationID").write.parquet(f"{path}/yellow_tripdata_{first}.parquet")
    return trip_files.missing_months(t.spark, path, wanted)


@query(
    "s3_zone_lookup", "LocationID:i Borough:s Zone:s service_zone:s", "zones",
    "select LocationID, Borough, zone_name as Zone, nullif(service_zone, 'MACHINERY') as service_zone from zones",
)
def _(t):
    # One segment is written as a missing value, the way the lookup file marks it.
    path = scratch(t, "lookup")
    marked = F.when(F.col("service_zone") == "MACHINERY", F.lit("N/A")).otherwise(F.col("service_zone"))
    t.zones.select("LocationID", "Borough", "Zone", marked.alias("service_zone")).write.csv(path, header=True)
    return read_zone_lookup(t.spark, path)


@query(
    "s4_absent_sources", "taxi_type:s trips:i first_pickup:t", "trips",
    """select 'green' as taxi_type, count(*) as trips, min(pickup_dt) as first_pickup from trips
    union all select 'yellow', 0, null""",
)
def _(t):
    # Only files of the type with the other time column are there; the first type is reported as absent.
    path, found = scratch(t, "trips"), []
    t.trips.select(F.col("pickup_dt").alias("lpep_pickup_datetime"), "PULocationID").write.parquet(f"{path}/green_tripdata_2024-01.parquet")
    for kind in ("green", "yellow"):
        try:
            facts = trip_files.read_trips(t.spark, path, kind).agg(F.count(F.lit(1)).alias("trips"), F.min("pickup_dt").alias("first_pickup"))
        except FileNotFoundError:
            facts = t.trips.limit(1).select(F.lit(0).alias("trips"), F.lit(None).cast("timestamp").alias("first_pickup"))
        found.append(facts.withColumn("taxi_type", F.lit(kind)))
    return found[0].unionByName(found[1])


@query(
    "s11_stored_features", "panel_month:s rows:i keys:i naive_total:d mean_total:d", "candidates",
    """select strftime(hour, '%Y-%m') as panel_month, count(*) as "rows", count(distinct PULocationID) as keys,
        sum(naive_24) as naive_total, sum(mean_24) as mean_total from candidates group by 1""",
)
def _(t):
    path = scratch(t, "features")
    tables.write_by_month(t.candidates, path, CONFIG)
    return t.spark.read.parquet(path).groupBy(F.col("panel_month").cast("string").alias("panel_month")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("PULocationID").alias("keys"),
        F.sum("naive_24").alias("naive_total"), F.sum("mean_24").alias("mean_total"),
    )


@query(
    "s16_sales_tables", "series_id:i weekday:i sales:i prices:i", "daily_sales prices",
    """select series_id, isodow(d) as weekday, sum(sales) as sales, (select count(*) from prices) as prices
    from daily_sales group by 1, 2""",
)
def _(t):
    # Wide sales with one column per weekday, its calendar, and the prices, stored and read as three tables.
    path = scratch(t, "sales")
    days = t.daily_sales.select("series_id", F.concat(F.lit("d_"), F.weekday("d") + 1).alias("day"), "sales")
    days.groupBy("series_id").pivot("day", [f"d_{i}" for i in range(1, 8)]).agg(F.sum("sales")).write.parquet(f"{path}/sales")
    t.daily_sales.select((F.weekday("d") + 1).alias("weekday")).distinct().withColumn("d", F.concat(F.lit("d_"), "weekday")).write.parquet(f"{path}/calendar")
    t.prices.write.parquet(f"{path}/prices")
    wide, calendar, prices = sales.read_sales_tables(t.spark, path)
    long = sales.wide_to_long(wide).filter("sales is not null").join(calendar, "d")
    return long.withColumn("prices", prices.agg(F.count(F.lit(1))).scalar())


@query(
    "p17_feature_list", "feature:s mean:d", "candidates",
    """select feature, avg(value) as mean from (select cast(naive_24 as double) as naive_24, cast(naive_168 as double) as naive_168, mean_24 from candidates)
    unpivot (value for feature in (naive_24, naive_168, mean_24)) group by 1""",
)
def _(t):
    names = feature_columns(t.candidates, ["pickup_count", "PULocationID"])
    means = t.candidates.agg(*[F.avg(c).alias(c) for c in names])
    return means.unpivot([], names, "feature", "mean")


@query(
    "s6_flatten_weather_payload",
    "hour:t temperature_2m:d precipitation:d snowfall:d wind_speed_10m:d relative_humidity_2m:d", "weather",
    "select * from weather",
)
def _(t):
    # One payload per day, as the weather service gives them.
    names = [*weather_files.HOURLY_VARS]
    payload = t.weather.withColumn("time", F.date_format("hour", "yyyy-MM-dd'T'HH:mm")).groupBy(
        F.to_date("hour").alias("day")
    ).agg(F.sort_array(F.collect_list(F.struct("time", *names))).alias("r"))
    arrays = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("time", *names)])
    texts = payload.select(F.to_json(F.struct(arrays.alias("hourly"))).alias("body"))
    return weather_files.parse_weather_payload(texts, "body")


@query(
    "s7_weather_between_days", "hour:t temperature_2m:d", "weather",
    "select * from weather where cast(hour as date) between date '2024-01-10' and date '2024-01-12'",
)
def _(t):
    path = scratch(t, "weather")
    weather_files.write_weather(t.weather, path)
    return weather_files.weather_between(t.spark, path, "2024-01-10", "2024-01-12")


@query("s9_stored_panel", PANEL, "panel", "select * from panel")
def _(t):
    return tables.ensure_table(t.spark, scratch(t, "panel"), lambda: t.panel)


@query(
    "s12_stored_predictions", "PULocationID:i hour:t prediction:d residual:d", "forecast",
    "select PULocationID, hour, predicted as prediction, residual from forecast",
)
def _(t):
    return tables.write_predictions(t.forecast.withColumnRenamed("predicted", "prediction"), scratch(t, "predictions"))


@query(
    "s13_csv_export", "PULocationID:i predicted_total:d4 actual_total:i", "forecast",
    """select PULocationID, sum(predicted) as predicted_total, sum(actual) as actual_total
    from forecast group by 1""",
)
def _(t):
    path = scratch(t, "export")
    totals = t.forecast.groupBy("PULocationID").agg(
        F.sum("predicted").alias("predicted_total"), F.sum("actual").alias("actual_total")
    )
    tables.export_csv(totals, path)
    return t.spark.read.csv(path, header=True, schema="PULocationID int, predicted_total double, actual_total double")


@query(
    "s17_wide_to_long", "PULocationID:i d:s sales:i", "trips",
    """with pairs as (select distinct PULocationID from trips),
        c as (select PULocationID, strftime(pickup_dt, '%Y%m%d') as n, count(*) as k from trips group by 1, 2),
        days as (select distinct n from c)
    select p.PULocationID, 'd_' || d.n as d, coalesce(c.k, 0) as sales
    from pairs p cross join days d left join c on c.PULocationID = p.PULocationID and c.n = d.n""",
)
def _(t):
    day = F.concat(F.lit("d_"), F.date_format("pickup_dt", "yyyyMMdd"))
    wide = t.trips.withColumn("day", day).groupBy("PULocationID").pivot("day").count().na.fill(0)
    return sales.wide_to_long(wide)


# --- projections and filters ----------------------------------------------

@query(
    "p1_clean_trips", "PULocationID:i pickup_dt:t event_type:s", "trips zones",
    """select * from trips where pickup_dt is not null and PULocationID is not null
        and pickup_dt between timestamp '2024-01-01' and timestamp '2024-01-31 23:59:59'
        and PULocationID in (select LocationID from zones)""",
)
def _(t):
    return op.clean_trips(t.trips, CONFIG, zones=t.zones)


@query(
    "p2_parse_times", "ok:i bad:i", "",
    """select count(*) filter (x is not null) as ok, count(*) filter (x is null) as bad
    from (select try_cast(case when event_type = 'error' then props else cast(ts as varchar) end as timestamp) as x
          from events)""",
)
def _(t):
    words = t.read("events").select(
        F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("ts").cast("string")).alias("pickup_dt")
    )
    return op.parse_time(words, "pickup_dt").agg(
        F.count_if(F.col("pickup_dt").isNotNull()).alias("ok"), F.count_if(F.col("pickup_dt").isNull()).alias("bad")
    )


@query(
    "p6_reject_report", "reason:s n:i", "trips",
    """select case when pickup_dt is null or PULocationID is null then 'missing'
            when not pickup_dt between timestamp '2024-01-01' and timestamp '2024-01-31 23:59:59' then 'outside_months'
            when not PULocationID between 1 and 100 then 'invalid_zone' else 'kept' end as reason, count(*) as n
    from trips group by 1""",
)
def _(t):
    from dataclasses import replace

    return op.reject_report(t.trips, replace(CONFIG, min_zone=1, max_zone=100))


@query(
    "p8_weather_filled", "PULocationID:i hour:t temperature_2m:d is_snowing:i wind_chill_proxy:d", "dense weather",
    """with cold as (select * from weather where temperature_2m < 0)
    select d.PULocationID, d.hour, coalesce(c.temperature_2m, 0) as temperature_2m,
        coalesce(case when c.snowfall > 0 then 1 else 0 end, 0) as is_snowing,
        coalesce(least(greatest(c.wind_speed_10m, 0), 50) / 50 *
            (1 - (least(greatest(c.temperature_2m, -20), 30) + 20) / 50), 0) as wind_chill_proxy
    from dense d left join cold c on c.hour = d.hour""",
)
def _(t):
    return attach_weather(t.dense, t.weather.filter("temperature_2m < 0"))


@query(
    "p9_fill_zero", "PULocationID:i hour:t naive_168:d", "panel",
    """select PULocationID, hour, coalesce(lag(pickup_count, 168)
        over (partition by PULocationID order by hour), 0) as naive_168 from panel""",
)
def _(t):
    from tidegrid.models.naive import candidate_columns

    return fill_zero(candidate_columns(t.dense, CONFIG), ["naive_168"])


@query(
    "p11_time_cutoff_split", "part:s n:i total:i first_hour:t last_hour:t", "dense",
    """select case when hour <= (select max(hour) - interval 168 hour from dense) then 'train' else 'test' end as part,
        count(*) as n, sum(pickup_count) as total, min(hour) as first_hour, max(hour) as last_hour
    from dense group by 1""",
)
def _(t):
    train, test = splits.split_last_hours(t.dense, "hour", 168)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pickup_count").alias("total"),
        F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"),
    )


@query(
    "p11_split_last_days", "part:s n:i first_hour:t", "dense",
    """select case when hour < (select max(hour) - interval 144 hour from dense) then 'train' else 'test' end as part,
        count(*) as n, min(hour) as first_hour from dense group by 1""",
)
def _(t):
    train, test = splits.split_last_days(t.dense, "hour", 7)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("hour").alias("first_hour"))


@query(
    "p12_last_horizon", "PULocationID:i hour:t pickup_count:i", "dense",
    "select * from dense where hour > (select max(hour) - interval 24 hour from dense)",
)
def _(t):
    return splits.last_horizon(t.dense, "hour", 24)


@query(
    "p13_time_quantile_split", "part:s n:i last_hour:t", "trips",
    """with h as (select date_trunc('hour', pickup_dt) as hour from trips),
        q as (select quantile_cont(epoch_us(hour), 0.8) as q from h)
    select case when epoch_us(hour) <= floor((select q from q)) then 'train' else 'test' end as part,
        count(*) as n, max(hour) as last_hour from h group by 1""",
)
def _(t):
    rows = t.trips.select(F.date_trunc("hour", "pickup_dt").alias("hour"))
    train, test = splits.split_at_quantile(rows, "hour", 0.8)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("hour").alias("last_hour"))


@query(
    "p14_one_zone_series", "hour:t pickup_count:i", "dense",
    "select hour, pickup_count from dense where PULocationID = 7",
)
def _(t):
    return splits.require_series(t.dense, "PULocationID", 7).orderBy("hour")


@query("p15_sampled_zones", "PULocationID:i hours:i total:i")
def _(t):
    return splits.sample_keys(t.dense, "PULocationID", 10).groupBy("PULocationID").agg(
        F.count(F.lit(1)).alias("hours"), F.sum("pickup_count").alias("total")
    )


@query("p16_sampled_rows", "PULocationID:i hour:t pickup_count:i")
def _(t):
    return splits.sample_rows(t.dense, 0.2)


@query(
    "p26_smallest_types", "column:s low:d high:d type:s", "",
    """select * from (
        select 'event_id' as "column", cast(min(event_id) as double) as low, cast(max(event_id) as double) as high,
            case when max(event_id) <= 127 then 'tinyint' when max(event_id) <= 32767 then 'smallint'
                 else 'int' end as type from events
        union all select 'user_id', min(user_id), max(user_id),
            case when max(user_id) <= 127 then 'tinyint' when max(user_id) <= 32767 then 'smallint' else 'int' end
            from events
        union all select 'value', min(value), max(value), 'float' from events)""",
)
def _(t):
    return smallest_types(t.read("events").select("event_id", "user_id", "value"))


# --- joins and sets --------------------------------------------------------

@query("j1_zone_names", PANEL, "panel", "select * from panel")
def _(t):
    return t.panel


WEATHER = (
    "temperature_2m:d precipitation:d snowfall:d wind_speed_10m:d is_raining:i is_heavy_rain:i is_snowing:i "
    "is_freezing:i rolling_precip_3h:d wind_chill_proxy:d"
)
WEATHER_SQL = """select hour, temperature_2m, precipitation, snowfall, wind_speed_10m,
    case when precipitation > 0.1e0 then 1 else 0 end as is_raining,
    case when precipitation > 5e0 then 1 else 0 end as is_heavy_rain,
    case when snowfall > 0 then 1 else 0 end as is_snowing,
    case when temperature_2m < 0 then 1 else 0 end as is_freezing,
    sum(precipitation) over (order by hour rows between 2 preceding and current row) as rolling_precip_3h,
    least(greatest(wind_speed_10m, 0e0), 50e0) / 50e0
        * (1e0 - (least(greatest(temperature_2m, -20e0), 30e0) + 20e0) / 50e0) as wind_chill_proxy
    from weather"""


@query("f12_weather_features", f"hour:t {WEATHER}", "weather", WEATHER_SQL)
def _(t):
    return derive_weather_features(t.weather)


@query(
    "j2_panel_weather", f"PULocationID:i hour:t pickup_count:i {WEATHER}", "dense weather",
    f"with f as ({WEATHER_SQL}) select d.PULocationID, d.hour, d.pickup_count, "
    + ", ".join(f"coalesce(f.{c.split(':')[0]}, 0) as {c.split(':')[0]}" for c in WEATHER.split())
    + " from dense d left join f on f.hour = d.hour",
)
def _(t):
    return attach_weather(t.dense, t.weather)


@query("j3_dense_grid", "PULocationID:i hour:t pickup_count:i", "dense", "select * from dense")
def _(t):
    return t.dense


@query(
    "j14_future_frame", "PULocationID:i step:i hour:t", "dense",
    """select PULocationID, s as step, last + s * interval 1 hour as hour
    from (select PULocationID, max(hour) as last from dense group by 1), (select unnest(range(1, 25)) as s)""",
)
def _(t):
    return op.future_frame(t.dense, 24, config=CONFIG)


@query(
    "u1_union_months", "part:s n:i", "trips",
    """select case when pickup_dt < timestamp '2024-01-16' then 'first' else 'second' end as part, count(*) as n
    from trips group by 1""",
)
def _(t):
    early = t.trips.filter("pickup_dt < timestamp'2024-01-16'").withColumn("part", F.lit("first"))
    late = t.trips.filter("pickup_dt >= timestamp'2024-01-16'").drop("value").withColumn("part", F.lit("second"))
    return early.unionByName(late, allowMissingColumns=True).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "u7_history_and_test", "PULocationID:i hour:t pickup_count:i", "dense",
    """select PULocationID, hour, pickup_count from (
        select *, row_number() over (partition by PULocationID order by hour desc) as r from dense) where r <= 72""",
)
def _(t):
    train, test = splits.split_last_hours(t.dense, "hour", 24)
    return tail(train, 48, ["PULocationID"], "hour").unionByName(test)


@query(
    "k5_zone_list", "PULocationID:i Borough:s zone_name:s", "panel",
    "select distinct PULocationID, Borough, zone_name from panel",
)
def _(t):
    return zone_list(t.panel, "PULocationID", "Borough", "zone_name")


# --- scalar functions ------------------------------------------------------

CALENDAR = (
    "hour_of_day:i day_of_week:i day_of_month:i month:i year:i quarter:i is_weekend:i is_rush_hour:i is_late_night:i"
)


def calendar_sql(c: str) -> str:
    return f"""hour({c}) as hour_of_day, isodow({c}) - 1 as day_of_week, day({c}) as day_of_month,
        month({c}) as month, year({c}) as year, quarter({c}) as quarter,
        case when isodow({c}) >= 6 then 1 else 0 end as is_weekend,
        case when (hour({c}) between 7 and 9 or hour({c}) between 17 and 19) and isodow({c}) < 6
            then 1 else 0 end as is_rush_hour,
        case when hour({c}) >= 22 or hour({c}) <= 2 then 1 else 0 end as is_late_night"""


@query(
    "f2_calendar_features", f"PULocationID:i hour:t {CALENDAR}", "dense",
    f"select PULocationID, hour, {calendar_sql('hour')} from dense",
)
def _(t):
    return cal.add_calendar_features(t.dense)


# Literal holiday dates of the years in the orders, written out to check the rules.
HOLIDAYS_SQL = """
    with y as (select unnest(range(1994, 2003)) as y),
    fixed as (
        select make_date(y, m, d) as d from y, (values (1, 1), (7, 4), (11, 11), (12, 25)) v(m, d)),
    observed as (
        select case isodow(d) when 6 then d - 1 when 7 then d + 1 end as d from fixed where isodow(d) >= 6),
    monthly as (
        select y, m, n, dow, cast(make_date(y, m, 1) as date)
            + cast((dow - isodow(make_date(y, m, 1)) + 7) % 7 as integer) + 7 * (n - 1) as d
        from y, (values (1, 3, 1), (2, 3, 1), (9, 1, 1), (10, 2, 1), (11, 4, 4)) v(m, n, dow)),
    memorial as (
        select cast(make_date(y, 5, 31) as date) - cast((isodow(make_date(y, 5, 31)) - 1) as integer) as d from y),
    hol as (select cast(d as date) as d from fixed union select cast(d as date) from observed
        union select cast(d as date) from monthly union select cast(d as date) from memorial),
    tg as (select y, cast(d as date) as d from monthly where m = 11)"""


@query(
    "f6_holiday_features",
    "o_orderkey:i is_federal_holiday:i is_christmas_week:i is_nye:i is_nyd:i is_thanksgiving_week:i "
    "is_halloween_eve:i days_to_christmas:i", "",
    HOLIDAYS_SQL
    + """, o as (select o_orderkey, cast(o_orderdate as date) as d from orders)
    select o_orderkey, case when hol.d is not null then 1 else 0 end as is_federal_holiday,
        case when (month(o.d) = 12 and day(o.d) >= 24) or (month(o.d) = 1 and day(o.d) = 1)
            then 1 else 0 end as is_christmas_week,
        case when month(o.d) = 12 and day(o.d) = 31 then 1 else 0 end as is_nye,
        case when month(o.d) = 1 and day(o.d) = 1 then 1 else 0 end as is_nyd,
        case when date_diff('day', tg.d, o.d) between -1 and 3 then 1 else 0 end as is_thanksgiving_week,
        case when month(o.d) = 10 and day(o.d) = 31 then 1 else 0 end as is_halloween_eve,
        case when abs(date_diff('day', make_date(year(o.d), 12, 25), o.d)) <= 30
            then date_diff('day', make_date(year(o.d), 12, 25), o.d) else 99 end as days_to_christmas
    from o left join hol on hol.d = o.d left join tg on tg.y = year(o.d)""",
)
def _(t):
    return cal.add_holiday_features(t.read("orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query(
    "j5_holiday_join", "o_orderkey:i is_federal_holiday:i", "",
    HOLIDAYS_SQL
    + """ select o_orderkey, case when hol.d is not null then 1 else 0 end as is_federal_holiday
    from orders left join hol on hol.d = cast(o_orderdate as date)""",
)
def _(t):
    days = cal.holiday_calendar(t.spark, 1994, 2002)
    return cal.join_holidays(t.read("orders").select("o_orderkey", "o_orderdate"), days, "o_orderdate")


FOURIER = [f"fourier_{p}_{f}_{k}" for k in (1, 2, 3) for p in ("day", "week") for f in ("sin", "cos")]
FOURIER_SPEC = " ".join(f"{c}:d" for c in FOURIER)
FOURIER_SQL = ", ".join(
    f"{f}(2 * pi() * {k} * date_diff('hour', lo, hour) / {168 if p == 'week' else 24}e0) as fourier_{p}_{f}_{k}"
    for k in (1, 2, 3) for p in ("day", "week") for f in ("sin", "cos")
)


@query(
    "f11_fourier_features", f"PULocationID:i hour:t {FOURIER_SPEC}", "dense",
    f"select PULocationID, hour, {FOURIER_SQL} from dense, (select min(hour) as lo from dense)",
)
def _(t):
    return add_fourier_features(t.dense)


@query(
    "f23_yearly_terms", "o_orderkey:i week_of_year:i fourier_year_sin_1:d fourier_year_cos_2:d", "",
    """select o_orderkey, weekofyear(o_orderdate) as week_of_year,
        sin(2 * pi() * date_diff('day', timestamp '1995-01-01', o_orderdate) / 365.25e0) as fourier_year_sin_1,
        cos(4 * pi() * date_diff('day', timestamp '1995-01-01', o_orderdate) / 365.25e0) as fourier_year_cos_2
    from orders""",
)
def _(t):
    rows = t.read("orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    return add_yearly_fourier(rows, "o_orderdate", 2, "1995-01-01 00:00:00").withColumn(
        "week_of_year", cal.week_of_year("o_orderdate")
    )


@query(
    "a20_label_codes", "PULocationID:i Borough:s zone_enc:i borough_enc:i service_zone_enc:i", "panel",
    """with k as (select distinct PULocationID, Borough, service_zone from panel)
    select PULocationID, Borough, dense_rank() over (order by PULocationID) - 1 as zone_enc,
        dense_rank() over (order by Borough) - 1 as borough_enc,
        dense_rank() over (order by service_zone) - 1 as service_zone_enc from k""",
)
def _(t):
    return add_label_codes(t.panel.select("PULocationID", "Borough", "service_zone").distinct())


@query(
    "a19_target_encoding", "PULocationID:i hour:t PULocationID_target_enc:d Borough_target_enc:d", "panel",
    """with g as (select avg(pickup_count) as m from panel),
        z as (select PULocationID, (count(*) * avg(pickup_count) + 10e0 * any_value(m)) / (count(*) + 10e0) as e
              from panel, g group by 1),
        b as (select Borough, (count(*) * avg(pickup_count) + 10e0 * any_value(m)) / (count(*) + 10e0) as e
              from panel, g group by 1)
    select p.PULocationID, p.hour, z.e as "PULocationID_target_enc", b.e as "Borough_target_enc"
    from panel p join z on z.PULocationID = p.PULocationID join b on b.Borough = p.Borough""",
)
def _(t):
    return add_target_encoding(t.panel, "pickup_count", ["PULocationID", "Borough"])


@query(
    "a19_target_encoding_until", "PULocationID:i PULocationID_target_enc:d", "dense",
    """with tr as (select * from dense where hour <= timestamp '2024-01-20'),
        g as (select avg(pickup_count) as m from tr)
    select PULocationID, (count(*) * avg(pickup_count) + 10e0 * any_value(m)) / (count(*) + 10e0)
        as "PULocationID_target_enc" from tr, g group by 1""",
)
def _(t):
    encoded = add_target_encoding(
        t.dense, "pickup_count", ["PULocationID"], time="hour", until="2024-01-20 00:00:00"
    )
    return encoded.select("PULocationID", "PULocationID_target_enc").distinct()


@query(
    "f15_zone_labels", "label:s text_hour:s iso_hour:s series:s n:i", "panel",
    """select PULocationID || ' - ' || zone_name || ' (' || Borough || ')' as label,
        strftime(hour, '%Y-%m-%d %H:00') as text_hour, strftime(hour, '%Y-%m-%dT%H:%M:%S') as iso_hour,
        Borough || '_' || service_zone as series, pickup_count as n
    from panel""",
)
def _(t):
    return t.panel.select(
        text.zone_label("PULocationID", "zone_name", "Borough").alias("label"),
        text.hour_text("hour").alias("text_hour"),
        text.iso_text("hour").alias("iso_hour"),
        text.series_id(["Borough", "service_zone"]).alias("series"),
        F.col("pickup_count").alias("n"),
    )


@query(
    "f20_interpolated_series", "PULocationID:i hour:t pickup_count:d filled:s", "counts",
    """with s as (select PULocationID, hour, pickup_count as v,
            lead(hour) over w as nh, lead(pickup_count) over w as nv
        from counts window w as (partition by PULocationID order by hour)),
    e as (select *, coalesce(date_diff('hour', hour, nh), 1) as gap from s),
    x as (select *, unnest(range(0, cast(gap as bigint))) as i from e)
    select PULocationID, hour + i * interval 1 hour as hour,
        case when i = 0 then v else v + (nv - v) * i / cast(gap as double) end as pickup_count,
        case when i > 0 then 'true' else 'false' end as filled from x""",
)
def _(t):
    return op.fill_regular(t.counts, "pickup_count", CONFIG)


@query(
    "f22_list_lines", "doc_id:i line:i item:s", "",
    r"""with l as (
        select doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as whole,
            list_transform(regexp_split_to_array(text, '\r\n|\r|\n'),
                lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) as lines from documents),
    k as (select doc_id, whole, list_filter(lines, lambda x: regexp_matches(x, '^(- |\* |>> |\d[.)].{2,})')) as kept
        from l),
    c as (select doc_id, case when len(kept) > 0 then list_transform(kept,
            lambda x: regexp_replace(regexp_replace(x, '^[-*> 0123456789.)]+', ''), '^\s+|\s+$', '', 'g'))
        else [whole] end as items from k)
    select doc_id, unnest(range(0, len(items))) as line, unnest(items) as item from c""",
)
def _(t):
    return text.list_lines(t.read("documents"), "text", ["doc_id"])


@query(
    "f1_f18_month_bounds", "PULocationID:i hour:t in_month:i", "trips",
    """select PULocationID, date_trunc('hour', pickup_dt) as hour,
        case when pickup_dt between timestamp '2024-01-01' and timestamp '2024-01-31 23:59:59'
            then 1 else 0 end as in_month from trips""",
)
def _(t):
    start, end = op.month_bounds(CONFIG.months)
    return t.trips.select(
        "PULocationID", F.date_trunc("hour", "pickup_dt").alias("hour"),
        F.col("pickup_dt").between(start, end).cast("int").alias("in_month"),
    )


@query(
    "preprocess_trips", PANEL, "trips zones",
    """with good as (select PULocationID, date_trunc('hour', pickup_dt) as hour from trips
        where pickup_dt between timestamp '2024-01-01' and timestamp '2024-01-31 23:59:59'
            and PULocationID in (select LocationID from zones)),
    c as (select PULocationID, hour, count(*) as n from good group by 1, 2),
    g as (select a.PULocationID, b.hour from (select distinct PULocationID from c) a,
        (select unnest(generate_series(min(hour), max(hour), interval 1 hour)) as hour from c) b)
    select g.PULocationID, g.hour, coalesce(c.n, 0) as pickup_count, coalesce(z.Borough, 'Unknown') as Borough,
        coalesce(z.zone_name, 'Unknown') as zone_name, coalesce(z.service_zone, 'Unknown') as service_zone
    from g left join c on c.PULocationID = g.PULocationID and c.hour = g.hour
    left join zones z on z.LocationID = g.PULocationID""",
)
def _(t):
    return build_panel(t.trips, t.zones, CONFIG)


@query(
    "top_zones_by_rolling_mean", "PULocationID:i zone_name:s Borough:s total:i best_day_mean:d", "panel",
    """with r as (select *, avg(pickup_count) over (partition by PULocationID order by hour
            rows between 24 preceding and 1 preceding) as m from panel)
    select PULocationID, zone_name, Borough, sum(pickup_count) as total, max(m) as best_day_mean
    from r group by 1, 2, 3 order by total desc, PULocationID limit 10""",
)
def flagship(t):
    """Raw trips to panel to rolling means to the ten busiest zones."""
    from tidegrid.operators.series import add_rolling_features

    rolled = add_rolling_features(t.panel, "pickup_count", [24], ["mean"], CONFIG, dense=True)
    totals = rolled.groupBy("PULocationID", "zone_name", "Borough").agg(
        F.sum("pickup_count").alias("total"), F.max("rolling_mean_24h").alias("best_day_mean")
    )
    return top(totals, "total", 10, ["PULocationID"])
