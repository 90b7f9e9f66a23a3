"""Registry of queries with their SQL twins, and the adapters from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.config import DemandConfig
from tidegrid.models.naive import CANDIDATES, candidate_columns, long_predictions
from tidegrid.operators.panel import attach_zones, dense_grid, hourly_counts, recent_grid
from tidegrid.operators.splits import last_horizon
from tidegrid.session import pin_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The events span January 2024; every user is one place.
CONFIG = DemandConfig(months=("2024-01",))


def _named_forecast(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        "PULocationID", "Borough", "zone_name", "service_zone", "hour",
        F.col("pickup_count").cast("double").alias("actual"),
        F.col("mean_24").alias("predicted"),
        (F.col("pickup_count") - F.col("mean_24")).alias("residual"),
    )


class Tables:
    """The reference's inputs made from the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = pin_utc(spark), sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def trips(self) -> DataFrame:
        return self.read("events").select(
            F.col("ts").cast("timestamp").alias("pickup_dt"),
            F.col("user_id").cast("int").alias("PULocationID"),
            "event_type",
            "value",
        )

    @cached_property
    def zones(self) -> DataFrame:
        return (
            self.read("customer")
            .join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("c_custkey").cast("int").alias("LocationID"),
                F.col("r_name").alias("Borough"),
                F.concat_ws(" ", "n_name", "c_mktsegment").alias("Zone"),
                F.col("c_mktsegment").alias("service_zone"),
            )
        )

    @cached_property
    def counts(self) -> DataFrame:
        return hourly_counts(self.trips, CONFIG)

    @cached_property
    def dense(self) -> DataFrame:
        """Panel without names."""
        return dense_grid(self.counts, CONFIG)

    @cached_property
    def panel(self) -> DataFrame:
        return attach_zones(self.dense, self.zones, CONFIG)

    @cached_property
    def weather(self) -> DataFrame:
        errors = F.count_if(F.col("event_type") == "error")
        snowy = F.count_if((F.col("event_type") == "signup") & (F.col("value") > 200.0))
        return self.trips.groupBy(F.date_trunc("hour", "pickup_dt").alias("hour")).agg(
            (F.avg("value") / 5.0 - 10.0).alias("temperature_2m"),
            F.when(errors >= 6, F.lit(6.0)).otherwise(F.lit(0.05) * errors).alias("precipitation"),
            (F.lit(0.1) * snowy).alias("snowfall"),
            (F.lit(2.0) * F.count(F.lit(1))).alias("wind_speed_10m"),
            F.lit(50.0).alias("relative_humidity_2m"),
        )

    @cached_property
    def candidates(self) -> DataFrame:
        """Panel with the three no-fit forecasts, rows that have all of them."""
        return candidate_columns(self.panel, CONFIG).dropna(subset=list(CANDIDATES))

    def last_candidates(self, hours: int) -> DataFrame:
        """The last ``hours`` of ``candidates``. The panel is cut to these and the week
        that the forecasts look back, before any window."""
        panel = attach_zones(recent_grid(self.trips, hours + 168, CONFIG), self.zones, CONFIG)
        complete = candidate_columns(panel, CONFIG).dropna(subset=list(CANDIDATES))
        return last_horizon(complete, "hour", hours, of=self.trips.select(F.date_trunc("hour", "pickup_dt").alias("hour")))

    def last_predictions(self, hours: int) -> DataFrame:
        return long_predictions(self.last_candidates(hours), CANDIDATES, CONFIG)

    def last_forecast(self, hours: int) -> DataFrame:
        return _named_forecast(self.last_candidates(hours))

    @cached_property
    def predictions(self) -> DataFrame:
        return long_predictions(self.candidates, CANDIDATES, CONFIG)

    @cached_property
    def forecast(self) -> DataFrame:
        """One model's forecast with names: actual, predicted, residual."""
        return _named_forecast(self.candidates)

    @cached_property
    def daily_sales(self) -> DataFrame:
        return (
            self.read("orders")
            .join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("c_nationkey").alias("series_id"), F.to_date("o_orderdate").alias("d"))
            .agg(F.count(F.lit(1)).alias("sales"), F.sum("o_totalprice").alias("revenue"))
        )

    @cached_property
    def prices(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_partkey").alias("item_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("sell_price")
        )


# SQL twins of the adapters, with what each builds on.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "trips": ((), "select ts as pickup_dt, cast(user_id as int) as PULocationID, event_type, value from events"),
    "zones": (
        (),
        """select cast(c_custkey as int) as LocationID, r_name as Borough,
            n_name || ' ' || c_mktsegment as zone_name, c_mktsegment as service_zone
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    ),
    "counts": (
        ("trips",),
        """select PULocationID, date_trunc('hour', pickup_dt) as hour, count(*) as pickup_count
        from trips group by 1, 2""",
    ),
    "dense": (
        ("counts",),
        """select g.PULocationID, g.hour, coalesce(c.pickup_count, 0) as pickup_count
        from (select z.PULocationID, h.hour
              from (select distinct PULocationID from counts) z,
                   (select unnest(generate_series(min(hour), max(hour), interval 1 hour)) as hour from counts) h) g
        left join counts c on c.PULocationID = g.PULocationID and c.hour = g.hour""",
    ),
    "panel": (
        ("dense", "zones"),
        """select d.*, coalesce(z.Borough, 'Unknown') as Borough, coalesce(z.zone_name, 'Unknown') as zone_name,
            coalesce(z.service_zone, 'Unknown') as service_zone
        from dense d left join zones z on z.LocationID = d.PULocationID""",
    ),
    "weather": (
        ("trips",),
        """select date_trunc('hour', pickup_dt) as hour, avg(value) / 5e0 - 10e0 as temperature_2m,
            case when sum(case when event_type = 'error' then 1 else 0 end) >= 6 then 6e0
                 else 0.05e0 * sum(case when event_type = 'error' then 1 else 0 end) end as precipitation,
            0.1e0 * sum(case when event_type = 'signup' and value > 200e0 then 1 else 0 end) as snowfall,
            2e0 * count(*) as wind_speed_10m, 50e0 as relative_humidity_2m
        from trips group by 1""",
    ),
    "candidates": (
        ("panel",),
        """select * from (
            select *, cast(lag(pickup_count, 24) over w as double) as naive_24,
                cast(lag(pickup_count, 168) over w as double) as naive_168,
                avg(pickup_count) over (w rows between 24 preceding and 1 preceding) as mean_24
            from panel window w as (partition by PULocationID order by hour))
        where naive_24 is not null and naive_168 is not null and mean_24 is not null""",
    ),
    "predictions": (
        ("candidates",),
        " union all ".join(
            f"""select PULocationID, hour, cast(pickup_count as double) as actual, '{m}' as model, {m} as predicted
            from candidates"""
            for m in CANDIDATES
        ),
    ),
    "forecast": (
        ("candidates",),
        """select PULocationID, Borough, zone_name, service_zone, hour, cast(pickup_count as double) as actual,
            mean_24 as predicted, pickup_count - mean_24 as residual from candidates""",
    ),
    "daily_sales": (
        (),
        """select c_nationkey as series_id, cast(o_orderdate as date) as d, count(*) as sales,
            sum(o_totalprice) as revenue
        from orders join customer on o_custkey = c_custkey group by 1, 2""",
    ),
    "prices": ((), "select l_partkey as item_id, l_extendedprice / l_quantity as sell_price from lineitem"),
}


def with_ctes(names: str, body: str) -> str:
    """``body`` behind the named CTEs and what they need. Heavy ones are materialised once."""
    order: list[str] = []

    def need(name: str) -> None:
        for parent in CTES[name][0]:
            need(parent)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    if not order:
        return body
    parts = ", ".join(f"{n} as materialized ({CTES[n][1]})" for n in order)
    if body.lstrip().lower().startswith("with recursive "):
        return f"with recursive {parts}, {body.lstrip()[15:]}"
    if body.lstrip().lower().startswith("with "):
        return f"with {parts}, {body.lstrip()[5:]}"
    return f"with {parts} {body}"


def _fields(spec: str) -> list[tuple[str, str, int]]:
    fields = []
    for item in spec.split():
        name, kind = item.split(":")
        fields.append((name, kind[0], int(kind[1:] or 6)))
    return fields


def _spark_out(name: str, kind: str, digits: int) -> Column:
    c = F.col(f"`{name}`")
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "d":
        # Plain arithmetic keeps the rounding in generated code (``round`` goes through decimals).
        return (F.rint(c.cast("double") * F.lit(10.0**digits)) / F.lit(10.0**digits) + F.lit(0.0)).alias(name)
    if kind == "t":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
    if kind == "D":
        return F.date_format(c, "yyyy-MM-dd").alias(name)
    return c.cast("string").alias(name)


def _sql_out(name: str, kind: str, digits: int) -> str:
    q = f'"{name}"'
    if kind == "i":
        return f"cast({q} as bigint) as {q}"
    if kind == "d":
        return f"round_even(cast({q} as double) * 1e{digits}, 0) / 1e{digits} + 0e0 as {q}"
    if kind == "t":
        return f"strftime({q}, '%Y-%m-%d %H:%M:%S') as {q}"
    if kind == "D":
        return f"strftime({q}, '%Y-%m-%d') as {q}"
    return f"cast({q} as varchar) as {q}"


def query(name: str, spec: str, ctes: str = "", sql: str | None = None):
    """Register a query. ``spec`` names the output columns and their kinds: i whole,
    d double (with digits), s text, t time, D date. Without ``sql`` it has no twin."""
    fields = _fields(spec)

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir)).select(*[_spark_out(*f) for f in fields])

        QUERIES[name] = run
        if sql is not None:
            columns = ", ".join(_sql_out(*f) for f in fields)
            ORACLES[name] = f"select {columns} from ({with_ctes(ctes, sql)}) as answer"
        return build

    return register
