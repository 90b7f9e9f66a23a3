"""Structured Streaming jobs over the event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalog.base import CONFIG, query
from tidegrid.catalog.features import BY_ZONE, LAGS, LAGS_SQL, ROLLING, ROLLING_SQL
from tidegrid.catalog.panel import scratch
from tidegrid.sources.trips import trip_stream
from tidegrid.streaming import live, ring


def feed(t):
    schema = t.read("events").schema
    stream = trip_stream(t.spark, t.dir, schema, "events.parquet")
    return stream.select(
        F.col("ts").cast("timestamp").alias("pickup_dt"), F.col("user_id").cast("int").alias("PULocationID")
    )


CLOSED = "(select max(pickup_dt) - interval 2 hour from trips)"


@query(
    "t4_live_hourly_counts", "PULocationID:i hour:t pickup_count:i", "counts trips",
    f"select * from counts where hour + interval 1 hour <= {CLOSED}",
)
def _(t):
    return live.run_to_table(live.live_hourly_counts(feed(t), config=CONFIG))


@query(
    "t5_live_trailing_day", "PULocationID:i as_of:t trailing_count:i", "trips",
    f"""with e as (select PULocationID, unnest(generate_series(date_trunc('hour', pickup_dt) + interval 1 hour,
            date_trunc('hour', pickup_dt) + interval 24 hour, interval 1 hour)) as as_of from trips)
    select PULocationID, as_of, count(*) as trailing_count from e where as_of <= {CLOSED} group by 1, 2""",
)
def _(t):
    return live.run_to_table(live.live_trailing_counts(feed(t), config=CONFIG))


@query(
    "t6_live_features", f"PULocationID:i hour:t pickup_count:i {LAGS} {ROLLING}", "counts trips",
    f"""with c as (select * from counts where hour + interval 1 hour <= {CLOSED}),
        d as (select a.PULocationID, b.hour from (select distinct PULocationID from c) a,
            (select unnest(generate_series(min(hour), max(hour), interval 1 hour)) as hour from c) b),
        dense as (select d.*, coalesce(c.pickup_count, 0) as pickup_count from d
            left join c on c.PULocationID = d.PULocationID and c.hour = d.hour)
    select PULocationID, hour, pickup_count, {LAGS_SQL}, {ROLLING_SQL} from dense {BY_ZONE}""",
)
def _(t):
    base = scratch(t, "live")
    counts = live.live_hourly_counts(feed(t), config=CONFIG)
    live.live_features(counts, f"{base}/panel", f"{base}/features", f"{base}/state", CONFIG).awaitTermination()
    return live.read_features(t.spark, f"{base}/features")


PARTS = ("pickup_dt < timestamp '2024-01-09'", "pickup_dt >= timestamp '2024-01-09' and pickup_dt < timestamp '2024-01-17'", "pickup_dt >= timestamp '2024-01-19 05:00:00'")


@query(
    "t6_ring_features", f"PULocationID:i hour:t pickup_count:i {LAGS} {ROLLING}", "trips",
    f"""with f as (select * from trips where {' or '.join(f'({p})' for p in PARTS)}),
        u as (select date_trunc('hour', max(pickup_dt) - interval 2 hour) as stop, date_trunc('hour', min(pickup_dt)) as start from f),
        c as (select PULocationID, date_trunc('hour', pickup_dt) as hour, count(*) as pickup_count from f group by 1, 2),
        d as (select a.PULocationID, b.hour from (select distinct PULocationID from c, u where hour < stop) a,
            (select unnest(generate_series(start, stop - interval 1 hour, interval 1 hour)) as hour from u) b),
        dense as (select d.*, coalesce(c.pickup_count, 0) as pickup_count from d left join c using (PULocationID, hour))
    select PULocationID, hour, pickup_count, {LAGS_SQL}, {ROLLING_SQL} from dense {BY_ZONE}""",
)
def _(t):
    """Three ingests with a gap between the last two; the stream stops after each and goes on from its state."""
    base = scratch(t, "ring")
    first = t.trips.agg(F.min(F.unix_timestamp(F.date_trunc("hour", "pickup_dt")))).first()[0]
    with ring.keyed_state(t.spark):
        for part in PARTS:
            t.trips.filter(part).select("pickup_dt", "PULocationID").write.mode("append").parquet(f"{base}/trips")
            # An ingest is one batch however many files it has: of two, the second would come too late.
            stream = trip_stream(t.spark, f"{base}/trips", t.trips.select("pickup_dt", "PULocationID").schema, max_files=2**31 - 1)
            features = live.run_to_table(ring.live_ring_features(stream, first or 0, config=CONFIG), f"{base}/table", f"{base}/state")
    return features
