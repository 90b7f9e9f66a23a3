"""From raw trips to the dense (key, hour) panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import DEFAULT, DemandConfig


def month_bounds(months: Sequence[str]) -> tuple[Column, Column]:
    """First instant of the earliest month and last whole second of the latest."""
    first, last = min(months), max(months)
    start = F.to_timestamp(F.lit(f"{first}-01"))
    end = F.expr(f"timestamp(last_day(date'{last}-01')) + INTERVAL '23:59:59' HOUR TO SECOND")
    return start, end


def parse_time(df: DataFrame, column: str) -> DataFrame:
    """Text or timestamp to timestamp; unreadable text becomes NULL."""
    if df.schema[column].dataType.typeName() == "string":
        return df.withColumn(column, F.try_to_timestamp(F.col(column)))
    return df.withColumn(column, F.col(column).cast("timestamp"))


def in_bounds(config: DemandConfig = DEFAULT) -> Column:
    """Whether the key is inside the bounds that the configuration sets."""
    low = F.lit(True) if config.min_zone is None else F.col(config.key) >= config.min_zone
    return low if config.max_zone is None else low & (F.col(config.key) <= config.max_zone)


def reject_reason(config: DemandConfig = DEFAULT, time: str = "pickup_dt") -> Column:
    """Name of the first rule a trip breaks, NULL for a good trip."""
    start, end = month_bounds(config.months)
    return (
        F.when(F.col(time).isNull() | F.col(config.key).isNull(), "missing")
        .when(~F.col(time).between(start, end), "outside_months")
        .when(~in_bounds(config), "invalid_zone")
    )


def clean_trips(
    trips: DataFrame, config: DemandConfig = DEFAULT, time: str = "pickup_dt", zones: DataFrame | None = None
) -> DataFrame:
    """Keep trips with a time inside the configured months and a valid zone: inside the
    configured bounds, and known to the lookup ``zones`` (column LocationID) if it is given."""
    start, end = month_bounds(config.months)
    kept = (
        parse_time(trips, time)
        .dropna(subset=[time, config.key])
        .filter(F.col(time).between(start, end))
        .filter(in_bounds(config))
    )
    return kept if zones is None else known_keys(kept, zones, config)


def known_keys(rows: DataFrame, zones: DataFrame, config: DemandConfig = DEFAULT) -> DataFrame:
    """Rows whose key the lookup has."""
    known = zones.select(F.col("LocationID").cast(rows.schema[config.key].dataType).alias(config.key))
    return rows.join(known, config.key, "left_semi")


def reject_report(trips: DataFrame, config: DemandConfig = DEFAULT, time: str = "pickup_dt") -> DataFrame:
    """Number of trips per reject rule, good trips under ``kept``."""
    reason = F.coalesce(reject_reason(config, time), F.lit("kept"))
    return parse_time(trips, time).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def hourly_counts(trips: DataFrame, config: DemandConfig = DEFAULT, time: str = "pickup_dt") -> DataFrame:
    """Trips per key and hour. Counting starts before the shuffle, so a hot key
    sends at most one row per hour and task."""
    return (
        trips.groupBy(config.key, F.date_trunc("hour", F.col(time)).alias(config.time))
        .agg(F.count(F.lit(1)).cast("int").alias(config.target))
    )


def dense_grid(
    counts: DataFrame,
    config: DemandConfig = DEFAULT,
    keys: DataFrame | None = None,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Every key at every hour between the first and last hour, missing hours 0.

    The bounds are scalar subqueries. The counts of a key meet in one task, and each count
    makes the hours up to the next one, so the grid itself is neither shuffled nor joined,
    and what is grouped by key later finds it dealt by key.
    """
    key, time, target = config.key, config.time, config.target
    seen = counts.select(key).distinct() if keys is None else keys.select(key)
    low = start if start is not None else counts.agg(F.min(time)).scalar()
    high = end if end is not None else counts.agg(F.max(time)).scalar()
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    hour = F.lit(3_600_000_000)
    on_grid = F.col(time).between(low, high) & (F.pmod(micros(F.col(time)) - micros(low), hour) == 0)
    counted = counts.filter(F.col(key).isNotNull() & on_grid).withColumn("__counted", F.lit(1))
    # A row without a count opens every key at the first hour.
    opening = seen.withColumns({time: low.cast(counts.schema[time].dataType), "__counted": F.lit(0)})
    # Counts are few bytes, so merging partitions by size would let one task make all hours.
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = opening.unionByName(counted, allowMissingColumns=True).repartition(tasks, key)
    following = F.lead(time).over(Window.partitionBy(key).orderBy(time, "__counted"))
    # A key that is named several times has its rows as often.
    copies = F.lit(1) if keys is None else F.count_if(F.col("__counted") == 0).over(Window.partitionBy(key))
    gap = F.floor((F.coalesce(micros(following), micros(high) + hour) - micros(F.col(time))) / hour)
    nth = F.col("__nth")
    made = (
        rows.withColumns({"__hours": F.greatest(gap, F.col("__counted")).cast("int"), "__copies": copies})
        .filter((F.col("__hours") > 0) & (F.col("__copies") > 0))
        .withColumn("__nth", F.explode(F.sequence(F.lit(0), F.col("__hours") * F.col("__copies") - 1)))
        .withColumn("__nth", F.floor(nth / F.col("__copies")) if keys is not None else nth)
    )
    others = [c for c in counts.columns if c not in (key, time, target)]
    return made.select(
        key,
        F.timestamp_micros(micros(F.col(time)) + nth * hour).cast(counts.schema[time].dataType).alias(time),
        F.coalesce(F.when(nth == 0, F.col(target)), F.lit(0)).cast("int").alias(target),
        *[F.when(nth == 0, F.col(c)).alias(c) for c in others],
    )


def recent_grid(
    trips: DataFrame, hours: int, config: DemandConfig = DEFAULT, time: str = "pickup_dt"
) -> DataFrame:
    """The last ``hours`` of the dense grid of all keys, from raw trips.

    Equal to the end of ``dense_grid(hourly_counts(trips))``. Trips before the bound are
    not counted; the bound is a scalar on the stored time, so the scan can skip them too.
    """
    first, last = (F.date_trunc("hour", f(time)) for f in (F.min, F.max))
    span = F.make_dt_interval(hours=F.lit(hours - 1))
    start = trips.agg(F.greatest(first, last - span)).scalar()
    end = trips.agg(last).scalar()
    counts = hourly_counts(trips.filter(F.col(time) >= start), config, time)
    return dense_grid(counts, config, keys=trips.select(config.key).distinct(), start=start, end=end)


def attach_zones(panel: DataFrame, lookup: DataFrame, config: DemandConfig = DEFAULT) -> DataFrame:
    """Left join of the zone dimension; unknown zones get the text ``Unknown``.

    No broadcast hint: Spark broadcasts the dimension when its measured size is
    below the threshold and falls back to a shuffled join when it is not.
    """
    names = [config.region, config.name, config.service]
    dimension = lookup.withColumnsRenamed({"LocationID": config.key, "Zone": config.name}).select(
        F.col(config.key).cast(panel.schema[config.key].dataType), *names
    )
    joined = panel.join(dimension, config.key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit("Unknown")) for c in names})


def future_frame(
    panel: DataFrame, periods: int, step: str = "INTERVAL 1 HOUR", config: DemandConfig = DEFAULT
) -> DataFrame:
    """The next ``periods`` steps after the end of each series."""
    ends = panel.groupBy(config.key).agg(F.max(config.time).alias("__end"))
    nth = F.sequence(
        F.col("__end") + F.expr(step), F.col("__end") + F.expr(step) * F.lit(periods), F.expr(step)
    )
    return ends.select(config.key, F.posexplode(nth).alias("step", config.time)).withColumn(
        "step", F.col("step") + 1
    )


def fill_regular(
    df: DataFrame, value: str, config: DemandConfig = DEFAULT, step_seconds: int = 3600
) -> DataFrame:
    """Insert the missing hours of each key and interpolate ``value`` linearly.

    Each observed row makes the hours up to the next one, so only neighbouring
    rows meet; no grid and no join.
    """
    w = Window.partitionBy(config.key).orderBy(config.time)
    gap = (F.unix_seconds("__next") - F.unix_seconds(config.time)) / F.lit(step_seconds)
    steps = F.greatest(F.coalesce(F.floor(gap).cast("int"), F.lit(1)), F.lit(1))
    return (
        df.filter(F.col(value).isNotNull())
        .select(config.key, config.time, F.col(value).cast("double").alias(value))
        .withColumns({"__next": F.lead(config.time).over(w), "__next_value": F.lead(value).over(w)})
        .withColumn("__i", F.explode(F.sequence(F.lit(0), steps - 1)))
        .select(
            config.key,
            F.timestamp_seconds(F.unix_seconds(config.time) + F.col("__i") * step_seconds).alias(config.time),
            F.when(F.col("__i") == 0, F.col(value))
            .otherwise(F.col(value) + (F.col("__next_value") - F.col(value)) * F.col("__i") / gap)
            .alias(value),
            (F.col("__i") > 0).alias("filled"),
        )
    )
