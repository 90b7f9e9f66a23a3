"""Raw trips to the stored panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.config import DEFAULT, DemandConfig
from tidegrid.operators.panel import attach_zones, clean_trips, dense_grid, hourly_counts, known_keys
from tidegrid.session import pin_utc
from tidegrid.sources.tables import write_by_month
from tidegrid.sources.trips import read_trips
from tidegrid.sources.zones import read_zone_lookup


def build_panel(trips: DataFrame, lookup: DataFrame, config: DemandConfig = DEFAULT) -> DataFrame:
    """Clean, count per (zone, hour), make dense, name the zones.

    Zones the lookup lacks go after the counting, when few rows are left to compare.
    """
    counts = known_keys(hourly_counts(clean_trips(trips, config), config), lookup, config)
    return attach_zones(dense_grid(counts, config), lookup, config)


def preprocess(
    spark: SparkSession, trips_dir: str, lookup_path: str, out: str | None = None, config: DemandConfig = DEFAULT
) -> DataFrame:
    pin_utc(spark)
    panel = build_panel(read_trips(spark, trips_dir, config.taxi_type), read_zone_lookup(spark, lookup_path), config)
    if out is None:
        return panel
    write_by_month(panel, out, config)
    return spark.read.parquet(out)
