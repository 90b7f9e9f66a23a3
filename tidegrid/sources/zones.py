"""Zone lookup and zone outlines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOOKUP_SCHEMA = "LocationID int, Borough string, Zone string, service_zone string"


def read_zone_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Zone table from CSV; the text ``N/A`` is a missing value."""
    try:
        return spark.read.csv(path, header=True, schema=LOOKUP_SCHEMA, nullValue="N/A")
    except AnalysisException as error:
        raise FileNotFoundError(f"no zone lookup at {path}") from error


OUTLINE_SCHEMA = "features array<struct<geometry: string, properties: map<string, string>>>"


def read_zone_outlines(spark: SparkSession, path: str) -> DataFrame:
    """One row per outline with its zone id, whichever of the two id keys the file has."""
    feature = spark.read.schema(OUTLINE_SCHEMA).json(path, multiLine=True).select(F.explode("features").alias("f"))
    properties = F.col("f.properties")
    return feature.select(
        F.coalesce(
            F.try_element_at(properties, F.lit("location_id")), F.try_element_at(properties, F.lit("LocationID"))
        ).alias("zone_id"),
        F.col("f.geometry").alias("geometry"),
    )
