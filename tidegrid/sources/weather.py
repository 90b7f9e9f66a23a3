"""Weather payloads and the stored weather table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.weather import HOURLY_VARS

PAYLOAD_SCHEMA = (
    "hourly struct<time: array<string>, " + ", ".join(f"{v}: array<double>" for v in HOURLY_VARS) + ">"
)


def read_weather_payload(spark: SparkSession, path: str) -> DataFrame:
    return flatten_weather(spark.read.schema(PAYLOAD_SCHEMA).json(path, multiLine=True))


def parse_weather_payload(df: DataFrame, column: str) -> DataFrame:
    """Payloads held as JSON text in ``column``."""
    return flatten_weather(df.select(F.from_json(column, PAYLOAD_SCHEMA).alias("p")).select("p.*"))


def flatten_weather(payload: DataFrame) -> DataFrame:
    """Parallel arrays to one row per hour; a variable that is absent becomes NULL."""
    arrays = [F.col("hourly.time").alias("time")] + [
        F.coalesce(F.col(f"hourly.{v}"), F.array().cast("array<double>")).alias(v) for v in HOURLY_VARS
    ]
    return (
        payload.select(*arrays)
        .select(F.inline(F.arrays_zip("time", *HOURLY_VARS)))
        .select(F.try_to_timestamp(F.col("time")).alias("hour"), *HOURLY_VARS)
    )


def write_weather(weather: DataFrame, path: str) -> None:
    """Store by day; a day that comes again replaces the stored one."""
    (
        weather.withColumn("day", F.to_date("hour"))
        .repartition("day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def weather_between(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Stored weather of [start, end] days; other days are not opened."""
    return spark.read.parquet(path).filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
