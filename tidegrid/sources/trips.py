"""Trip files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Pickup column per taxi type.
PICKUP_COLUMN = {"yellow": "tpep_pickup_datetime"}
DEFAULT_PICKUP_COLUMN = "lpep_pickup_datetime"


def pickup_column(taxi_type: str) -> str:
    return PICKUP_COLUMN.get(taxi_type, DEFAULT_PICKUP_COLUMN)


def read_trips(spark: SparkSession, directory: str, taxi_type: str = "yellow") -> DataFrame:
    """Pickup time and zone of all monthly files; only these two columns are read."""
    column = pickup_column(taxi_type)
    try:
        files = spark.read.parquet(f"{directory}/{taxi_type}_tripdata_*.parquet")
    except AnalysisException as error:
        raise FileNotFoundError(f"no {taxi_type} trip files in {directory}") from error
    return files.select(
        F.col(column).cast("timestamp").alias("pickup_dt"), F.col("PULocationID").cast("int")
    )


def missing_months(
    spark: SparkSession, directory: str, months: Sequence[str], taxi_type: str = "yellow"
) -> DataFrame:
    """Wanted months without a file (all, if the folder is empty). Lists file names, reads no file."""
    wanted = spark.createDataFrame([(m,) for m in months], "month string")
    try:
        files = spark.read.format("binaryFile").load(f"{directory}/{taxi_type}_tripdata_*.parquet")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return wanted  # the first ingest: no file yet
    names = files.select(F.regexp_extract("path", r"_tripdata_(\d{4}-\d{2})\.parquet", 1).alias("month"))
    return wanted.join(names, "month", "left_anti")


def trip_stream(
    spark: SparkSession,
    directory: str,
    schema: T.StructType,
    pattern: str = "*.parquet",
    max_files: int = 16,
) -> DataFrame:
    """Files that arrive in a folder, as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files)
        .parquet(directory)
    )
