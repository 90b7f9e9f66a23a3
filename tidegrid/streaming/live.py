"""Live views of the trip feed.

Late rows: the live views wait ``delay`` and drop what comes later; a batch run
over the affected month replaces its partition of the panel.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidegrid.config import DEFAULT, DemandConfig
from tidegrid.operators.panel import dense_grid
from tidegrid.operators.series import add_history_features
from tidegrid.session import shared_folder


def live_hourly_counts(
    trips: DataFrame, time: str = "pickup_dt", delay: str = "2 hours", config: DemandConfig = DEFAULT
) -> DataFrame:
    """Trips per key and closed hour."""
    return (
        trips.withWatermark(time, delay)
        .groupBy(F.window(time, "1 hour").alias("w"), config.key)
        .agg(F.count(F.lit(1)).cast("int").alias(config.target))
        .select(config.key, F.col("w.start").alias(config.time), config.target)
    )


def live_trailing_counts(
    trips: DataFrame,
    time: str = "pickup_dt",
    length: str = "24 hours",
    step: str = "1 hour",
    delay: str = "2 hours",
    config: DemandConfig = DEFAULT,
) -> DataFrame:
    """Trips per key in the trailing window that ends at each step.

    Two stateful operators in a row: trips are counted per step first, so only one row per
    key and step is copied into the windows that hold it.
    """
    counts = trips.withWatermark(time, delay).groupBy(F.window(time, step).alias("w"), config.key).agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.groupBy(F.window(F.window_time("w"), length, step).alias("w"), config.key)
        .agg(F.sum("n").alias("trailing_count"))
        .select(config.key, F.col("w.end").alias("as_of"), "trailing_count")
    )


def run_to_table(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all available input into a Parquet table and return the table."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/live-{uuid4().hex}"
    table, state = path or f"{base}/table", checkpoint or f"{base}/state"
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", table)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)


def feature_writer(
    panel_path: str, features_path: str, config: DemandConfig = DEFAULT
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: append closed hours, write features of every hour since the last batch.

    A batch goes on at the hour after the last one written, so quiet hours between batches
    get their rows, and a key that is new gets rows back to the start of the panel. What
    is known so far is kept in two small tables beside the hours: the keys of each batch
    and the span of each batch. Every batch writes its own folders by overwriting and reads
    those of earlier batches only, so a batch that is run again leaves the same tables. Of
    the stored hours only those that the frames reach back to are read.
    """
    reach = max(*config.lags, *config.windows)
    keys_path, span_path = f"{panel_path}-keys", f"{panel_path}-span"
    hour = 3600

    def with_batch(schema: T.StructType) -> T.StructType:
        return T.StructType([*schema.fields, T.StructField("batch", T.LongType())])

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(config.key, config.time, config.target)
        rows.write.mode("overwrite").parquet(f"{panel_path}/batch={batch_id}")
        new = spark.read.schema(rows.schema).parquet(f"{panel_path}/batch={batch_id}")
        seconds = F.unix_timestamp(config.time)
        first, last = new.agg(F.min(seconds), F.max(seconds)).first()
        if first is None:
            return
        before = F.col("batch") < batch_id
        spark.range(1).select(F.lit(first).alias("first"), F.lit(last).alias("last")).write.mode("overwrite").parquet(f"{span_path}/batch={batch_id}")
        spans = spark.read.schema("first long, last long, batch long").parquet(span_path).filter(before)
        start, written = spans.agg(F.min("first"), F.max("last")).first()
        start, first = (first, first) if start is None else (start, written + hour)

        key_schema = rows.select(config.key).schema
        known = spark.read.schema(with_batch(key_schema)).parquet(keys_path).filter(before).select(config.key) if written is not None else None
        keys = new.select(config.key).distinct()
        keys = keys if known is None else keys.join(known, config.key, "left_anti")
        keys.write.mode("overwrite").parquet(f"{keys_path}/batch={batch_id}")
        added = spark.read.schema(key_schema).parquet(f"{keys_path}/batch={batch_id}")

        at = lambda n: F.timestamp_seconds(F.lit(n))
        fresh = dense_grid(new.join(added, config.key, "left_semi"), config, keys=added, start=at(start), end=at(last))
        fresh = add_history_features(fresh, config.target, config)
        if known is not None:
            back = max(start, first - reach * hour)
            stored = spark.read.schema(with_batch(rows.schema)).option("basePath", panel_path).parquet(panel_path)
            past = stored.filter((F.col("batch") <= batch_id) & (F.col(config.time) >= at(back))).select(*rows.columns)
            dense = dense_grid(past.join(known, config.key, "left_semi"), config, keys=known, start=at(back), end=at(last))
            going = add_history_features(dense, config.target, config).filter(F.col(config.time) >= at(first))
            fresh = fresh.unionByName(going)
        fresh.write.mode("overwrite").parquet(f"{features_path}/batch={batch_id}")

    return process


def live_features(
    counts: DataFrame,
    panel_path: str,
    features_path: str,
    checkpoint: str,
    config: DemandConfig = DEFAULT,
) -> StreamingQuery:
    """Start the feature job on a stream of closed hourly counts."""
    return (
        counts.writeStream.outputMode("append")
        .foreachBatch(feature_writer(panel_path, features_path, config))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_features(spark: SparkSession, features_path: str) -> DataFrame:
    return spark.read.parquet(features_path).drop("batch")
