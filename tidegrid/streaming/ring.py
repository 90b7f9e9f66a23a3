"""Live features from state of their own: a ring of the last hours of every key.

Nothing stored is read back: the state holds the hour to write next and the counts that the
frames reach back to. Closed hours that had no trip are written when the watermark has
passed them, woken by a timer on event time.

A call of the state, a timer and a frame cost far more than the numbers of one key, so keys
are dealt to ``GROUPS`` groups, each with one state and one timer. Counts leave the state as
one row per key and span of hours; lags and rolling statistics of many keys are then made
at once from Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidegrid.config import DEFAULT, DemandConfig
from tidegrid.operators.series import _rows_before

_HOUR = 3600
# Fixed value: groups of keys; a stream that goes on from its state needs the same number.
GROUPS = 2048
# Hours in one row that leaves the state, and such rows made into features at once.
SPAN, TOGETHER = 1024, 32
# Fixed value: the state store that keyed state with timers needs.
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside use the state store that timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def history_columns(values: np.ndarray, first: np.ndarray, config: DemandConfig = DEFAULT) -> dict[str, np.ndarray]:
    """Lags and rolling statistics of whole numbers (NaN: no such hour) in series one after the
    other; ``first`` is the place where the series of each value begins."""
    names = [*(f"rolling_{s}_{n}h" for n in config.windows for s in config.stats), *(f"lag_{n}h" for n in config.lags)]
    return dict(zip(names, _rows_before(values, first, config.lags, config.windows, config.stats, 1)))


def history_table(past: np.ndarray, new: np.ndarray, config: DemandConfig = DEFAULT) -> dict[str, np.ndarray]:
    """Lags and rolling statistics of the ``new`` hours, which follow the ``past`` ones (NaN: no such hour)."""
    series = np.concatenate([past[-max(*config.lags, *config.windows) :], new])
    found = history_columns(series, np.zeros(len(series), np.int64), config)
    return {name: values[len(series) - len(new) :] for name, values in found.items()}


class HourRing(StatefulProcessor):
    """Turns closed hourly counts of a group of keys into spans of every hour from ``origin`` (epoch seconds) on.

    A row is a key, the first new hour, the number of new hours and the counts (32-bit
    whole numbers) of the hours that frames reach back to and the new ones.
    """

    def __init__(self, origin: int, reach: int):
        self.origin, self.reach = origin, reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "following long, keys array<string>, past binary")

    def _spans(self, keys: list, past: np.ndarray, new: np.ndarray, following: int) -> Iterator[pd.DataFrame]:
        """New hours of ``keys`` (a row each) behind their past."""
        whole, before = np.concatenate([past, new], axis=1), past.shape[1]
        for at in range(0, new.shape[1], SPAN):
            size = min(SPAN, new.shape[1] - at)
            part = whole[:, max(0, before + at - self.reach) : before + at + size]
            for k in range(0, len(keys), SPAN):
                counts = [row.tobytes() for row in part[k : k + SPAN]]
                yield pd.DataFrame({"key": pd.Series(keys[k : k + SPAN], dtype=object), "second": following + at * _HOUR, "hours": size, "counts": counts})

    def _write(self, rows: pd.DataFrame | None, watermark_ms: int) -> Iterator[pd.DataFrame]:
        following, keys, past = self.ring.get() if self.ring.exists() else (self.origin, [], b"")
        stop = max(watermark_ms // 1000 // _HOUR * _HOUR, following)
        place = {k: i for i, k in enumerate(keys)}
        if rows is not None:
            stop = max(stop, int(rows["second"].max()) + _HOUR)
            added = dict.fromkeys(k for k in rows["key"] if k not in place)
            place |= {k: len(keys) + i for i, k in enumerate(added)}
        if stop <= following and len(place) == len(keys):
            return
        past = np.frombuffer(past, np.int32).reshape(len(keys), -1) if keys else np.zeros((0, 0), np.int32)
        # Keys that are new have no trip before: they are written from the origin on.
        hours = (stop - self.origin) // _HOUR
        if hours <= 0:
            return
        back = (following - self.origin) // _HOUR
        new = np.zeros((len(place), hours - back), np.int32)
        if rows is not None:
            row = np.array([place[k] for k in rows["key"]])
            at = (rows["second"].to_numpy(np.int64) - following) // _HOUR
            fresh = row >= len(keys)
            early = np.zeros((len(place) - len(keys), back), np.int32)
            inside = at >= 0
            new[row[inside], at[inside]] = rows["n"].to_numpy(np.int32)[inside]
            inside = fresh & (at < 0) & (at >= -back)
            early[row[inside] - len(keys), at[inside] + back] = rows["n"].to_numpy(np.int32)[inside]
        names, known = list(place), len(keys)
        if known:
            yield from self._spans(names[:known], past, new[:known], following)
        if len(names) > known:
            begun = np.concatenate([early, new[known:]], axis=1)
            yield from self._spans(names[known:], np.zeros((len(begun), 0), np.int32), begun, self.origin)
        kept = np.concatenate([past, new[:known]], axis=1)[:, -self.reach :] if known else np.zeros((0, min(self.reach, hours)), np.int32)
        if len(names) > known:
            kept = np.concatenate([kept, begun[:, -self.reach :]])
        self.ring.update((int(stop), names, kept.tobytes()))
        self.handle.registerTimer(int(stop + _HOUR) * 1000)  # the end of the hour that is next

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows), ignore_index=True)
        # A null key is None, as in the state.
        given["key"] = given["key"].astype(object).where(given["key"].notna(), None)
        yield from self._write(given, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._write(None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def live_ring_features(
    trips: DataFrame, origin: int, time: str = "pickup_dt", delay: str = "2 hours", config: DemandConfig = DEFAULT
) -> DataFrame:
    """Count, lags and rolling statistics of every key and closed hour since ``origin`` (epoch
    seconds of an hour), quiet hours included. A null key counts no trips, as on the dense grid.
    Start it inside ``keyed_state``."""
    if origin % _HOUR:
        raise ValueError("origin must be the start of an hour")
    counts = trips.withWatermark(time, delay).groupBy(F.window(time, "1 hour").alias("w"), config.key).agg(F.count(F.lit(1)).cast("int").alias("n"))
    # Text as the type of the key in the state serves every type, nulls too.
    hourly = counts.select(
        F.pmod(F.xxhash64(config.key), F.lit(GROUPS)).cast("int").alias("group"), F.col(config.key).cast("string").alias("key"),
        F.window_time("w").alias("at"), F.unix_timestamp("w.start").alias("second"),
        F.when(F.col(config.key).isNotNull(), F.col("n")).otherwise(0).alias("n"),
    )
    ring = HourRing(origin, max(*config.lags, *config.windows))
    spans = hourly.groupBy("group").transformWithStateInPandas(ring, "key string, second long, hours int, counts binary", "Append", "EventTime")
    key_type = trips.schema[config.key].dataType
    names = [*(f"lag_{n}h" for n in config.lags), *(f"rolling_{s}_{n}h" for n in config.windows for s in config.stats)]
    schema = T.StructType(
        [
            T.StructField("key", key_type), T.StructField("second", T.LongType()), T.StructField("n", T.IntegerType()),
            *(T.StructField(n, T.DoubleType()) for n in names),
        ]
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                counts = part.column(3).to_pylist()
                second, hours = (part.column(i).to_numpy() for i in (1, 2))
                sizes = np.array([len(c) // 4 for c in counts])
                ends = np.cumsum(sizes)
                values = np.frombuffer(b"".join(counts), np.int32)
                own = np.repeat(np.arange(len(sizes)), sizes)
                since = np.arange(len(values)) - (ends - hours)[own]
                new = np.flatnonzero(since >= 0)
                found = history_columns(values.astype(float), (ends - sizes)[own], config)
                columns = [part.column(0).take(pa.array(own[new])), pa.array(second[own[new]] + since[new] * _HOUR), pa.array(values[new])]
                columns += [pa.array(found[n][new], pa.float64(), from_pandas=True) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "second", "n", *names])

    rows = spans.select(F.col("key").cast(key_type).alias("key"), "second", "hours", "counts").mapInArrow(features, schema)
    return rows.select(
        F.col("key").alias(config.key), F.timestamp_seconds("second").alias(config.time), F.col("n").alias(config.target), *names
    )
