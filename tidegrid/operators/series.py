"""Per-series windows: lags, rolling statistics, tails, sequences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.config import DEFAULT, DemandConfig
from tidegrid.operators.blocks import hour_index, over_series, placed_rows

_STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def lag_columns(target: str, lags: Sequence[int], window: WindowSpec) -> dict[str, Column]:
    value = F.col(target).cast("double")
    return {f"lag_{n}h": F.lag(value, n).over(window) for n in lags}


def _is_whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _doubling_stages(target: str, longest: int, window: WindowSpec) -> list[dict[str, Column]]:
    """``__min_k``/``__max_k``: extremes of the last k rows for k = 1, 2, 4, … ≤ ``longest``."""
    value = F.col(target).cast("double")
    stages = [{"__min_1": value, "__max_1": value}]
    k = 1
    while 2 * k <= longest:
        earlier = lambda name: F.lag(name, k).over(window)
        stages.append(
            {
                f"__min_{2 * k}": F.least(F.col(f"__min_{k}"), earlier(f"__min_{k}")),
                f"__max_{2 * k}": F.greatest(F.col(f"__max_{k}"), earlier(f"__max_{k}")),
            }
        )
        k *= 2
    return stages


def rolling_stages(
    target: str,
    windows: Sequence[int],
    stats: Sequence[str],
    window: WindowSpec,
    min_periods: int = 1,
    whole: bool = False,
) -> list[dict[str, Column]]:
    """Statistics of the ``n`` rows before the current one, at a cost per row that
    does not grow with ``n``.

    A sliding frame is summed afresh for every row. Instead, minimum and maximum
    join two overlapping spans of a power of two, and the mean and deviation of a
    whole-number target are differences of running totals, which are exact. The
    deviation of a real-valued target keeps its frame: differences would cancel.
    """
    value = F.col(target).cast("double")
    running = window.rowsBetween(Window.unboundedPreceding, 0)
    stages: list[dict[str, Column]] = []
    if {"min", "max"} & set(stats):
        stages = _doubling_stages(target, max(windows), window)
    moments = {"__count": F.count(value).over(running)} if whole or min_periods > 1 else {}
    if whole:
        moments["__sum"] = F.sum(value).over(running)
        if "std" in stats:
            moments["__squares"] = F.sum(value * value).over(running)
    stages.append(moments)

    # Each shifted column once: an expression used twice would become two window functions.
    shifted: dict[str, Column] = {}
    for m in moments:
        shifted[f"{m}_before"] = F.lag(m, 1).over(window)
        shifted |= {f"{m}_before_{n}": F.lag(m, n + 1).over(window) for n in windows}
    columns: dict[str, Column] = {}
    for n in windows:
        inside = lambda m: F.col(f"{m}_before") - F.coalesce(F.col(f"{m}_before_{n}"), F.lit(0))
        size = inside("__count") if moments else None
        span = 1 << (n.bit_length() - 1)
        for stat in stats:
            if stat in ("min", "max"):
                name, pick = f"__{stat}_{span}", F.least if stat == "min" else F.greatest
                near, far = f"{name}_near_{n}", f"{name}_far_{n}"
                shifted[near] = F.lag(name, 1).over(window)
                shifted[far] = F.lag(name, n - span + 1).over(window)
                result = pick(near, far)
            elif whole and stat == "mean":
                result = inside("__sum") / F.nullif(size, F.lit(0))
            elif whole and stat == "std":
                total = inside("__sum")
                spread = F.greatest(size * inside("__squares") - total * total, F.lit(0.0))
                result = F.when(size > 1, F.sqrt(spread / F.nullif(size * (size - 1), F.lit(0))))
            else:
                name = f"__{stat}_frame_{n}"
                shifted[name] = _STATS[stat](value).over(window.rowsBetween(-n, -1))
                result = F.col(name)
            if min_periods > 1:
                result = F.when(size >= min_periods, result)
            columns[f"rolling_{stat}_{n}h"] = result
    return [*stages, shifted, columns]


def _rows_before(value: np.ndarray, first: np.ndarray, lags: Sequence[int], windows: Sequence[int], stats: Sequence[str], min_periods: int) -> list[np.ndarray]:
    """Rolling statistics, then lags, of whole numbers (NaN: missing) for every row; ``first``
    is the place where the series of a row begins."""
    at = np.arange(len(value))
    since = at - first

    def shifted(x: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(x), np.nan)
        out[n:] = x[: max(len(x) - n, 0)]
        out[since < n] = np.nan
        return out

    known = ~np.isnan(value)
    filled = np.where(known, value, 0.0)
    total = lambda x: np.concatenate([[0.0], np.cumsum(x)])
    count, plain, squares = total(known), total(filled), total(filled * filled)
    spans: dict[tuple[str, int], np.ndarray] = {}
    for stat, pick in (("min", np.fmin), ("max", np.fmax)):
        if stat in stats:
            spans[stat, 1], k = value, 1
            while 2 * k <= max(windows):
                spans[stat, 2 * k] = pick(spans[stat, k], shifted(spans[stat, k], k))
                k *= 2
    columns = []
    for n in windows:
        since_row = np.maximum(at - n, first)
        size = count[at] - count[since_row]
        span = 1 << (n.bit_length() - 1)
        for stat in stats:
            if stat in ("min", "max"):
                pick = np.fmin if stat == "min" else np.fmax
                result = pick(shifted(spans[stat, span], 1), shifted(spans[stat, span], n - span + 1))
            else:
                whole = plain[at] - plain[since_row]
                result = np.full(len(value), np.nan)
                if stat == "mean":
                    np.divide(whole, size, out=result, where=size > 0)
                else:
                    spread = np.maximum(size * (squares[at] - squares[since_row]) - whole * whole, 0.0)
                    np.divide(spread, size * (size - 1), out=result, where=size > 1)
                    result = np.sqrt(result)
            columns.append(np.where(size >= min_periods, result, np.nan) if min_periods > 1 else result)
    return columns + [shifted(value, n) for n in lags]


def _whole_history(
    df: DataFrame, target: str, lags: Sequence[int], windows: Sequence[int], stats: Sequence[str],
    config: DemandConfig, dense: bool, min_periods: int = 1,
) -> DataFrame:
    """``rolling_stages`` and ``lag_columns`` of a whole-number target in one pass over sorted rows.

    A chain of windows copies every row once per stage. Here rows are dealt and sorted as
    for a window, and numpy shifts whole Arrow batches; from one batch to the next only the
    keys and values of the few rows that the frames reach back to are carried.
    """
    reach = max([*lags, *windows])
    keys = [config.key]
    placed, block, home = placed_rows(df, keys, config.time, reach, 0, config.block_hours if dense else None)
    by = keys + ([block] if block else [])
    placed = placed.sortWithinPartitions(*by, config.time)
    names = [f"rolling_{stat}_{n}h" for n in windows for stat in stats] + [f"lag_{n}h" for n in lags]
    kept = [c for c in df.columns if c not in names]
    places = {c: placed.columns.index(c) for c in {*kept, *by, target, *([home] if home else [])}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] | None = None  # keys and values of the last rows
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(places[c]) for c in (*by, target)]
            both = now if held is None else [pa.concat_arrays([a, b]) for a, b in zip(held, now)]
            size = len(both[0])
            begins = np.zeros(size, bool)
            begins[0] = True
            for column in both[:-1]:
                code = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                begins[1:] |= code[1:] != code[:-1]
            first = np.maximum.accumulate(np.where(begins, np.arange(size), 0))
            value = both[-1].to_numpy(zero_copy_only=False).astype(float)
            found = _rows_before(value, first, lags, windows, stats, min_periods)
            new = size - batch.num_rows
            columns = [batch.column(places[c]) for c in kept] + [pa.array(f[new:], pa.float64(), from_pandas=True) for f in found]
            out = pa.RecordBatch.from_arrays(columns, names=[*kept, *names])
            if block:
                own = batch.column(places[block]).to_numpy(zero_copy_only=False) == batch.column(places[home]).to_numpy(zero_copy_only=False)
                out = out.filter(pa.array(own))
            yield out
            held = [column.slice(max(size - reach, 0)) for column in both]

    schema = T.StructType([placed.schema[c] for c in kept] + [T.StructField(n, T.DoubleType()) for n in names])
    return placed.mapInArrow(run, schema)


def add_lag_features(
    df: DataFrame, target: str, lags: Sequence[int], config: DemandConfig = DEFAULT, dense: bool = False
) -> DataFrame:
    """Earlier values of ``target`` as ``lag_<n>h``; ``dense`` allows hour blocks."""
    return over_series(
        df, config.key, config.time, lambda w: lag_columns(target, lags, w),
        before=max(lags), block_hours=config.block_hours if dense else None,
    )


def add_rolling_features(
    df: DataFrame,
    target: str,
    windows: Sequence[int],
    stats: Sequence[str],
    config: DemandConfig = DEFAULT,
    min_periods: int = 1,
    dense: bool = False,
) -> DataFrame:
    """Shifted rolling statistics of ``target`` as ``rolling_<stat>_<n>h``."""
    if _is_whole(df, target):
        return _whole_history(df, target, (), windows, stats, config, dense, min_periods)
    return over_series(
        df, config.key, config.time,
        lambda w: rolling_stages(target, windows, stats, w, min_periods, _is_whole(df, target)),
        before=max(windows), block_hours=config.block_hours if dense else None,
    )


def add_history_features(
    df: DataFrame,
    target: str,
    config: DemandConfig = DEFAULT,
    dense: bool = True,
) -> DataFrame:
    """Lags and rolling statistics together: one shuffle and one sort."""
    if _is_whole(df, target):
        return _whole_history(df, target, config.lags, config.windows, config.stats, config, dense)
    return over_series(
        df, config.key, config.time,
        lambda w: [
            *rolling_stages(target, config.windows, config.stats, w, whole=_is_whole(df, target)),
            lag_columns(target, config.lags, w),
        ],
        before=max(*config.lags, *config.windows),
        block_hours=config.block_hours if dense else None,
    )


def trailing_mean(
    df: DataFrame, value: str, rows: int, name: str, by: Sequence[str], time: str, strict: bool = False
) -> DataFrame:
    """Mean of the last ``rows`` rows including the current; ``strict`` wants a full frame."""
    frame = Window.partitionBy(*by).orderBy(time).rowsBetween(-(rows - 1), 0)
    mean = F.avg(value).over(frame)
    if strict:
        mean = F.when(F.count(value).over(frame) >= rows, mean)
    return df.withColumn(name, mean)


def moving_average_crossover(
    df: DataFrame,
    value: str,
    short: int = 24,
    long: int = 168,
    config: DemandConfig = DEFAULT,
    dense: bool = True,
) -> DataFrame:
    """Short and long means and ``signal``: 1 when short rises above long, −1 when it falls below."""

    number = F.col(value).cast("double")
    whole = _is_whole(df, value)

    def means(w: WindowSpec) -> list[dict[str, Column]]:
        running = w.rowsBetween(Window.unboundedPreceding, 0)
        totals = {"__count": F.count(number).over(running), "__sum": F.sum(number).over(running)}

        def mean(n: int, back: int) -> Column:
            """Mean of the ``n`` rows that end ``back`` rows before this one."""
            if not whole:
                return F.avg(number).over(w.rowsBetween(-(n - 1) - back, -back))
            part = lambda c: (F.lag(c, back).over(w) if back else F.col(c)) - F.coalesce(
                F.lag(c, n + back).over(w), F.lit(0)
            )
            return part("__sum") / F.nullif(part("__count"), F.lit(0))

        return [
            totals,
            {
                "ma_short": mean(short, 0), "ma_long": mean(long, 0),
                "before_short": mean(short, 1), "before_long": mean(long, 1),
            },
        ]

    wide = over_series(
        df, config.key, config.time, means, before=long + 1,
        block_hours=config.block_hours if dense else None,
    )
    now = F.col("ma_short") - F.col("ma_long")
    was = F.col("before_short") - F.col("before_long")
    signal = F.when((now > 0) & (was <= 0), 1).when((now < 0) & (was >= 0), -1).otherwise(0)
    return wide.withColumn("signal", signal).drop("before_short", "before_long")


def tail(df: DataFrame, n: int, by: Sequence[str], time: str, rank: str | None = None) -> DataFrame:
    """Last ``n`` rows per group. The limit is applied before the shuffle as well,
    so a hot group sends at most ``n`` rows per task."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(time).desc()))
    kept = df.withColumn("__from_end", place).filter(F.col("__from_end") <= n)
    return kept.withColumnRenamed("__from_end", rank) if rank else kept.drop("__from_end")


def head(df: DataFrame, n: int, by: Sequence[str], time: str) -> DataFrame:
    """First ``n`` rows per group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(time)))
    return df.withColumn("__from_start", place).filter(F.col("__from_start") <= n).drop("__from_start")


def tail_start(df: DataFrame, n: int, by: Sequence[str], time: str, name: str = "tail_start") -> DataFrame:
    """Time of the ``n``-th last row per group, NULL where the group is not longer than ``n``."""
    last = tail(df.select(*by, time), n + 1, by, time, rank="r")
    return last.groupBy(*by).agg(
        F.max(F.when((F.col("r") == n), F.col(time))).alias("__start"),
        F.max("r").alias("__len"),
    ).select(*by, F.when(F.col("__len") > n, F.col("__start")).alias(name))


def drop_tail(df: DataFrame, n: int, by: Sequence[str], time: str) -> DataFrame:
    """All but the last ``n`` rows per group; groups of ``n`` rows or fewer vanish.

    The cut time comes from the short tail, so no task sorts a whole group.
    """
    cut = tail_start(df, n, by, time, "__cut")
    return df.join(cut, list(by)).filter(F.col(time) < F.col("__cut")).drop("__cut")


def time_index(df: DataFrame, by: Sequence[str], time: str, name: str = "time_idx") -> DataFrame:
    """Hours since the start of the series."""
    start = df.groupBy(*by).agg(F.min(time).alias("__start"))
    return (
        df.join(start, list(by))
        .withColumn(name, (hour_index(time) - hour_index("__start")).cast("int"))
        .drop("__start")
    )


def sequences(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    length: int,
    config: DemandConfig = DEFAULT,
    dense: bool = True,
) -> DataFrame:
    """Sliding inputs: the ``length`` rows before each row, with the row's target."""
    row = F.struct(*[F.col(c).cast("double").alias(c) for c in features])
    wide = over_series(
        df, config.key, config.time,
        lambda w: {"window": F.collect_list(row).over(w.rowsBetween(-length, -1))},
        before=length, block_hours=config.block_hours if dense else None,
    )
    return wide.filter(F.size("window") == length).select(
        config.key, config.time, "window", F.col(target).cast("double").alias("next_value")
    )


def standardise(
    df: DataFrame, value: str, by: Sequence[str], name: str = "scaled", fit_on: DataFrame | None = None
) -> DataFrame:
    """(value − mean) / std with the population std of ``fit_on``; a std of 0 counts as 1."""
    stats = (fit_on if fit_on is not None else df).groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
    scale = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
    return (
        df.join(stats, list(by), "left")
        .withColumn("std", scale)
        .withColumn(name, (F.col(value) - F.col("mean")) / F.col("std"))
    )


def unstandardise(df: DataFrame, scaled: str, name: str = "restored") -> DataFrame:
    return df.withColumn(name, F.col(scaled) * F.col("std") + F.col("mean"))


def step_between(df: DataFrame, by: Sequence[str], time: str, name: str = "step_hours") -> DataFrame:
    """Hours between a row and the row before it."""
    w = Window.partitionBy(*by).orderBy(time)
    seconds = F.unix_seconds(F.col(time)) - F.unix_seconds(F.lag(time).over(w))
    return df.withColumn(name, seconds / F.lit(3600.0))
