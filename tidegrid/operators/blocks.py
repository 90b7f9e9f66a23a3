"""Window functions over long series, cut into blocks of hours.

``Window.partitionBy(key)`` puts the whole history of one key into one task. On
a dense panel every frame used here reaches back (or ahead) a known number of
hours, so the series can be cut into blocks instead: each block also gets the
few neighbouring rows that its frames need, the window runs per (key, block),
and the borrowed rows are dropped again. The result equals the uncut window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_HOME = "__home_block"
_BLOCK = "__block"


def hour_index(time: str | Column) -> Column:
    """Whole hours since 1970-01-01 00:00."""
    column = F.col(time) if isinstance(time, str) else time
    return F.floor(F.unix_seconds(column.cast("timestamp")) / F.lit(3600)).cast("long")


def over_series(
    df: DataFrame,
    key: str | Sequence[str],
    time: str,
    build: Callable[[WindowSpec], dict[str, Column] | list[dict[str, Column]]],
    *,
    before: int = 0,
    after: int = 0,
    block_hours: int | None = None,
) -> DataFrame:
    """Add the window columns that ``build(window)`` returns.

    ``build`` may return several stages, each using the columns of the one
    before; all stages share one shuffle and one sort. Columns whose name starts
    with ``__`` are dropped at the end.

    With ``block_hours`` the input must be dense (one row per key and hour) and
    ``before``/``after`` must cover the reach of every frame. Without it the
    window is one partition per key, which is right for any spacing of rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if block_hours is None:
        return _stages(df, build(Window.partitionBy(*keys).orderBy(time)), df.columns)

    placed, *_ = placed_rows(df, keys, time, before, after, block_hours)
    window = Window.partitionBy(*keys, _BLOCK).orderBy(time)
    return (
        _stages(placed, build(window), placed.columns)
        .filter(F.col(_BLOCK) == F.col(_HOME))
        .drop(_BLOCK, _HOME)
    )


def placed_rows(
    df: DataFrame, keys: Sequence[str], time: str, before: int, after: int, block_hours: int | None
) -> tuple[DataFrame, str | None, str | None]:
    """Rows dealt by key and block, borrowed ones included, and the columns of the block and
    of the block that a row belongs to; without ``block_hours`` dealt by key, and no columns."""
    if block_hours is None:
        return df.repartition(*keys), None, None
    size = max(block_hours, before, after)
    index = hour_index(time)
    home = F.floor(index / F.lit(size)).cast("long")
    offset = F.pmod(index, F.lit(size))
    homes = [home]
    if before:
        homes.append(F.when(offset >= size - before, home + 1))
    if after:
        homes.append(F.when(offset < after, home - 1))
    blocked = df.withColumn(_HOME, home).withColumn(
        _BLOCK, F.explode(F.array_compact(F.array(*homes)))
    )
    # Panel rows compress to almost nothing, so merging shuffle partitions by size
    # would leave the windows to a few tasks; a stated number is kept as it is.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocked.repartition(tasks, *keys, _BLOCK), _BLOCK, _HOME


def _stages(df: DataFrame, stages, kept: Sequence[str]) -> DataFrame:
    if isinstance(stages, dict):
        return df.withColumns(stages)
    for stage in stages:
        df = df.withColumns(stage)
    return df.drop(*[c for c in df.columns if c.startswith("__") and c not in kept])
