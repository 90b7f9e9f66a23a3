"""Train/test splits, folds and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.series import tail, tail_start
from tidegrid.session import dealt_once, stored


def cutoff(df: DataFrame, time: str, hours: float) -> Column:
    """Scalar: the latest time minus ``hours``."""
    return df.agg(F.max(time) - F.make_dt_interval(hours=F.lit(int(hours)))).scalar()


def split_last_hours(df: DataFrame, time: str, hours: int) -> tuple[DataFrame, DataFrame]:
    """(train, test): the test part is the last ``hours`` of the whole panel."""
    limit = cutoff(df, time, hours)
    return df.filter(F.col(time) <= limit), df.filter(F.col(time) > limit)


def split_last_days(df: DataFrame, time: str, days: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) at ``max − (days − 1)`` days, which belongs to the test part."""
    limit = cutoff(df, time, (days - 1) * 24)
    return df.filter(F.col(time) < limit), df.filter(F.col(time) >= limit)


def last_horizon(df: DataFrame, time: str, hours: int, of: DataFrame | None = None) -> DataFrame:
    """Rows of the last ``hours``; ``of`` names a cheaper table with the same latest time."""
    return df.filter(F.col(time) > cutoff(df if of is None else of, time, hours))


def time_quantile(df: DataFrame, time: str, q: float) -> Column:
    """Scalar: row-weighted quantile of the times. Grouped by time first, so the
    aggregate holds one entry per distinct hour, not one per row."""
    per_time = df.groupBy(time).agg(F.count(F.lit(1)).alias("n"))
    micros = F.percentile(F.unix_micros(F.col(time)), F.lit(q), F.col("n"))
    return per_time.agg(F.timestamp_micros(F.floor(micros)).alias("t")).scalar()


def split_at_quantile(df: DataFrame, time: str, q: float = 0.8) -> tuple[DataFrame, DataFrame]:
    limit = time_quantile(df, time, q)
    return df.filter(F.col(time) <= limit), df.filter(F.col(time) > limit)


def one_series(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; the filter reaches the file scan."""
    return df.filter(F.col(key) == F.lit(value))


def require_series(df: DataFrame, key: str, value) -> DataFrame:
    """``one_series`` that raises for an unknown key."""
    rows = one_series(df, key, value)
    if rows.isEmpty():
        raise KeyError(f"no rows for {key}={value}")
    return rows


def sample_keys(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """All rows of ``n`` keys, chosen by a seeded hash: the same keys on every run."""
    chosen = df.select(key).distinct().orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
    return df.join(chosen, key, "left_semi")


def sample_rows(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def hold_out(df: DataFrame, by: Sequence[str], time: str, n: int, name: str = "is_val") -> DataFrame:
    """Flag the last ``n`` rows of each series; short series are all training rows."""
    # Stored, its size is known before the join: while it is small, no row of ``df`` is dealt anew.
    cut = stored(tail_start(df, n, by, time, "__cut"), "cut")
    flag = F.coalesce(F.col(time) >= F.col("__cut"), F.lit(False))
    return df.join(cut, list(by), "left").withColumn(name, flag).drop("__cut")


def series_folds(
    df: DataFrame, by: Sequence[str], time: str, n_splits: int, test_size: int, many_reads: bool = False
) -> DataFrame:
    """Expanding-window folds of every series, oldest first.

    Fold boundaries are times of rows near the end of each series; only that
    short end is ranked. Returns one row per (row, fold) with ``fold`` (1 is the
    oldest) and ``role`` train or validate; folds without training rows are left out.
    With ``many_reads`` rows that the join deals anew are stored with their bounds, once
    and not once per fold, so that each reader of a fold only scans.
    """
    depth = n_splits * test_size + 1
    ends = tail(df.select(*by, time), depth, by, time, rank="r")
    # A fold that starts at rank k*test_size needs one older row to train on.
    bounds = (
        ends.withColumn("older", F.count(F.lit(1)).over(Window.partitionBy(*by)) - F.col("r"))
        .filter((F.col("r") % test_size == 0) & (F.col("older") > 0))
        .withColumn("age", (F.col("r") / test_size).cast("int"))
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct("age", F.col(time).alias("start")))).alias("starts"))
    )
    # starts[i] opens the fold of age i+1; the fold closes where the younger one opens.
    folds = F.transform(
        "starts",
        lambda s, i: F.struct(
            (F.size("starts") - i).alias("fold"),
            s["start"].alias("start"),
            F.get("starts", i - 1)["start"].alias("stop"),
        ),
    )
    # Stored for the same reason as the cut of ``hold_out``.
    bounds = stored(bounds.select(*by, folds.alias("folds")), "folds")
    bounded = df.join(bounds, list(by))
    placed = (
        (dealt_once(bounded, "bounded") if many_reads else bounded)
        .withColumn("__f", F.explode("folds"))
        .filter(F.col("__f.stop").isNull() | (F.col(time) < F.col("__f.stop")))
    )
    role = F.when(F.col(time) < F.col("__f.start"), "train").otherwise("validate")
    return placed.withColumn("fold", F.col("__f.fold")).withColumn("role", role).drop("__f", "folds")


def date_folds(
    df: DataFrame, time: str, n_splits: int, test_size: int, strategy: str = "expanding_window"
) -> DataFrame:
    """Fold table over the distinct times, oldest first: train and test ranges.

    Distinct times number the hours of the calendar, so ranking them is small.
    """
    if strategy not in ("expanding_window", "sliding_window"):
        raise ValueError(f"unknown strategy {strategy!r}")
    times = df.select(time).distinct()
    total = times.count()
    if total < (n_splits + 1) * test_size:
        raise ValueError(f"{total} times cannot hold {n_splits} folds of {test_size}")
    ranked = times.withColumn("i", F.row_number().over(Window.orderBy(time)) - 1)

    first_train = total - n_splits * test_size
    rows = []
    for fold in range(n_splits):
        start = first_train + fold * test_size
        begin = 0 if strategy == "expanding_window" else max(start - first_train, 0)
        rows.append((fold + 1, begin, start - 1, start, start + test_size - 1))
    plan = df.sparkSession.createDataFrame(
        rows, "fold int, train_from int, train_to int, test_from int, test_to int"
    )
    edges = plan.unpivot("fold", ["train_from", "train_to", "test_from", "test_to"], "edge", "i")
    return (
        edges.join(ranked, "i")
        .groupBy("fold")
        .pivot("edge", ["train_from", "train_to", "test_from", "test_to"])
        .agg(F.max(time))
    )


def fold_rows(df: DataFrame, folds: DataFrame, time: str) -> DataFrame:
    """Rows of every fold of a ``date_folds`` table, tagged with ``fold`` and ``role``.

    The fold table (one row per fold) becomes an array constant, so each row is
    matched in place; there is no join.
    """
    table = folds.agg(F.collect_list(F.struct(*folds.columns))).scalar()
    placed = df.withColumn("__f", F.explode(table))
    in_test = F.col(time).between(F.col("__f.test_from"), F.col("__f.test_to"))
    in_train = F.col(time).between(F.col("__f.train_from"), F.col("__f.train_to"))
    return (
        placed.filter(in_test | in_train)
        .withColumn("fold", F.col("__f.fold"))
        .withColumn("role", F.when(in_test, "test").otherwise("train"))
        .drop("__f")
    )
