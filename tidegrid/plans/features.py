"""Panel to featured panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.config import DEFAULT, DemandConfig
from tidegrid.functions.calendar import add_calendar_features, add_holiday_features
from tidegrid.functions.seasonal import add_fourier_features
from tidegrid.functions.weather import attach_weather
from tidegrid.operators.encoding import CODE_NAMES, add_label_codes, target_means
from tidegrid.operators.ordered import label_codes
from tidegrid.operators.series import add_history_features
from tidegrid.session import stored


def build_features(
    panel: DataFrame,
    weather: DataFrame | None = None,
    config: DemandConfig = DEFAULT,
    include_target_encoding: bool = True,
    include_holidays: bool = True,
    include_codes: bool = True,
    codes: DataFrame | None = None,
    origin: str | Column | None = None,
    encode_until: Column | str | None = None,
    dense: bool = True,
    drop_incomplete: bool = True,
) -> DataFrame:
    """All features. Rows without the longest lag are dropped at the end.

    ``encode_until`` keeps later rows out of the target means; without it they
    are learnt from the whole panel. The means, codes and the Fourier origin come
    from the panel itself, before the window stage.
    """
    base = panel
    df = add_history_features(panel, config.target, config, dense)
    start = origin if origin is not None else base.agg(F.min(config.time)).scalar()
    df = _join_hours(df, base, start, include_holidays, config)
    if include_codes:
        df = add_label_codes(df, codes=codes if codes is not None else _codes(base, config))
    if weather is not None:
        df = attach_weather(df, weather, config.time)
    if include_target_encoding:
        learnt = base if encode_until is None else base.filter(
            F.col(config.time) <= (F.lit(encode_until) if isinstance(encode_until, str) else encode_until)
        )
        df = _join_means(df, learnt, config)
    if drop_incomplete:
        df = df.filter(F.col(f"lag_{max(config.lags)}h").isNotNull())
    return df


def _join_hours(df: DataFrame, panel: DataFrame, start: str | Column, include_holidays: bool, config: DemandConfig) -> DataFrame:
    """Columns that follow from the time alone. They are made once per distinct time and joined
    from a stored table, as their many date expressions are dear for every row of every series."""
    times = panel.select(config.time).distinct()
    made = add_calendar_features(times, config.time)
    made = add_fourier_features(
        made, config.time, config.daily_period, config.weekly_period, config.fourier_order, start
    )
    if include_holidays:
        made = add_holiday_features(made, config.time)
    new = [c for c in made.columns if c != config.time]
    hours = stored(made.withColumnRenamed(config.time, "__hour"), "hours")
    joined = df.drop(*new).join(hours, F.col(config.time).eqNullSafe(F.col("__hour")), "left")
    return joined.select(*df.columns, *[c for c in new if c not in df.columns])


def _codes(panel: DataFrame, config: DemandConfig) -> DataFrame:
    return label_codes(panel, [c for c in CODE_NAMES if c in panel.columns])


def _join_means(df: DataFrame, learnt: DataFrame, config: DemandConfig) -> DataFrame:
    overall = learnt.agg(F.avg(config.target)).scalar()
    for column in (config.key, config.region):
        if column in df.columns:
            # Stored, their size is known before the join: while it is small, no wide row is dealt anew.
            means = stored(target_means(learnt, config.target, column, config.smoothing, overall), "means")
            df = df.join(means, column, "left")
    return df
