"""Time-series diagnostics of all series at once."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidegrid.config import DEFAULT, DemandConfig
from tidegrid.models.linear import moment_table, unpack_moments
from tidegrid.operators.blocks import hour_index, over_series


def _block(config: DemandConfig, dense: bool) -> int | None:
    return config.block_hours if dense else None


# --- autocorrelation -------------------------------------------------------

def acf(
    df: DataFrame, value: str, lags: int = 72, config: DemandConfig = DEFAULT, dense: bool = True
) -> DataFrame:
    """Autocorrelation per series and lag, with the 1.96/√n bound.

    The lagged values are window columns of one pass and every lag is a sum in
    one aggregate, so rows are never multiplied by the number of lags.
    """
    means = df.groupBy(config.key).agg(F.avg(value).alias("__mean"), F.count(value).alias("__n"))
    centred = df.join(means, config.key).withColumn("__d", F.col(value) - F.col("__mean"))
    lagged = over_series(
        centred.select(config.key, config.time, "__d", "__n"), config.key, config.time,
        lambda w: {f"__l{k}": F.lag("__d", k).over(w) for k in range(1, lags + 1)},
        before=lags, block_hours=_block(config, dense),
    )
    d = F.col("__d")
    sums = lagged.groupBy(config.key).agg(
        F.max("__n").alias("n"),
        F.sum(d * d).alias("__c0"),
        *[F.sum(d * F.col(f"__l{k}")).alias(f"__c{k}") for k in range(1, lags + 1)],
    )
    points = [F.struct(F.lit(k).alias("lag"), F.col(f"__c{k}").alias("c")) for k in range(lags + 1)]
    return (
        sums.select(config.key, "n", "__c0", F.explode(F.array(*points)).alias("p"))
        .filter(F.col("p.lag") <= F.floor(F.col("n") / 2) - 1)
        .select(
            config.key,
            F.col("p.lag").alias("lag"),
            F.try_divide(F.col("p.c"), F.col("__c0")).alias("acf"),
            (F.lit(1.96) / F.sqrt(F.col("n"))).alias("bound"),
        )
    )


def pacf(acf_table: DataFrame, config: DemandConfig = DEFAULT) -> DataFrame:
    """Partial autocorrelation (Yule-Walker) from the ``acf`` table.

    One array of at most a few dozen numbers per series.
    """
    arrays = acf_table.groupBy(config.key).agg(
        F.max("bound").alias("bound"),
        F.transform(F.sort_array(F.collect_list(F.struct("lag", "acf"))), lambda s: s["acf"]).alias("r"),
    )
    key_type = acf_table.schema[config.key].dataType.simpleString()

    def solve(batches):
        for pdf in batches:
            rows = [
                (key, bound, [None if np.isnan(x) else float(x) for x in durbin_levinson(np.asarray(r, float))])
                for key, bound, r in zip(pdf[config.key], pdf["bound"], pdf["r"])
            ]
            yield pd.DataFrame(rows, columns=[config.key, "bound", "values"])

    solved = arrays.mapInPandas(solve, f"{config.key} {key_type}, bound double, values array<double>")
    return solved.select(config.key, "bound", F.posexplode("values").alias("lag", "pacf")).select(
        config.key, "lag", "pacf", "bound"
    )


def durbin_levinson(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of an autocorrelation sequence that starts with 1."""
    out = np.full(len(r), np.nan)
    if len(r) == 0 or np.isnan(r).any():
        return out
    out[0] = 1.0
    phi = np.zeros(0)
    error = 1.0
    for k in range(1, len(r)):
        if error <= 1e-14:
            break
        last = (r[k] - phi @ r[k - 1 : 0 : -1]) / error if k > 1 else r[1]
        phi = np.append(phi - last * phi[::-1], last)
        error *= 1.0 - last * last
        out[k] = last
    return out


# --- stationarity ----------------------------------------------------------

# Response-surface coefficients of the unit-root test with a constant.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
CRITICAL_5 = (-2.86154, -2.8903, -4.234, -40.040)


def unit_root_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    coefficients = SMALL_P if tau <= TAU_STAR else LARGE_P
    z = sum(c * tau**i for i, c in enumerate(coefficients))
    return 0.5 * (1.0 + erf(z / sqrt(2.0)))


def default_max_lag(n: int) -> int:
    return max(min(int(ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2), 0)


def adf(
    df: DataFrame, value: str, max_lag: int | None = None, config: DemandConfig = DEFAULT, dense: bool = True
) -> DataFrame:
    """Unit-root test per series: statistic, p-value, chosen lag order, stationary at 5 %.

    The order with the smallest AIC is chosen on a common sample from one table
    of moments; the statistic comes from a second table on the sample of that
    order. The default ``max_lag`` follows the longest series.
    """
    key = config.key
    if max_lag is None:
        longest = df.groupBy(key).count().agg(F.max("count")).first()[0] or 0
        max_lag = default_max_lag(longest)
    depth = max_lag + 2
    levels = over_series(
        df.select(key, config.time, F.col(value).cast("double").alias("__y")), key, config.time,
        lambda w: {"levels": F.array("__y", *[F.lag("__y", i).over(w) for i in range(1, depth)])},
        before=depth, block_hours=_block(config, dense),
    ).select(key, "levels")
    change = lambda i: F.col("levels")[i] - F.col("levels")[i + 1]
    size = max_lag + 1

    # The deepest level is known exactly where all are: missing values are at the start.
    full = levels.filter(F.col("levels")[depth - 1].isNotNull())
    terms = [F.col("levels")[1], *[change(i) for i in range(1, size)]]
    order = _solve_rows(moment_table(full, terms, change(0), [key]), key, df, size, _choose_order, "order int")

    # Only lags up to the chosen order enter; the others are blanked out.
    kept = levels.join(order, key).filter(F.get("levels", F.col("order") + 1).isNotNull())
    used = [F.col("levels")[1]] + [
        F.when(F.col("order") >= i, change(i)).otherwise(F.lit(0.0)) for i in range(1, size)
    ]
    final = moment_table(kept, used, change(0), [key, "order"])
    fields = "statistic double, p_value double, lags int, n_obs bigint, critical_5pct double"
    tested = _solve_rows(final, key, df, size, _statistic, fields)
    return tested.withColumn("is_stationary", F.col("p_value") < 0.05)


def _solve_rows(table: DataFrame, key: str, df: DataFrame, size: int, solve, fields: str) -> DataFrame:
    key_type = df.schema[key].dataType.simpleString()
    columns = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [(row[key], *solve(row, size)) for row in pdf.to_dict("records")]
            yield pd.DataFrame(rows, columns=[key, *columns])

    return table.mapInPandas(run, f"{key} {key_type}, {fields}")


def _fit(xtx: np.ndarray, xty: np.ndarray, yty: float, n: int, size: int):
    a, b = xtx[:size, :size], xty[:size]
    inverse = np.linalg.pinv(a)
    beta = inverse @ b
    sse = max(float(yty - beta @ b), 0.0)
    return beta, inverse, sse


def _nested_errors(xtx: np.ndarray, xty: np.ndarray, yty: float) -> np.ndarray | None:
    """Squared errors of the fits on the first 1, 2, ... columns, all from one Cholesky factor;
    None if columns are too close to depend on each other."""
    size = np.sqrt(np.diag(xtx))
    if not size.all() or not np.isfinite(size).all():
        return None
    try:
        factor = np.linalg.cholesky(xtx / np.outer(size, size))
    except np.linalg.LinAlgError:
        return None
    if np.diag(factor).min() < 1e-4:
        return None
    return yty - np.cumsum(np.square(np.linalg.solve(factor, xty / size)))


def _choose_order(row: dict, k: int) -> tuple[int]:
    """Columns are: constant, level, lagged differences; order p uses the first p + 2."""
    xtx, xty, yty, n = unpack_moments(row, k)
    best, chosen = np.inf, 0
    errors = _nested_errors(xtx, xty, yty)
    for p in range(k):
        sse = _fit(xtx, xty, yty, n, p + 2)[2] if errors is None else max(float(errors[p + 1]), 0.0)
        likelihood = -n / 2.0 * (np.log(2 * np.pi) + np.log(max(sse, 1e-300) / n) + 1.0)
        aic = 2.0 * (p + 2) - 2.0 * likelihood
        if aic < best - 1e-9:
            best, chosen = aic, p
    return (chosen,)


def _statistic(row: dict, k: int):
    xtx, xty, yty, n = unpack_moments(row, k)
    order = int(row["order"])
    size = order + 2
    beta, inverse, sse = _fit(xtx, xty, yty, n, size)
    critical = sum(c / n**i for i, c in enumerate(CRITICAL_5))
    variance = sse / max(n - size, 1)
    spread = sqrt(max(variance * inverse[1, 1], 0.0))
    if spread == 0.0:
        return None, None, order, n, critical
    tau = float(beta[1] / spread)
    return tau, unit_root_p(tau), order, n, critical


# --- decomposition ---------------------------------------------------------

def decompose(
    df: DataFrame,
    value: str,
    period: int = 24,
    robust: bool = False,
    config: DemandConfig = DEFAULT,
    dense: bool = True,
    min_cycles: int = 2,
) -> DataFrame:
    """Additive trend, seasonal part and residual of every series.

    Trend: centred moving mean over one period (an even period takes the mean of
    two neighbouring windows). Seasonal: mean per phase of what is left (median
    with ``robust``), centred to 0. Series of fewer than ``min_cycles`` periods
    give no rows. Ends without a full window have a NULL trend and residual.
    """
    key, time = config.key, config.time
    half = period // 2
    y = F.col(value).cast("double")

    def trend(w: WindowSpec) -> dict[str, Column]:
        if period % 2:
            frame = w.rowsBetween(-half, half)
            return {"trend": F.when(F.count(y).over(frame) == period, F.avg(y).over(frame))}
        left, right = w.rowsBetween(-half, half - 1), w.rowsBetween(-half + 1, half)
        full = F.count(y).over(w.rowsBetween(-half, half)) == period + 1
        return {"trend": F.when(full, (F.avg(y).over(left) + F.avg(y).over(right)) / 2)}

    lengths = df.groupBy(key).agg(F.count(value).alias("__n")).filter(F.col("__n") >= min_cycles * period)
    long_enough = df.select(key, time, y.alias(value)).join(lengths.select(key), key, "left_semi")
    smooth = over_series(
        long_enough, key, time, trend, before=half, after=half, block_hours=_block(config, dense)
    ).withColumns({"phase": F.pmod(hour_index(time), F.lit(period)), "__rest": F.col(value) - F.col("trend")})

    centre = F.median("__rest") if robust else F.avg("__rest")
    phases = smooth.groupBy(key, "phase").agg(centre.alias("__phase"))
    level = phases.groupBy(key).agg(F.avg("__phase").alias("__level"))
    seasonal = phases.join(level, key).select(key, "phase", (F.col("__phase") - F.col("__level")).alias("seasonal"))
    return (
        smooth.join(seasonal, [key, "phase"])
        .withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal"))
        .drop("__rest", "phase")
    )


def variance_shares(parts: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Sample variance of each component as percent of the variance of the series."""
    whole = F.var_samp(value)
    return parts.groupBy(*by).agg(
        *[
            F.try_divide(F.var_samp(c), whole).alias(f"{c}_share")
            for c in ("trend", "seasonal", "residual")
        ]
    ).withColumns({f"{c}_share": F.col(f"{c}_share") * F.lit(100.0) for c in ("trend", "seasonal", "residual")})
