"""Least squares for every group at once.

The cross products are plain sums: a matrix product per batch and group, added up by Spark.
One small row per group remains; only that row is solved, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def moment_table(
    df: DataFrame,
    features: Sequence[str | Column],
    target: str | Column,
    by: Sequence[str] = (),
) -> DataFrame:
    """Per group: ``n`` and ``m``, the upper triangle of the cross products of
    (features, target) with their plain sums in front. Rows with a NULL are left out.

    The terms travel in one array column. Each Arrow batch multiplies the rows of a group as
    a matrix, so Spark adds up one row per batch and group, not hundreds of products per row.
    """
    terms = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in (*features, target)]
    size, width = len(terms), len(by)
    flat = df.select(*by, F.array(*terms).alias("__z")).filter(F.size(F.array_compact("__z")) == size)
    upper = np.triu_indices(size)
    long = size + len(upper[0])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = batch.column(width).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            group = np.zeros(len(z), np.int64)
            for column in batch.columns[:width]:
                code = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                group = np.unique(group * (int(code.max()) + 1) + code, return_inverse=True)[1]
            order = np.argsort(group, kind="stable")
            z, starts = z[order], np.flatnonzero(np.diff(group[order], prepend=-1))
            sums = np.empty((len(starts), long))
            for i, (first, stop) in enumerate(zip(starts, np.append(starts[1:], len(z)))):
                rows = z[first:stop]
                sums[i, :size], sums[i, size:] = rows.sum(axis=0), (rows.T @ rows)[upper]
            keys = [column.take(pa.array(order[starts])) for column in batch.columns[:width]]
            counts = pa.array(np.diff(np.append(starts, len(z))))
            m = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, long, dtype=np.int32)), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*keys, counts, m], names=[*by, "n", "m"])

    fields = [*flat.schema.fields[:width], T.StructField("n", T.LongType()), T.StructField("m", T.ArrayType(T.DoubleType()))]
    parts = flat.mapInArrow(multiply, T.StructType(fields))
    if by:  # few bytes, but each group is solved next: merged by size, one task would solve them all
        parts = parts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    m = F.col("m")
    return parts.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array(*[F.sum(m[i]) for i in range(long)]).alias("m"))


def unpack_moments(row: dict, k: int):
    """(X'X, X'y, y'y, n) with the constant in front of the ``k`` features."""
    n, m = int(row["n"]), np.asarray(row["m"], dtype=float)
    size = k + 1
    full = np.zeros((size + 1, size + 1))
    full[0, 0] = n
    full[0, 1:] = m[:size]
    upper = np.triu_indices(size)
    full[upper[0] + 1, upper[1] + 1] = m[size:]
    full = full + np.triu(full, 1).T
    return full[:size, :size], full[:size, size], float(full[size, size]), n


def soft_descent(s: np.ndarray, t: np.ndarray, penalty: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Minimum of b'sb / 2 - t'b + sum(penalty * |b|), one coordinate at a time."""
    b = np.zeros(len(t))
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(np.diag(s) > 0):
            pull = t[j] - s[j] @ b + s[j, j] * b[j]
            new = np.sign(pull) * max(abs(pull) - penalty[j], 0.0) / s[j, j]
            moved = max(moved, abs(new - b[j]) * np.sqrt(s[j, j]))
            b[j] = new
        if moved <= 1e-9 * (1.0 + np.abs(t).max(initial=0.0)):
            break
    return b


def sparse_members(xtx: np.ndarray, xty: np.ndarray, yty: float, n: int, ridge: np.ndarray, maybe: np.ndarray, strength: float) -> np.ndarray:
    """Which of the columns ``maybe`` stay in the fit.

    The other columns are projected out. Soft thresholds leave a few columns; of these
    the weakest goes until each is larger than its own noise. Both thresholds are
    ``strength`` times the noise, widened by the number of columns and of rows (as an
    information criterion does), so that noise alone seldom brings a column.
    """
    free = np.setdiff1d(np.arange(len(xty)), maybe)
    inner = np.linalg.pinv(xtx[np.ix_(free, free)] + np.diag(ridge[free]), hermitian=True)
    through = xtx[np.ix_(maybe, free)] @ inner
    s = xtx[np.ix_(maybe, maybe)] - through @ xtx[np.ix_(free, maybe)]
    t = xty[maybe] - through @ xty[free]
    rest = yty - xty[free] @ inner @ xty[free]
    scale = np.sqrt(np.clip(np.diag(s), 0.0, None))
    whole = rest - t @ np.linalg.pinv(s, hermitian=True) @ t
    noise = np.sqrt(max(whole / max(n - len(xty), 1), 1e-12 * yty / max(n, 1)))
    bar = strength * np.sqrt(2.0 * np.log(max(len(maybe), 2)) + np.log(max(n, 2)))
    kept = np.flatnonzero(soft_descent(s, t, bar * noise * scale))
    while len(kept):
        spread = np.linalg.pinv(s[np.ix_(kept, kept)], hermitian=True)
        size = np.abs(spread @ t[kept]) / (noise * np.sqrt(np.clip(np.diag(spread), 1e-300, None)))
        weakest = int(size.argmin())
        if size[weakest] >= bar:
            break
        kept = np.delete(kept, weakest)
    return maybe[kept]


def fit_groups(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    by: Sequence[str] = (),
    penalties: Sequence[float] | float = 0.0,
    sparse: Sequence[str] = (),
    strength: float = 1.0,
) -> DataFrame:
    """Coefficients per group: ``coef`` = (constant, one per feature), ``n`` and ``sse``.

    ``penalties`` is the ridge penalty of each feature; the constant has none. The
    features named in ``sparse`` only stay where they stand out from the noise (see
    ``sparse_members``); the coefficient of one that goes is exactly 0.
    """
    k = len(features)
    maybe = np.array([i + 1 for i, f in enumerate(features) if f in set(sparse)], dtype=int)
    ridge = [float(penalties)] * k if isinstance(penalties, (int, float)) else list(penalties)
    table = moment_table(df, features, target, by)
    keys = [f"{c} {table.schema[c].dataType.simpleString()}" for c in by]

    def solve(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                if not row["n"]:
                    continue
                xtx, xty, yty, n = unpack_moments(row, k)
                penalty = np.array([0.0, *ridge])
                used = np.arange(k + 1)
                if len(maybe):
                    members = sparse_members(xtx, xty, yty, n, penalty, maybe, strength)
                    used = np.setdiff1d(used, np.setdiff1d(maybe, members))
                beta = np.zeros(k + 1)
                beta[used] = np.linalg.pinv(xtx[np.ix_(used, used)] + np.diag(penalty[used]), hermitian=True) @ xty[used]
                sse = float(yty - 2 * beta @ xty + beta @ xtx @ beta)
                rows.append((*[row[c] for c in by], n, [float(b) for b in beta], max(sse, 0.0)))
            yield pd.DataFrame(rows, columns=[*by, "n", "coef", "sse"])

    return table.mapInPandas(solve, ", ".join([*keys, "n bigint", "coef array<double>", "sse double"]))


def linear_value(features: Sequence[str], coef: str = "coef") -> Column:
    """Constant plus the weighted features."""
    value = F.col(coef)[0]
    for i, name in enumerate(features):
        value = value + F.col(coef)[i + 1] * F.col(name).cast("double")
    return value


def apply_groups(
    df: DataFrame, coefficients: DataFrame, features: Sequence[str], by: Sequence[str] = (), name: str = "prediction"
) -> DataFrame:
    """Prediction of each row from the coefficients of its group, NULL for an unknown group."""
    if by:
        joined = df.join(coefficients.select(*by, "coef"), list(by), "left")
    else:
        joined = df.withColumn("coef", coefficients.select("coef").scalar())
    return joined.withColumn(name, linear_value(features)).drop("coef")


def coefficient_table(coefficients: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per group and term, largest absolute weight first."""
    names = F.array(F.lit("intercept"), *[F.lit(f) for f in features])
    return coefficients.select(*by, F.explode(F.arrays_zip(names.alias("term"), F.col("coef").alias("weight"))).alias("t")).select(
        *by, F.col("t.term").alias("term"), F.col("t.weight").alias("weight")
    ).orderBy(*by, F.abs("weight").desc(), "term")
