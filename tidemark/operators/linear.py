"""Least squares from co-moments.

Spark aggregates the k*k cross products (globally, per key or per rolling
window); only the tiny k-by-k systems are solved in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidemark.functions.expr import nz
from tidemark.operators.windows import over, upto


@F.pandas_udf(ArrayType(DoubleType()))
def solve(cov: pd.Series, target: pd.Series) -> pd.Series:
    """Minimum-norm solution of ``cov @ beta = target`` for flattened k*k matrices."""
    if len(cov) == 0:
        return pd.Series([], dtype=object)
    ok = np.array([c is not None and t is not None and not np.isnan(c).any() and not np.isnan(t).any() for c, t in zip(cov, target)])
    out = np.full(len(cov), None, dtype=object)
    if ok.any():
        t = np.stack(list(target[ok]))
        k = t.shape[1]
        a = np.stack(list(cov[ok])).reshape(-1, k, k)
        beta = np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=1e-12, hermitian=True), t)
        out[np.flatnonzero(ok)] = pd.Series(list(beta)).to_numpy()
    return pd.Series(out)


def _moments(xs: list[str], y: str) -> dict[str, Column]:
    cols = [*xs, y]
    m = {"n": F.count(F.lit(1))}
    m |= {f"s{i}": F.sum(c) for i, c in enumerate(cols)}
    m |= {f"s{i}_{j}": F.sum(F.col(cols[i]) * F.col(cols[j])) for i in range(len(cols)) for j in range(i, len(cols))}
    return m


def _betas(df: DataFrame, xs: list[str], keep: list[str]) -> DataFrame:
    k = len(xs)
    n = nz("__n")
    cv = lambda i, j: F.col(f"__s{min(i, j)}_{max(i, j)}") / n - F.col(f"__s{i}") / n * F.col(f"__s{j}") / n
    df = df.withColumn("__beta", solve(F.array(*[cv(i, j) for i in range(k) for j in range(k)]), F.array(*[cv(i, k) for i in range(k)])))
    explained = sum((F.col("__beta")[i] * cv(i, k) for i in range(k)), F.lit(0.0))
    icpt = F.col(f"__s{k}") / n - sum((F.col("__beta")[i] * F.col(f"__s{i}") / n for i in range(k)), F.lit(0.0))
    return df.select(
        *keep,
        F.col("__n").alias("n_obs"),
        icpt.alias("intercept"),
        *[F.col("__beta")[i].alias(f"beta_{x}") for i, x in enumerate(xs)],
        (explained / F.nullif(cv(k, k), F.lit(0.0))).alias("r2"),
    )


def ols(df: DataFrame, by: list[str], xs: list[str], y: str) -> DataFrame:
    """Intercept, betas and R2 per key from one aggregation."""
    full = df.na.drop("any", subset=[*xs, y])
    agg = full.groupBy(*by).agg(*[e.alias(f"__{n}") for n, e in _moments(xs, y).items()])
    return _betas(agg, xs, by)


def rolling_ols(df: DataFrame, xs: list[str], y: str, k: int, by=("symbol",), order=("ts",)) -> DataFrame:
    """OLS over the trailing k complete rows; one running-sum window, no refit per row."""
    full = df.na.drop("any", subset=[*xs, y])
    m = _moments(xs, y)
    full = full.withColumns({f"__r{n}": e.over(upto(by, order)) for n, e in m.items()})
    full = full.withColumns({f"__{n}": F.col(f"__r{n}") - F.coalesce(F.lag(f"__r{n}", k).over(over(by, order)), F.lit(0)) for n in m})
    return _betas(full.where(F.col("__n") == k), xs, df.columns)


@F.pandas_udf(ArrayType(DoubleType()))
def _standardised_fit(cov: pd.Series, target: pd.Series) -> pd.Series:
    """Weights of standardised features, minimum norm, from flattened covariances; a constant feature has weight 0."""
    if len(cov) == 0:
        return pd.Series([], dtype=object)
    t = np.stack(list(target))
    k = t.shape[1]
    a = np.stack(list(cov)).reshape(-1, k, k)
    sd = np.sqrt(np.maximum(np.einsum("nii->ni", a), 0))
    # what is left of a constant feature's variance is rounding
    flat = sd <= 1e-9 * np.maximum(sd.max(axis=1, keepdims=True), 1e-300)
    safe = np.where(flat, 1.0, sd)
    r = np.where(flat[:, :, None] | flat[:, None, :], 0.0, a / safe[:, :, None] / safe[:, None, :])
    w = np.einsum("nij,nj->ni", np.linalg.pinv(r, rcond=1e-10, hermitian=True), np.where(flat, 0.0, t / safe))
    return pd.Series(list(np.where(flat, 0.0, w)))


def rolling_attribution(df: DataFrame, xs: list[str], y: str, k: int, by=("symbol",), order=("ts",)) -> DataFrame:
    """Decomposition of every row's y by a regression on the k complete rows before it, standardised inside that window.

    Adds ``{x}_weight`` (of the standardised factor), ``{x}_part`` (weight times the row's own standardised factor), ``base`` (the window's
    mean of y), ``rest`` (what neither explains) and ``r2`` (inside the window). Co-moments come from running sums of values shifted by the series' first
    row, so a row costs the same whatever k is; systems of all rows are solved in batches by a symmetric pseudo-inverse, which
    gives a factor that is constant in the window, or repeats another, no say of its own. Scales of factors may differ by up to 10^9.
    """
    full = df.na.drop("any", subset=[*xs, y])
    cols = [*xs, y]
    run, w = upto(by, order), over(by, order)
    full = full.withColumns({f"__v{i}": F.col(c) - F.first(c).over(run) for i, c in enumerate(cols)})
    m = _moments([f"__v{i}" for i in range(len(xs))], f"__v{len(xs)}")
    full = full.withColumns({f"__r{n}": e.over(run) for n, e in m.items()})
    # the window ends one row before
    full = full.withColumns({f"__{n}": F.lag(f"__r{n}", 1).over(w) - F.coalesce(F.lag(f"__r{n}", k + 1).over(w), F.lit(0)) for n in m})
    full = full.where(F.col("__n") == k)
    q = len(xs)
    mean = lambda i: F.col(f"__s{i}") / k
    cv = lambda i, j: F.col(f"__s{min(i, j)}_{max(i, j)}") / k - mean(i) * mean(j)
    full = full.withColumn("__w", _standardised_fit(F.array(*[cv(i, j) for i in range(q) for j in range(q)]), F.array(*[cv(i, q) for i in range(q)])))
    sd = lambda i: F.nullif(F.sqrt(F.greatest(cv(i, i), F.lit(0.0))), F.lit(0.0))
    weight = lambda i: F.get("__w", F.lit(i))
    part = lambda i: F.when(weight(i) == 0, F.lit(0.0)).otherwise(weight(i) * (F.col(f"__v{i}") - mean(i)) / sd(i))
    explained = sum((F.when(weight(i) == 0, F.lit(0.0)).otherwise(weight(i) * cv(i, q) / sd(i)) for i in range(q)), F.lit(0.0))
    base = mean(q) + (F.col(y) - F.col(f"__v{q}"))
    rest = F.col(y) - base - sum((part(i) for i in range(q)), F.lit(0.0))
    return full.select(
        *df.columns, *[weight(i).alias(f"{x}_weight") for i, x in enumerate(xs)], *[part(i).alias(f"{x}_part") for i, x in enumerate(xs)],
        base.alias("base"), rest.alias("rest"), (explained / nz(cv(q, q))).alias("r2"),
    )
