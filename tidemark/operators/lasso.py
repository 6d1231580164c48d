"""Lasso by coordinate descent on co-moments.

One aggregation gives the co-moments of every (key, block) of rows; the fit of a key, of all penalties of its path and of
all cross-validation folds needs nothing else: a fold's training moments are the key's less one block's, and its
validation error is a quadratic form in the block's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.linear import _moments
from tidemark.operators.windows import over

#: Sweeps of coordinate descent end when no weight moves by more than this part of the largest
TOLERANCE, SWEEPS = 1e-11, 100_000


def contiguous_blocks(folds: int, by=("symbol",), order: str = "pos") -> Column:
    """Blocks 0.. of consecutive rows; the first ``n % folds`` of them hold one row more."""
    w = over(by, (order,))
    i, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy(*by))
    size, more = F.floor(n / folds), n % folds
    return F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / F.greatest(size, F.lit(1)))).cast("int")


class Moments:
    """n, sums and cross sums of x1..xk, y."""

    def __init__(self, n: float, s: np.ndarray, c: np.ndarray):
        self.n, self.s, self.c = n, s, c

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.s + other.s, self.c + other.c)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.s - other.s, self.c - other.c)

    def centred(self) -> np.ndarray:
        """Population covariances of features and target."""
        return self.c / self.n - np.outer(self.s, self.s) / self.n**2

    def error(self, w: np.ndarray, base: float) -> float:
        """Mean squared error of ``base + x w``."""
        v = np.append(-w, 1.0)
        return float((v @ self.c @ v - 2 * base * (v @ self.s)) / self.n + base**2)


def descend(cov: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Weights for each penalty, largest first, each begun at the one before: minimises half the mean squared error plus alpha times the absolute weights."""
    k = len(cov) - 1
    g, t, w = cov[:k, :k], cov[:k, k], np.zeros(k)
    out = []
    for a in alphas:
        for _ in range(SWEEPS):
            most = 0.0
            for j in range(k):
                if g[j, j] <= 0:
                    continue
                r = t[j] - g[j] @ w + g[j, j] * w[j]
                new = np.sign(r) * max(abs(r) - a, 0.0) / g[j, j]
                most, w[j] = max(most, abs(new - w[j])), new
            if most <= TOLERANCE * max(np.abs(w).max(), 1e-300):
                break
        out.append(w.copy())
    return np.array(out)


def lasso(df: DataFrame, xs: list[str], y: str, by: list[str], ratios: list[float], folds: int = 5, order: str = "pos") -> DataFrame:
    """A row per key and penalty: alpha, cv_error, chosen, intercept and ``beta_{x}``.

    Penalties are ``ratios`` (falling) of the smallest one that leaves no feature in. cv_error is the mean over ``folds`` blocks of
    consecutive rows of the squared error on a block of the fit on the others; the penalty with the least is chosen, the larger
    one on a tie. Features are taken as they are; standardise them before. Rows with a null take no part, keys with
    fewer than two rows a block are left out.
    """
    full = df.na.drop("any", subset=[*xs, y]).withColumn("__b", contiguous_blocks(folds, by, order))
    m = _moments(xs, y)
    per = full.groupBy(*by, "__b").agg(*[e.cast("double").alias(f"__{n}") for n, e in m.items()])
    names = [f"__{n}" for n in m]
    one = per.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__b", *names))).alias("blocks"))
    q = len(xs) + 1
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema)
    out = ["alpha", "cv_error", "chosen", "intercept", *[f"beta_{x}" for x in xs]]

    def moments(b: dict) -> Moments:
        c = np.zeros((q, q))
        for i in range(q):
            for j in range(i, q):
                c[i, j] = c[j, i] = b[f"__s{i}_{j}"]
        return Moments(b["__n"], np.array([b[f"__s{i}"] for i in range(q)]), c)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                blocks = [moments(b if isinstance(b, dict) else b.asDict()) for b in row["blocks"]]
                if len(blocks) < folds or min(b.n for b in blocks) < 2:
                    continue
                total = sum(blocks[1:], blocks[0])
                cov = total.centred()
                alphas = np.abs(cov[:-1, -1]).max() * np.array(ratios)
                w = descend(cov, alphas)
                errors = []
                for b in blocks:
                    rest = total - b
                    v = descend(rest.centred(), alphas)
                    base = (rest.s[-1] - v @ rest.s[:-1]) / rest.n
                    errors.append([b.error(x, z) for x, z in zip(v, base)])
                cv = np.mean(errors, axis=0)
                chosen = np.arange(len(alphas)) == np.argmin(np.round(cv, 15))
                icpt = (total.s[-1] - w @ total.s[:-1]) / total.n
                got = pd.DataFrame(np.column_stack([alphas, cv, chosen, icpt, w]), columns=out)
                yield got.assign(chosen=chosen, **{c: row[c] for c in by})

    kinds = ", ".join(f"{c} {'boolean' if c == 'chosen' else 'double'}" for c in out)
    return one.mapInPandas(fit, f"{keys}, {kinds}")
