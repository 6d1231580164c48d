"""Resampling, permutation and two-sample tests as partitioned joins.

Draws are pure functions of (seed, replicate, index), so a lost task replays
the same numbers. Replicates are never materialised as series: a block's
moments come from prefix sums, and each replicate only adds up looked-up blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions.expr import TRADING_DAYS, nz
from tidemark.session import spread


def with_draw(df: DataFrame, name: str, keys: list, n) -> DataFrame:
    """Add a uniform integer draw in ``[0, n)`` determined by the keys (see ``expr.draw``)."""
    p = F.lit(2147483647).cast("long")
    keep = df.columns
    h = F.lit(0).cast("long")
    for i, k in enumerate(keys):
        k = F.lit(k) if isinstance(k, int) else F.col(k)
        df = df.withColumn(f"__x{i}", (h + k.cast("long") * 1000003 + 7919 * (i + 1)) % p)
        df = df.withColumn(f"__y{i}", (F.col(f"__x{i}") * F.col(f"__x{i}")) % p)
        df = df.withColumn(f"__h{i}", (((F.col(f"__y{i}") * F.col(f"__y{i}")) % p) * F.col(f"__x{i}")) % p)
        h = F.col(f"__h{i}")
    return df.select(*keep, (h % n).alias(name))


def replicates(keys: DataFrame, by: list[str], reps: int, slices: int = 64) -> DataFrame:
    """(key, rep) rows spread over the cluster before anything per-draw happens."""
    r = keys.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    r = spread(r, *by, "__s")
    reps_of_slice = F.sequence(F.col("__s"), F.lit(reps - 1), F.lit(slices))
    return r.where(F.col("__s") < reps).withColumn("rep", F.explode(reps_of_slice)).drop("__s")


def _hashes(seed: int, reps: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The numbers below 2^31 - 1 that ``with_draw`` takes modulo n, for a reps-by-k matrix of keys (seed, rep, k)."""
    p, h = np.int64(2147483647), np.int64(0)
    for i, key in enumerate((np.int64(seed), reps[:, None].astype(np.int64), k[None, :].astype(np.int64))):
        x = (h + key * 1000003 + 7919 * (i + 1)) % p
        y = (x * x) % p
        h = (((y * y) % p) * x) % p
    return h


def _draws(seed: int, reps: np.ndarray, k: np.ndarray, n: int) -> np.ndarray:
    """Same numbers as ``with_draw`` with keys (seed, rep, k), for a reps-by-k matrix."""
    return _hashes(seed, reps, k) % n


#: Replicates that a kernel is given at once
BATCH = 256


def block_bootstrap(
    df: DataFrame, by: list[str], blocks: list[int], values: dict[str, Column], reps: int, seed: int = 42, order: str = "pos", slices: int = 16
) -> DataFrame:
    """Moving-block bootstrap: per (key, b, rep) the resampled sum of every value.

    n // b + 1 overlapping blocks are drawn with replacement and the last one is
    cut to n mod b rows; all values share the picks. A series (one row per day)
    travels once per slice of replicates; a replicate is a handful of look-ups in
    prefix sums, so neither draws nor resampled rows are ever shuffled.
    """
    d = df.select(*by, order, *[v.cast("double").alias(k) for k, v in values.items()])
    arr = d.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("rows"))
    arr = arr.select(*by, *[F.col(f"rows.{k}").alias(k) for k in values])
    arr = arr.withColumn("b", F.explode(F.array(*[F.lit(b) for b in blocks]))).where(F.size(next(iter(values))) >= F.col("b"))
    arr = spread(arr.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))), *by, "b", "slice")
    names = list(values)

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                x = np.column_stack([np.asarray(row[k], dtype=float) for k in names])
                n, b = len(x), row["b"]
                prefix = np.vstack([np.zeros(x.shape[1]), np.cumsum(x, axis=0)])
                rep = np.arange(row["slice"], reps, slices)
                length = np.full(n // b + 1, b)
                length[-1] = n % b
                start = _draws(seed, rep, np.arange(len(length)), n - b + 1)
                total = (prefix[start + length] - prefix[start]).sum(axis=1)
                yield pd.DataFrame(total, columns=names).assign(**{c: row[c] for c in by}, b=b, rep=rep, n=n)

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema)
    return arr.mapInPandas(resample, f"{keys}, b int, rep int, n int, " + ", ".join(f"{k} double" for k in names))


def per_replicate(df: DataFrame, by: list[str], columns: dict[str, Column], reps: int | None, kernel, out: list[str], order: str = "pos", slices: int = 64, totals: dict[str, Column] | None = None) -> DataFrame:
    """(key, totals, rep, out): ``kernel(arrays, reps)`` on every slice of replicates of every series.

    A series (one row per day) travels as arrays once for each slice; missing values
    are NaN. Replicates are index arithmetic on those arrays, so no replicate's rows are joined or shuffled.
    Without ``reps`` every row of a series is a replicate. A slice holds at least one batch of replicates, so that a few replicates
    of very many series do not multiply what travels. ``totals`` are aggregates of a series that go along with each replicate.
    """
    step = min(slices, -(-reps // BATCH)) if reps else slices
    totals = totals or {}
    d = df.select(*by, order, *[v.cast("double").alias(k) for k, v in columns.items()])
    arr = d.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"), *[v.alias(k) for k, v in totals.items()])
    arr = arr.select(*by, *totals, *[F.col(f"rows.{k}").alias(k) for k in columns])
    arr = spread(arr.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(step - 1)))), *by, "slice")
    names, along = list(columns), [*by, *totals]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: list[tuple] = []
            for at, row in enumerate(pdf.to_dict("records")):
                x = {k: np.asarray(row[k], dtype=float) for k in names}
                every = np.arange(row["slice"], reps or len(row[names[0]]), step)
                for i in range(0, len(every), BATCH):
                    rep = every[i : i + BATCH]
                    got = kernel(x, rep)
                    if got is not None:
                        held.append((at, rep[: len(got)], got))
                    if len(held) == BATCH:
                        yield together(pdf, held)
                        held = []
            if held:
                yield together(pdf, held)

    def together(pdf: pd.DataFrame, held: list[tuple]) -> pd.DataFrame:
        """One frame of many kernel results, each next to its series' keys and totals."""
        keys = pdf[along].iloc[np.repeat([at for at, _, _ in held], [len(rep) for _, rep, _ in held])].reset_index(drop=True)
        return keys.assign(rep=np.concatenate([rep for _, rep, _ in held]), **dict(zip(out, np.concatenate([got for _, _, got in held]).T)))

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in arr.select(*along).schema)
    return arr.mapInPandas(run, f"{keys}, rep int, " + ", ".join(f"{k} double" for k in out))


def mean_difference(seed: int):
    """Rows drawn with replacement from the pooled series; ``late`` flags give the size of the second group.

    A draw depends on the series by its length only: the numbers before the division are kept for the replicates of a task's slice
    and the longest series met, which the calendar bounds.
    """
    kept: dict[tuple, np.ndarray] = {}

    def hashes(rep: np.ndarray, n: int) -> np.ndarray:
        key = (int(rep[0]), int(rep[-1]), len(rep))
        if key not in kept or kept[key].shape[1] < n:
            kept[key] = _hashes(seed, rep, np.arange(n)).astype(np.uint32)
        return kept[key][:, :n]

    def kernel(x: dict, rep: np.ndarray) -> np.ndarray:
        r, n0 = x["r"], int((x["late"] == 0).sum())
        if not 0 < n0 < len(r):
            return np.full((len(rep), 1), np.nan)
        h, n = hashes(rep, len(r)), np.uint32(len(r))
        v = r[h - h // n * n]  # h % n; numpy divides by a constant several times faster
        return (v[:, n0:].mean(axis=1) - v[:, :n0].mean(axis=1))[:, None]

    return kernel


def spaced_dates(seed: int, gap: int, tries: int, tail: int):
    """Greedy acceptance of dates at least ``gap`` rows apart; a replicate that does not find enough in ``tries`` draws is NaN."""

    def kernel(x: dict, rep: np.ndarray) -> np.ndarray | None:
        f, m, n = x["f"], int(x["event"].sum()), len(x["f"]) - tail
        if not m or n <= 0:
            return None
        draws = _draws(seed, rep, np.arange(tries), n)
        taken, count = np.full((len(rep), m), -(10**9)), np.zeros(len(rep), dtype=np.int64)
        for k in range(tries):
            c = draws[:, k]
            fits = (count < m) & (np.abs(taken - c[:, None]) >= gap).all(axis=1)
            taken[fits, count[fits]] = c[fits]
            count += fits
        full = count == m
        value = np.full(len(rep), np.nan)
        value[full] = np.nanmean(f[taken[full]], axis=1)
        return np.column_stack([value, full.astype(float)])

    return kernel


def shifted_events(seed: int, tail: int):
    """All events moved together to a drawn start, with their distances kept."""

    def kernel(x: dict, rep: np.ndarray) -> np.ndarray | None:
        at = np.flatnonzero(x["event"] > 0)
        if not len(at):
            return None
        free = len(x["f"]) - int(at[-1] - at[0]) - tail
        if free <= 0:
            return None
        start = _draw_one(seed, rep, free)
        return np.nanmean(x["f"][start[:, None] + (at - at[0])[None, :]], axis=1)[:, None]

    return kernel


def shifted_fit(seed: int, edge: int):
    """R squared of the target on the feature rotated by a drawn shift."""

    def kernel(x: dict, rep: np.ndarray) -> np.ndarray | None:
        z, f, n = x["z"], x["f"], len(x["z"])
        if n <= 2 * edge:
            return None
        shift = edge + _draw_one(seed, rep, n - 2 * edge)
        y = f[(np.arange(n)[None, :] + shift[:, None]) % n]
        z0, y0 = z - z.mean(), y - y.mean(axis=1, keepdims=True)
        return ((y0 @ z0) ** 2 / ((z0 @ z0) * (y0 * y0).sum(axis=1)))[:, None]

    return kernel


def walk_forward_error(z: np.ndarray, y: np.ndarray, first: int, lag: int) -> np.ndarray:
    """Out-of-sample R squared of an expanding regression, refitted every row from moments of rows at least ``lag`` older."""
    zc = z - z[:first].mean()
    run = lambda v: np.cumsum(v, axis=-1)
    n = np.arange(1, len(z) + 1)
    sz, szz, sy, szy = run(zc), run(zc * zc), run(y), run(y * zc)
    i = np.arange(first, len(z))
    k = i - lag
    var = szz[k] - sz[k] ** 2 / n[k]
    slope = (szy[:, k] - sz[k] * sy[:, k] / n[k]) / var
    mean = sy[:, k] / n[k]
    predicted = mean + slope * (zc[i] - sz[k] / n[k])
    return 1 - ((y[:, i] - predicted) ** 2).sum(axis=1) / ((y[:, i] - mean) ** 2).sum(axis=1)


def shifted_walk_forward(seed: int, edge: int, first: int, lag: int):
    """The whole expanding walk-forward refitted for every rotation of the target; the real order's value goes along."""

    def kernel(x: dict, rep: np.ndarray) -> np.ndarray | None:
        z, f, n = x["z"], x["f"], len(x["z"])
        if n <= max(2 * edge, first + 1):
            return None
        shift = edge + _draw_one(seed, rep, n - 2 * edge)
        y = f[(np.arange(n)[None, :] + shift[:, None]) % n]
        real = walk_forward_error(z, f[None, :], first, lag)
        return np.column_stack([walk_forward_error(z, y, first, lag), np.repeat(real, len(rep))])

    return kernel


def _scramble(v: np.ndarray) -> np.ndarray:
    """A number below 2^31 - 1 from another one below 2^31; the arithmetic of ``with_draw``."""
    p = np.int64(2147483647)
    x = (v * 1000003 + 7919) % p
    y = (x * x) % p
    return (((y * y) % p) * x) % p


def permuted(seed: int, reps: np.ndarray, n: int) -> np.ndarray:
    """A permutation of ``0..n-1`` for each replicate, as a reps-by-n matrix, without sorting.

    Four Feistel rounds are a bijection on ``2^(2 half)`` numbers, the least such power that holds n; a number that
    lands at n or beyond is sent on until it lands below, which keeps it a bijection.
    """
    half = max((int(n - 1).bit_length() + 1) // 2, 1)
    keys = [_scramble(_scramble(np.int64(seed * 4 + k)) + reps.astype(np.int64))[:, None] for k in range(4)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & ((1 << half) - 1)
        for key in keys:
            left, right = right, left ^ (_scramble(right + key) & ((1 << half) - 1))
        return (left << half) | right

    v = once(np.broadcast_to(np.arange(n, dtype=np.int64), (len(reps), n)))
    while (v >= n).any():
        v = np.where(v >= n, once(v), v)
    return v


def shuffled_walk_forward(seed: int, first: int, lag: int):
    """The whole expanding walk-forward refitted for every shuffle of the labels; the real order's value goes along."""

    def kernel(x: dict, rep: np.ndarray) -> np.ndarray | None:
        z, f, n = x["z"], x["f"], len(x["z"])
        if n <= first + 1:
            return None
        real = walk_forward_error(z, f[None, :], first, lag)
        return np.column_stack([walk_forward_error(z, f[permuted(seed, rep, n)], first, lag), np.repeat(real, len(rep))])

    return kernel


def split_tests(edge: int, every: int):
    """Median-centred Levene and Kolmogorov-Smirnov statistics of the rows before and from each split."""

    def kernel(x: dict, rep: np.ndarray) -> np.ndarray | None:
        r = x["x"]
        n = len(r)
        k = rep[(rep >= edge) & (n - rep >= edge) & (rep % every == 0)]
        order = np.argsort(r, kind="stable")
        last = np.append(np.diff(r[order]) != 0, True)
        out = np.full((len(rep), 3), np.nan)
        for j in k:
            before = np.cumsum(order < j)[last]
            rows = np.flatnonzero(last) + 1
            ks = np.abs(before / j - (rows - before) / (n - j)).max()
            d = [np.abs(side - np.median(side)) for side in (r[:j], r[j:])]
            mu, size = np.array([v.mean() for v in d]), np.array([j, n - j])
            between = (size * mu * mu).sum() - (size * mu).sum() ** 2 / n
            out[np.searchsorted(rep, j)] = (j, (n - 2) * between / (size * np.array([v.var() for v in d])).sum(), ks)
        return out

    return kernel


def _draw_one(seed: int, reps: np.ndarray, n: int) -> np.ndarray:
    """Same numbers as ``with_draw`` with keys (seed, rep)."""
    p, h = np.int64(2147483647), np.int64(0)
    for i, key in enumerate((np.int64(seed), reps.astype(np.int64))):
        x = (h + key * 1000003 + 7919 * (i + 1)) % p
        y = (x * x) % p
        h = (((y * y) % p) * x) % p
    return h % n


def sharpe_from_sums(s: str, q: str, n: str = "n") -> Column:
    mean = F.col(s) / F.col(n)
    var = F.col(q) / F.col(n) - mean * mean
    return F.when(var > 1e-18, mean / F.sqrt(var) * (TRADING_DAYS**0.5)).otherwise(0.0)


def two_sample(df: DataFrame, by: list[str], x: str, group: Column) -> DataFrame:
    """Equal-variance t, Welch t with its degrees of freedom, and the variance-ratio F."""
    g = df.where(F.col(x).isNotNull()).withColumn("__g", group)
    side = lambda v: F.when(F.col("__g") == v, F.col(x))
    a = g.groupBy(*by).agg(
        *[e.alias(f"{n}{v}") for v in (0, 1) for n, e in (("n", F.count(side(v))), ("m", F.avg(side(v))), ("v", F.var_samp(side(v))))]
    )
    n0, n1, m0, m1, v0, v1 = (nz(c) if c[0] == "n" else F.col(c) for c in ("n0", "n1", "m0", "m1", "v0", "v1"))
    pooled = ((n0 - 1) * v0 + (n1 - 1) * v1) / nz(n0 + n1 - 2)
    se = v0 / n0 + v1 / n1
    return a.select(
        *by, "n0", "n1",
        ((m1 - m0) / nz(F.sqrt(pooled * (1 / n0 + 1 / n1)))).alias("t"), (n0 + n1 - 2).cast("double").alias("df"),
        ((m1 - m0) / nz(F.sqrt(se))).alias("welch_t"),
        (se * se / nz((v0 / n0) * (v0 / n0) / nz(n0 - 1) + (v1 / n1) * (v1 / n1) / nz(n1 - 1))).alias("welch_df"),
        (v1 / nz(v0)).alias("f_ratio"),
    )


def levene(df: DataFrame, by: list[str], x: str, group: Column) -> DataFrame:
    """Median-centred Levene statistic of two groups."""
    g = df.where(F.col(x).isNotNull()).withColumn("__g", group)
    med = g.groupBy(*by, "__g").agg(F.median(x).alias("__m"))
    d = g.join(med, [*by, "__g"]).withColumn("__d", F.abs(F.col(x) - F.col("__m")))
    per = d.groupBy(*by, "__g").agg(F.count(F.lit(1)).alias("k"), F.avg("__d").alias("mu"), F.var_pop("__d").alias("vp"))
    a = per.groupBy(*by).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("mu")).alias("s"), F.sum(F.col("k") * F.col("mu") * F.col("mu")).alias("q"), F.sum(F.col("k") * F.col("vp")).alias("within"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return a.select(*by, "n", ((F.col("n") - 2) * between / nz("within")).alias("levene"))


def kolmogorov_smirnov(df: DataFrame, by: list[str], x: str, group: Column) -> DataFrame:
    """Largest gap between the two empirical distributions; ties are merged first."""
    g = df.where(F.col(x).isNotNull()).withColumn("__g", group)
    v = g.groupBy(*by, x).agg(F.count_if(F.col("__g") == 0).alias("a"), F.count_if(F.col("__g") == 1).alias("b"))
    part = Window.partitionBy(*by)
    run = part.orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("d", F.abs(F.sum("a").over(run) / nz(F.sum("a").over(part)) - F.sum("b").over(run) / nz(F.sum("b").over(part))))
    return v.groupBy(*by).agg(F.max("d").alias("ks"), F.sum("a").alias("n0"), F.sum("b").alias("n1"))


def mann_whitney(df: DataFrame, by: list[str], x: str, group: Column) -> DataFrame:
    """U of group 1 with the tie-corrected normal score."""
    g = df.where(F.col(x).isNotNull()).withColumn("__g", group)
    v = g.groupBy(*by, x).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("__g") == 1).alias("b"))
    part = Window.partitionBy(*by)
    below = F.sum("t").over(part.orderBy(x).rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")
    v = v.withColumn("rank", below + (F.col("t") + 1) / 2)
    a = v.groupBy(*by).agg(
        F.sum("t").cast("double").alias("n"), F.sum("b").cast("double").alias("n1"), F.sum(F.col("b") * F.col("rank")).alias("r1"),
        F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"),
    )
    n, n1 = F.col("n"), F.col("n1")
    n0 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n0 * n1 / 12 * (n + 1 - F.col("ties") / nz(n * (n - 1))))
    return a.select(*by, u.alias("u"), ((u - n0 * n1 / 2) / nz(sd)).alias("score"))


def break_scan(df: DataFrame, by: list[str], x: str, edge: int, order: str = "pos") -> DataFrame:
    """t statistic of every split with at least ``edge`` rows on both sides, from prefix moments."""
    part = Window.partitionBy(*by)
    run = part.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.where(F.col(x).isNotNull()).withColumn("__c", F.col(x) - F.avg(x).over(part))
    d = d.withColumns({"k": F.count(F.lit(1)).over(run), "s": F.sum("__c").over(run), "q": F.sum(F.col("__c") * F.col("__c")).over(run)})
    d = d.withColumns({"n": F.count(F.lit(1)).over(part), "s_all": F.sum("__c").over(part), "q_all": F.sum(F.col("__c") * F.col("__c")).over(part)})
    n0, n1 = F.col("k").cast("double"), nz((F.col("n") - F.col("k")).cast("double"))
    s0, s1, q0, q1 = F.col("s"), F.col("s_all") - F.col("s"), F.col("q"), F.col("q_all") - F.col("q")
    pooled = (q0 - s0 * s0 / n0 + q1 - s1 * s1 / n1) / nz(n0 + n1 - 2)
    t = (s1 / n1 - s0 / n0) / nz(F.sqrt(pooled * (1 / n0 + 1 / n1)))
    return d.where((F.col("k") >= edge) & (F.col("n") - F.col("k") >= edge)).withColumn("t", t).drop("__c", "s", "q", "s_all", "q_all")


# p-values: the few special functions needed, on Arrow batches of statistics ----


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student p-value."""
    return pd.Series([beta_inc(d / 2, 0.5, d / (d + v * v)) if np.isfinite(v) else np.nan for v, d in zip(t, df)])


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper-tail F p-value."""
    return pd.Series([beta_inc(b / 2, a / 2, b / (b + a * v)) if np.isfinite(v) else np.nan for v, a, b in zip(f, d1, d2)])


@F.pandas_udf(DoubleType())
def normal_p_value(score: pd.Series) -> pd.Series:
    """Lower-tail normal probability."""
    return pd.Series([0.5 * math.erfc(-v / math.sqrt(2)) for v in score])


def ks_p_value(d: Column, n0: Column, n1: Column, terms: int = 40) -> Column:
    """Asymptotic two-sample Kolmogorov p-value."""
    en = F.sqrt(n0 * n1 / (n0 + n1))
    lam = (en + 0.12 + 0.11 / en) * d
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda s, j: s + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * lam * lam),
    )
    return F.least(F.greatest(2 * total, F.lit(0.0)), F.lit(1.0))
