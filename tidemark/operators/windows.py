"""Rolling, expanding and shifted statistics per series.

Spark re-aggregates a sliding frame for every row (O(n*k)). Means, deviations
and co-moments are therefore taken from running sums and a ``lag`` of them, so a
252-row z-score costs the same per row as a 5-row one. Values are shifted by
the series' first value before squaring to keep the differences well conditioned.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import col, nz, with_rounded

BY, ORDER = ("symbol",), ("ts",)


def over(by=BY, order=ORDER):
    return Window.partitionBy(*by).orderBy(*order)


def upto(by=BY, order=ORDER):
    return over(by, order).rowsBetween(Window.unboundedPreceding, 0)


def trailing(k: int, by=BY, order=ORDER):
    return over(by, order).rowsBetween(-(k - 1), 0)


def with_rolling(df: DataFrame, specs: dict[str, tuple], by=BY, order=ORDER) -> DataFrame:
    """Add ``{name}_n``, ``{name}_mean``, ``{name}_std`` for ``{name: (expr, k)}``.

    Mean and std are NULL until the window holds k non-null rows; std is the
    sample deviation.
    """
    w, run = over(by, order), upto(by, order)
    names = list(specs)
    keep = df.columns
    df = df.withColumns({f"__x_{n}": col(specs[n][0]) for n in names})
    df = df.withColumns({f"__0_{n}": F.first(f"__x_{n}", ignorenulls=True).over(run) for n in names})
    df = df.withColumns({f"__d_{n}": F.coalesce(F.col(f"__x_{n}") - F.col(f"__0_{n}"), F.lit(0.0)) for n in names})
    sums = {}
    for n in names:
        sums[f"__c_{n}"] = F.count(f"__x_{n}").over(run)
        sums[f"__s_{n}"] = F.sum(f"__d_{n}").over(run)
        sums[f"__q_{n}"] = F.sum(F.col(f"__d_{n}") * F.col(f"__d_{n}")).over(run)
    df = df.withColumns(sums)
    diff = {
        f"__w{p}_{n}": F.col(f"__{p}_{n}") - F.coalesce(F.lag(f"__{p}_{n}", specs[n][1]).over(w), F.lit(0))
        for n in names
        for p in "csq"
    }
    df = df.withColumns(diff)
    out = []
    for n in names:
        k = specs[n][1]
        c, s, q = (F.col(f"__w{p}_{n}") for p in "csq")
        full = c == k
        var = (q - s * s / k) / (k - 1) if k > 1 else F.lit(None).cast("double")
        var = F.when(var > 1e-13 * (q / k), var).otherwise(F.lit(0.0))
        out += [
            c.alias(f"{n}_n"),
            F.when(full, F.col(f"__0_{n}") + s / k).alias(f"{n}_mean"),
            F.when(full, F.sqrt(var)).alias(f"{n}_std"),
        ]
    return df.select(*keep, *out)


def with_zscore(df: DataFrame, specs: dict[str, tuple], by=BY, order=ORDER, digits: int = 6) -> DataFrame:
    """Add rolling z-scores ``{name: (expr, k)}``, rounded so that thresholds are stable."""
    tmp = df.withColumns({f"__v_{n}": col(e) for n, (e, _) in specs.items()})
    tmp = with_rolling(tmp, {f"__r_{n}": (f"__v_{n}", k) for n, (_, k) in specs.items()}, by, order)
    z = {
        n: ((F.col(f"__v_{n}") - F.col(f"__r_{n}_mean")) / F.nullif(F.col(f"__r_{n}_std"), F.lit(0.0)), digits)
        for n in specs
    }
    return with_rounded(tmp, z).select(*df.columns, *specs)


def with_rolling_pair(df: DataFrame, x, y, k: int, by=BY, order=ORDER) -> DataFrame:
    """Add rolling ``corr`` and ``beta`` (of y on x) over k rows with both values present."""
    w, run = over(by, order), upto(by, order)
    keep = df.columns
    both = col(x).isNotNull() & col(y).isNotNull()
    df = df.withColumn("__x", F.when(both, col(x))).withColumn("__y", F.when(both, col(y)))
    df = df.withColumns(
        {
            "__x": F.col("__x") - F.first("__x", True).over(run),
            "__y": F.col("__y") - F.first("__y", True).over(run),
        }
    )
    m = {
        "c": F.count("__x"),
        "x": F.sum("__x"),
        "y": F.sum("__y"),
        "xx": F.sum(F.col("__x") * F.col("__x")),
        "yy": F.sum(F.col("__y") * F.col("__y")),
        "xy": F.sum(F.col("__x") * F.col("__y")),
    }
    df = df.withColumns({f"__{a}s": F.coalesce(e.over(run), F.lit(0)) for a, e in m.items()})
    df = df.withColumns({f"__{a}w": F.col(f"__{a}s") - F.coalesce(F.lag(f"__{a}s", k).over(w), F.lit(0)) for a in m})
    c, sx, sy, xx, yy, xy = (F.col(f"__{a}w") for a in m)
    cov, vx, vy = xy - sx * sy / nz(c), xx - sx * sx / nz(c), yy - sy * sy / nz(c)
    full = (c == k) & (vx > 0) & (vy > 0)
    return df.select(
        *keep,
        F.when(full, cov / F.sqrt(vx * vy)).alias("corr"),
        F.when(full, cov / vx).alias("beta"),
    )


def pct_change(x, n: int = 1, by=BY, order=ORDER) -> Column:
    x = col(x)
    return x / F.lag(x, n).over(over(by, order)) - 1


def filled(x, by=BY, order=ORDER) -> Column:
    return F.last(col(x), ignorenulls=True).over(upto(by, order))


def rising(flag, by=BY, order=ORDER) -> Column:
    """True on the first row of a TRUE run (a missing predecessor counts as FALSE)."""
    f = F.coalesce(col(flag), F.lit(False))
    return f & ~F.coalesce(F.lag(f).over(over(by, order)), F.lit(False))


def falling(flag, by=BY, order=ORDER) -> Column:
    f = F.coalesce(col(flag), F.lit(False))
    return ~f & F.coalesce(F.lag(f).over(over(by, order)), F.lit(False))


def forward_return(x, h: int, by=BY, order=ORDER) -> Column:
    x = col(x)
    return F.lead(x, h).over(over(by, order)) / x - 1


def forward_drawdown(
    x, lo: int, hi: int, min_count: int = 1, require_full: bool = False, by=BY, order=ORDER
) -> Column:
    """Worst drop from the running peak over rows ``lo..hi`` ahead of the current one.

    The frame is bounded by ``hi - lo + 1`` rows, so the array per row is too.
    """
    arr = F.collect_list(col(x)).over(over(by, order).rowsBetween(lo, hi))
    fold = F.aggregate(
        arr,
        F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("mdd")),
        lambda s, v: F.struct(
            F.greatest(s["peak"], v).alias("peak"),
            F.least(s["mdd"], v / F.greatest(s["peak"], v) - 1).alias("mdd"),
        ),
        lambda s: s["mdd"],
    )
    need = (hi - lo + 1) if require_full else min_count
    return F.when(F.size(arr) >= need, fold)


def with_forward_drawdown(df: DataFrame, name: str, value: str, lo: int, hi: int, min_count: int = 1, by=BY, order=ORDER) -> DataFrame:
    """Adds ``name``: ``forward_drawdown`` of positive values, bit for bit, without an array for each row.

    The frame is cut into runs of about the root of its length. One window makes the run that starts at each row, one more puts the
    runs of a frame together, so a row costs twice that root.
    """
    w = over(by, order)
    k = max(1, math.isqrt(hi - lo + 1))
    whole = (hi - lo + 1) // k

    def joined(runs: list[dict]) -> dict:
        top = lambda n: F.greatest(*[r["high"] for r in runs[:n]]) if n > 1 else runs[0]["high"]
        drops = [r["low"] / top(j) - 1 for j, r in enumerate(runs) if j]
        low = F.least(*[r["low"] for r in runs]) if len(runs) > 1 else runs[0]["low"]
        return {"high": top(len(runs)), "low": low, "drop": F.least(F.lit(0.0), *[r["drop"] for r in runs], *drops), "n": reduce(add, [r["n"] for r in runs])}

    def single(v: Column) -> dict:
        return {"high": v, "low": v, "drop": F.lit(0.0), "n": v.isNotNull().cast("int")}

    def ahead(c: str, rows: int) -> Column:
        return F.lead(c, rows).over(w) if rows else F.col(c)

    runs = df.withColumns({f"__run_{p}": c for p, c in joined([single(ahead(value, j)) for j in range(k)]).items()})
    parts = [{p: ahead(f"__run_{p}", lo + k * i) for p in ("high", "low", "drop", "n")} for i in range(whole)]
    for p in parts:
        p["n"] = F.coalesce(p["n"], F.lit(0))
    all_ = joined([*parts, *[single(ahead(value, j)) for j in range(lo + k * whole, hi + 1)]])
    return runs.withColumn(name, F.when(all_["n"] >= min_count, all_["drop"])).select(*df.columns, name)


def forward_drawdowns(df: DataFrame, value: str, horizons: list[int], by=BY, order=ORDER) -> DataFrame:
    """Adds ``mdd{h}``: worst drop from the running peak over the current row and the h after it, NULL where rows are missing.

    A run of rows is (highest, lowest, worst drop), and two runs in a row make one: the drop from the first's peak to the second's
    low may be the worst. Runs of 1, 2, 4, ... rows cover every horizon in log(h) steps a row, where a frame would hold h values.
    """
    w = over(by, order)

    def merged(a: Column, b: Column) -> Column:
        drop = F.least(a["dd"], b["dd"], b["low"] / a["high"] - 1)
        return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.greatest(a["high"], b["high"]).alias("high"), F.least(a["low"], b["low"]).alias("low"), drop.alias("dd")))

    v = F.col(value)
    d = df.withColumn("__b0", F.when(v.isNotNull(), F.struct(v.alias("high"), v.alias("low"), F.lit(0.0).alias("dd"))))
    for k in range(1, max(h + 1 for h in horizons).bit_length()):
        d = d.withColumn("__n", F.lead(f"__b{k - 1}", 1 << (k - 1)).over(w)).withColumn(f"__b{k}", merged(F.col(f"__b{k - 1}"), F.col("__n")))
    for h in horizons:
        at = 0
        for k in [k for k in range((h + 1).bit_length()) if (h + 1) >> k & 1]:
            d = d.withColumn("__n", F.lead(f"__b{k}", at).over(w) if at else F.col(f"__b{k}"))
            d = d.withColumn("__a", merged(F.col("__a"), F.col("__n")) if at else F.col("__n"))
            at += 1 << k
        d = d.withColumn(f"mdd{h}", F.col("__a.dd"))
    return d.select(*df.columns, *[f"mdd{h}" for h in horizons])


def rolling_percent_rank(x, k: int, by=BY, order=ORDER) -> Column:
    """Average-rank percentile of the current value within its trailing k rows."""
    x = col(x)
    w = trailing(k, by, order)
    arr = F.collect_list(x).over(w)
    less = F.size(F.filter(arr, lambda v: v < x))
    same = F.size(F.filter(arr, lambda v: v == x))
    return F.when(F.size(arr) == k, (less + (same + 1) / 2) / k)
