"""Aggregate expressions that Spark lacks in the convention needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import TRADING_DAYS, col, nz


def skew_corrected(x) -> Column:
    n = F.count(x).cast("double")
    return F.sqrt(n * (n - 1)) / nz(n - 2) * F.skewness(x)


def kurtosis_corrected(x) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / nz((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def compounded(r) -> Column:
    return F.product(1 + col(r)) - 1


def share(cond: Column) -> Column:
    return F.avg(cond.cast("int"))


def prob(hit: Column, given: Column) -> Column:
    """P(hit | given); NULL if the condition never holds."""
    return F.avg(F.when(given, hit.cast("int")))


def sharpe(r, periods: int = TRADING_DAYS, population: bool = False) -> Column:
    sd = (F.stddev_pop if population else F.stddev_samp)(r)
    return F.coalesce(F.avg(r) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(periods)), F.lit(0.0))


def sortino(r) -> Column:
    """Denominator over negative days only; 1e-10 where there are none."""
    r = col(r)
    down = F.coalesce(F.sqrt(F.avg(F.when(r < 0, r * r))), F.lit(1e-10))
    return F.avg(r) / down * F.sqrt(F.lit(TRADING_DAYS))


def omega(r) -> Column:
    r = col(r)
    return F.sum(F.when(r > 0, r)) / F.nullif(F.abs(F.sum(F.when(r < 0, r))), F.lit(0.0))


def average_rank(df: DataFrame, x: str, by: list[str], name: str) -> DataFrame:
    """Rank with ties averaged, per group."""
    w = Window.partitionBy(*by).orderBy(x)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return df.withColumn(name, F.rank().over(w) + (ties - 1) / 2)


def confusion(pred: Column, actual: Column) -> list[Column]:
    return [
        F.count_if(pred & actual).alias("tp"),
        F.count_if(pred & ~actual).alias("fp"),
        F.count_if(~pred & actual).alias("fn"),
        F.count_if(~pred & ~actual).alias("tn"),
    ]


def classification_scores(df: DataFrame, digits: int = 6) -> DataFrame:
    """Scores from tp/fp/fn/tn; every zero division gives 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    rec, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    prec = ratio(tp, tp + fp)
    scores = {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "balanced": (rec + spec) / 2,
        "precision": prec,
        "precision_neg": ratio(tn, tn + fn),
        "recall": rec,
        "recall_neg": spec,
        "f1": ratio(2 * prec * rec, prec + rec),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
    }
    return df.withColumns({k: F.round(v, digits) for k, v in scores.items()})
