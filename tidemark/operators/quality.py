"""Data-quality gates and portfolio valuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checklist(df: DataFrame, by: list[str], checks: dict[str, Column]) -> DataFrame:
    """Named pass/fail assertions from one aggregation, one row per check."""
    a = df.groupBy(*by).agg(*[c.alias(n) for n, c in checks.items()])
    return a.unpivot(by, list(checks), "check", "ok")


def tolerance_gates(models: dict[str, DataFrame], by: list[str], base: str, gates: list[tuple[str, str, str, float]]) -> DataFrame:
    """(by, gate, base, other, gap, tolerance, ok): how far a metric of other models may be from the base model's.

    ``models`` hold one row of metrics per key; a gate is (name, other model, metric, tolerance). The gap must
    be smaller than the tolerance. A key that a model has no row for fails its gates with a NULL gap.
    """
    wanted = sorted({(base, m) for _, _, m, _ in gates} | {(o, m) for _, o, m, _ in gates})
    sides = [models[name].select(*by, *[F.col(m).alias(f"__{name}_{m}") for n, m in wanted if n == name]) for name in dict(wanted)]
    d = sides[0]
    for other in sides[1:]:
        d = d.join(other, by, "full")
    row = lambda g, o, m, t: F.struct(F.lit(g).alias("gate"), F.col(f"__{base}_{m}").alias("base"), F.col(f"__{o}_{m}").alias("other"), F.lit(t).alias("tolerance"))
    d = d.select(*by, F.explode(F.array(*[row(*g) for g in gates])).alias("__g")).select(*by, "__g.*")
    gap = F.abs(F.col("base") - F.col("other"))
    return d.select(*by, "gate", "base", "other", gap.alias("gap"), "tolerance", F.coalesce(gap < F.col("tolerance"), F.lit(False)).alias("ok"))


def drop_sparse(df: DataFrame, columns: list[str], most: float = 0.5) -> DataFrame:
    """Without those of ``columns`` that are null in at least ``most`` of the rows, decided by one aggregation now.

    A table without rows keeps all.
    """
    n = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if n["__n"] and n[c] / n["__n"] >= most])


def fail_if(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """Pass rows through and abort the job on the first bad one."""
    guard = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
    return df.where(guard)


def missing_expected(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present, keys, "left_anti")


def positions(trades: DataFrame, by: list[str]) -> DataFrame:
    """Units, average cost and realised profit from buys and sells (``side``, ``units``, ``price``)."""
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    g = trades.groupBy(*by).agg(
        F.sum(F.when(buy, F.col("units")).otherwise(0.0)).alias("bought"), F.sum(F.when(sell, F.col("units")).otherwise(0.0)).alias("sold"),
        F.sum(F.when(buy, F.col("units") * F.col("price")).otherwise(0.0)).alias("paid"),
        F.sum(F.when(sell, F.col("units") * F.col("price")).otherwise(0.0)).alias("received"),
    )
    basis = F.col("paid") / F.nullif(F.col("bought"), F.lit(0.0))
    return g.withColumn("units", F.col("bought") - F.col("sold")).withColumn("basis", basis).withColumn("realised", F.col("received") - F.col("sold") * F.col("basis"))
