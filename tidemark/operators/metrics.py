"""Performance metrics of return or equity paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import stats as S
from tidemark.functions.expr import TRADING_DAYS
from tidemark.operators.windows import upto


def with_equity(df: DataFrame, r: str = "sr", by=("symbol",), order="ts") -> DataFrame:
    d = df.withColumn("eq", F.product(1 + F.col(r)).over(upto(by, (order,))))
    return d.withColumn("dd", F.col("eq") / F.max("eq").over(upto(by, (order,))) - 1)


def path_metrics(df: DataFrame, r: str = "sr", by=("symbol",), order="ts", population: bool = True, periods: int = TRADING_DAYS) -> DataFrame:
    """CAGR, drawdown, Sharpe, Sortino, Calmar, Omega, hit rate and final value per key."""
    d = with_equity(df, r, by, order)
    a = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("eq", order).alias("final"), F.min("dd").alias("mdd"),
        S.sharpe(r, periods, population).alias("sharpe"), S.sortino(r).alias("sortino"), S.omega(r).alias("omega"),
        S.share(F.col(r) > 0).alias("up"), F.min(r).alias("worst"), F.max(r).alias("best"),
    )
    a = a.withColumn("cagr", F.pow("final", F.lit(float(periods)) / F.col("n")) - 1)
    return a.withColumn("calmar", F.col("cagr") / F.nullif(F.abs("mdd"), F.lit(0.0)))


def drawdown_dates(df: DataFrame, price: str, by=("symbol",), order="ts") -> DataFrame:
    """Deepest drawdown per key with peak, trough and first recovery date; ties as in ``episodes.drawdown_episodes``."""
    run = upto(by, (order,))
    d = df.withColumn("__pk", F.max(price).over(run)).withColumn("__pk_ts", F.max(F.when(F.col(price) == F.col("__pk"), F.col(order))).over(run))
    d = d.withColumn("dd", F.col(price) / F.col("__pk") - 1)
    low = d.groupBy(*by).agg(F.min("dd").alias("mdd"), F.min(F.struct("dd", F.col(order).alias("t"), "__pk", "__pk_ts")).alias("m"))
    low = low.select(*by, "mdd", F.col("m.__pk_ts").alias("peak_ts"), F.col("m.t").alias("trough_ts"), F.col("m.__pk").alias("__level"))
    back = df.join(low, list(by)).where((F.col(order) > F.col("trough_ts")) & (F.col(price) >= F.col("__level")))
    rec = back.groupBy(*by).agg(F.min(order).alias("recovery_ts"))
    return low.drop("__level").join(rec, list(by), "left")
