"""Domain signals: returns, stress z-scores, path gap, momentum and feature frames."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import TRADING_DAYS, col, daily_rate_trading
from tidemark.operators.asof import asof
from tidemark.operators.windows import over, with_rolling, with_zscore
from tidemark.session import calendar_sized
from tidemark.sources import market


def with_returns(b: DataFrame) -> DataFrame:
    """Close-to-close, overnight gap and intraday return per bar."""
    prev = F.lag("close").over(over())
    return b.withColumns(
        {"r": F.col("close") / prev - 1, "gap": F.col("open") / prev - 1, "intra": F.col("close") / F.col("open") - 1}
    )


def with_stress_scores(b: DataFrame, credit_k: int = 252, vol_k: int = 252, ratio_k: int = 63, liq_k: int = 252) -> DataFrame:
    """Add z (credit), vz (volatility), iz (inflation ratio) and nlz (net liquidity).

    Computed on the full history; callers slice afterwards so that warm-up rows
    are never cut off.
    """
    b = b.withColumn("cr", (1 + F.col("disc")) / (1 + F.col("tax")))
    b = b.withColumn("inf", (1 + F.col("tax")) / (1 + F.col("qty") / (100.0 * F.col("n"))))
    b = b.withColumn("nl", 1000 + F.col("qty") - F.col("n") - F.col("disc"))
    b = b.withColumn("nlc", F.col("nl") / F.lag("nl", 63).over(over()) - 1)
    b = with_rolling(b, {"rv": ("r", 20)}).withColumn("vol", F.col("rv_std") * F.sqrt(F.lit(TRADING_DAYS)))
    b = with_zscore(b, {"z": ("cr", credit_k), "vz": ("vol", vol_k), "iz": ("inf", ratio_k), "nlz": ("nlc", liq_k)})
    return b.withColumn("z", -F.col("z")).drop("rv_n", "rv_mean", "rv_std", "cr", "inf", "nl", "nlc")


def sma(x, k: int, name: str, df: DataFrame) -> DataFrame:
    return with_rolling(df, {name: (col(x), k)}).drop(f"{name}_n", f"{name}_std").withColumnRenamed(f"{name}_mean", name)


_SHARED: dict[tuple, DataFrame] = {}


def shared(spark, name: str, sf_dir: str, build) -> DataFrame:
    """Build a day-grain table once per session and persist it.

    Every replay, sweep and study reads the same signals; blocks lost with an
    executor are recomputed from lineage.
    """
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _SHARED:
        _SHARED[key] = build().persist(StorageLevel.MEMORY_AND_DISK)
    return _SHARED[key]


def release() -> None:
    """Drop all shared tables; the next query builds its own again."""
    for df in _SHARED.values():
        df.unpersist(blocking=True)
    _SHARED.clear()


def signal_frame(spark, sf_dir: str, by: str = "flag", reused: bool = True) -> DataFrame:
    """``reused=False`` for a query that reads a frame of very many series once: it is not stored, and only the columns it needs are built."""
    if not reused:
        return build_signal_frame(spark, sf_dir, by)
    return shared(spark, f"signals-{by}", sf_dir, lambda: build_signal_frame(spark, sf_dir, by))


def build_signal_frame(spark, sf_dir: str, by: str = "flag") -> DataFrame:
    """symbol, ts, pos, close, r, gap, intra, rate, z, vz, iz, nlz, master."""
    from tidemark.operators.projections import alternating_signals, daily_state, with_previous

    b = with_stress_scores(with_returns(market.bars(spark, sf_dir, by)))
    b = b.withColumn("series_id", market.series_of_symbol())
    cal = market.calendar(spark, sf_dir)
    # the rate is resolved once per (series, calendar day); bars of any number of symbols meet it by key
    days = cal.select("ts", F.explode(F.array(*[F.lit(s) for s in market.RATE_SERIES])).alias("series_id"))
    rates = asof(days, market.observations(spark, sf_dir), ["series_id"], "ts", ["value"])
    b = b.join(calendar_sized(rates), ["series_id", "ts"]).withColumn("rate", daily_rate_trading(F.coalesce("value", F.lit(0.0))))
    sig = alternating_signals(with_previous(market.projections(spark, sf_dir)))
    state = daily_state(sig, cal.select("ts"))
    keep = ["symbol", "ts", "pos", "close", "r", "gap", "intra", "rate", "z", "vz", "iz", "nlz"]
    return b.select(*keep).join(calendar_sized(state.select("ts", "master")), "ts")
