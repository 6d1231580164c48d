"""Bars, observations and the signal frame themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.projections import alternating_signals, daily_state, with_previous
from tidemark.operators.signals import signal_frame, with_returns
from tidemark.plans import base_sql as B
from tidemark.plans.registry import query
from tidemark.sources import market


def day(c="ts"):
    return F.date_format(c, "yyyy-MM-dd")


@query(
    "G1 bars adaptor: adjusted open",
    B.with_(B.bars())
    + "SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, CAST(pos AS BIGINT) AS pos, open, close, round(open*adj_close/close,4) AS adj_open FROM bars",
)
def adjusted_bars(spark, sf):
    b = market.bars(spark, sf)
    return b.select(
        "symbol", day().alias("ts"), F.col("pos").cast("long"), "open", "close",
        F.round(F.col("open") * F.col("adj_close") / F.col("close"), 4).alias("adj_open"),
    )


@query(
    "G2 Q3 return reconstruction",
    B.with_(B.bars())
    + """SELECT symbol, count(*) AS n, round(max(abs((1+gap)*(1+intra)-1-r)),6) AS worst, round(avg(gap),6) AS gap, round(avg(intra),6) AS intra
    FROM (SELECT symbol, close/lag(close) OVER w-1 AS r, open/lag(close) OVER w-1 AS gap, close/open-1 AS intra FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) GROUP BY symbol""",
)
def return_reconstruction(spark, sf):
    b = with_returns(market.bars(spark, sf))
    err = F.abs((1 + F.col("gap")) * (1 + F.col("intra")) - 1 - F.col("r"))
    return b.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max(err), 6).alias("worst"),
        F.round(F.avg("gap"), 6).alias("gap"), F.round(F.avg("intra"), 6).alias("intra"),
    )


@query(
    "G9 J14 L2 D9 alternating projection signals",
    B.with_(B.PROJ)
    + "SELECT strftime(md,'%Y-%m-%d') AS meeting_date, ty AS target_year, same_ty, pce, prev_pce, rate, prev_rate, signal FROM psig",
)
def projection_signals(spark, sf):
    s = alternating_signals(with_previous(market.projections(spark, sf)))
    return s.select(day("meeting_date").alias("meeting_date"), "target_year", "same_ty", "pce", "prev_pce", "rate", "prev_rate", "signal")


@query(
    "G12 daily master state",
    B.with_(B.bars(), B.CAL, B.PROJ, B.MASTER) + "SELECT strftime(ts,'%Y-%m-%d') AS ts, CAST(master AS INT) AS master FROM mstate",
)
def projection_daily_state(spark, sf):
    cal = market.calendar(spark, sf)
    st = daily_state(alternating_signals(with_previous(market.projections(spark, sf))), cal.select("ts"))
    return st.select(day().alias("ts"), F.col("master").cast("int"))


@query(
    "G3 G4 G5 G6 G7 G8 W1 W2 W3 J5 stress scores on full history, then sliced",
    B.with_(*B.signal_frame())
    + """SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, z, vz, iz, nlz, round(rate,8) AS rate, CAST(master AS INT) AS master
    FROM sig WHERE ts BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'""",
)
def stress_scores(spark, sf):
    s = signal_frame(spark, sf).where("ts between date'1997-01-01' and date'2000-12-31'")
    return s.select(
        "symbol", day().alias("ts"), "z", "vz", "iz", "nlz",
        F.round("rate", 8).alias("rate"), F.col("master").cast("int"),
    )
