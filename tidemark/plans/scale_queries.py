"""The same operators with one series per supplier: rows grow with the tables all the way."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.operators.fold import leverage_fold, with_layers
from tidemark.operators.signals import signal_frame
from tidemark.plans import agg_queries, inference_queries, join_queries, machine_queries
from tidemark.plans import base_sql as B
from tidemark.plans.fold_queries import LAYERS, METRICS, recursive, run_sql
from tidemark.plans.registry import ORACLE, query

SUP = B.signal_frame("supplier")
SUPX = B.with_(*SUP).rstrip() + ","


def per_supplier(name: str) -> str:
    """The SQL of a query over the named series, over one series per supplier."""
    start = B.with_(*B.signal_frame()).rstrip()
    sql = ORACLE[name]
    if not sql.startswith(start):
        raise ValueError(f"{name} does not start from the signal frame")
    return SUPX[:-1] + sql[len(start):]


@query(
    "W3 L1 E8 rolling z-scores and latches for every supplier",
    B.with_(*SUP, LAYERS) + """SELECT symbol, count(*) AS n, count(z) AS known, CAST(sum(in_credit) AS BIGINT) AS credit_days, CAST(sum(in_vol) AS BIGINT) AS vol_days, CAST(sum(in_ratio) AS BIGINT) AS ratio_days,
    CAST(sum(CAST(layer=0 AS INT)) AS BIGINT) AS out_days, round(avg(z),5) AS mean_z FROM lay GROUP BY symbol""",
)
def supplier_stress_latches(spark, sf):
    s = with_layers(signal_frame(spark, sf, "supplier", reused=False), ["symbol"])
    return s.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count("z").alias("known"), F.sum("in_credit").alias("credit_days"), F.sum("in_vol").alias("vol_days"),
        F.sum("in_ratio").alias("ratio_days"), F.count_if(F.col("layer") == 0).alias("out_days"), F.round(F.avg("z"), 5).alias("mean_z"),
    )


@query(
    "E1 leverage replay for every supplier",
    recursive(*SUP, LAYERS, run_sql(), METRICS) + "SELECT k AS symbol, CAST(n AS INT) AS n, round(final,4) AS final, round(mdd,5) AS mdd, round(sharpe,4) AS sharpe, trades FROM met",
)
def supplier_leverage_backtest(spark, sf):
    m = leverage_fold(with_layers(signal_frame(spark, sf, "supplier", reused=False), ["symbol"]), ["symbol"])
    return m.select("symbol", "n", F.round("final", 4).alias("final"), F.round("mdd", 5).alias("mdd"), F.round("sharpe", 4).alias("sharpe"), "trades")


@query(
    "W14 W15 E20 forward outcomes and mask strategy for every supplier",
    B.with_(*SUP).rstrip() + """, f AS (SELECT symbol, pos, min(c/pk-1) AS m FROM (SELECT a.symbol, a.pos, b.close AS c, max(b.close) OVER (PARTITION BY a.symbol, a.pos ORDER BY b.pos) AS pk FROM sig a JOIN sig b ON a.symbol=b.symbol AND b.pos BETWEEN a.pos+1 AND a.pos+22) GROUP BY 1,2 HAVING count(*)>=10),
    g AS (SELECT symbol, pos, lead(close,22) OVER (PARTITION BY symbol ORDER BY pos)/close-1 AS fwd, CASE WHEN coalesce(lag(z) OVER (PARTITION BY symbol ORDER BY pos)>1,FALSE) THEN 0 ELSE coalesce(r,0) END AS sr FROM sig)
    SELECT g.symbol, count(fwd) AS n, round(avg(fwd),6) AS mean_fwd, round(avg(m),6) AS mean_mdd, round(min(m),6) AS worst_mdd, round(product(1+sr)-1,5) AS masked FROM g LEFT JOIN f ON f.symbol=g.symbol AND f.pos=g.pos GROUP BY 1""",
)
def supplier_forward_outcomes(spark, sf):
    s = W.with_forward_drawdown(signal_frame(spark, sf, "supplier", reused=False), "m", "close", 1, 22, min_count=10)
    s = s.withColumns({"fwd": W.forward_return("close", 22), "flag": F.coalesce(F.lag("z").over(W.over()) > 1, F.lit(False))})
    sr = F.when(F.col("flag"), 0.0).otherwise(F.coalesce("r", F.lit(0.0)))
    return s.groupBy("symbol").agg(
        F.count("fwd").alias("n"), F.round(F.avg("fwd"), 6).alias("mean_fwd"), F.round(F.avg("m"), 6).alias("mean_mdd"), F.round(F.min("m"), 6).alias("worst_mdd"),
        F.round(F.product(1 + sr) - 1, 5).alias("masked"),
    )


@query("E8 drawdown episodes for every supplier", per_supplier("drawdown_episode_list"))
def supplier_drawdown_episodes(spark, sf):
    return machine_queries.drawdown_episode_list(spark, sf, "supplier")


@query("J15 J16 nearest event in an asymmetric window for every supplier", per_supplier("event_matching"))
def supplier_event_matching(spark, sf):
    return join_queries.event_matching(spark, sf, "supplier")


@query("A7 M14 Spearman next to Pearson for every supplier", per_supplier("rank_correlation"))
def supplier_rank_correlation(spark, sf):
    return agg_queries.rank_correlation(spark, sf, "supplier")


@query("I11 I15 bootstrap of a mean difference for every supplier", per_supplier("bootstrap_mean_difference"))
def supplier_mean_difference(spark, sf):
    return inference_queries.mean_difference_test(spark, sf, 200, "supplier")
