"""Rolling, expanding, shifted and forward-looking windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.expr import TRADING_DAYS
from tidemark.operators import linear
from tidemark.operators import windows as W
from tidemark.operators.episodes import blocks
from tidemark.operators.signals import signal_frame
from tidemark.plans import base_sql as B
from tidemark.plans.base_queries import day
from tidemark.plans.registry import query

SIG = B.with_(*B.signal_frame())
TS = "strftime(ts,'%Y-%m-%d') AS ts"
SY = "OVER (PARTITION BY symbol ORDER BY ts)"


@query(
    "W1 W2 W4 W5 W6 G19 rolling mean, deviation, high, guarded sum, smoothing",
    SIG + f"""SELECT symbol, {TS}, round({B.mean('close', 50)},8) AS sma50, round({B.std('r', 20)},6) AS sd20,
    round(close/max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)-1,6) AS off_high,
    round(4*({B.mean('r', 4)}),6) AS sum4, round(avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),8) AS smooth5,
    round(close/({B.mean('close', 200)}),6) AS stretch200 FROM sig""",
)
def rolling_statistics(spark, sf):
    s = W.with_rolling(signal_frame(spark, sf), {"c50": ("close", 50), "r20": ("r", 20), "r4": ("r", 4), "c200": ("close", 200)})
    return s.select(
        "symbol", day().alias("ts"), F.round("c50_mean", 8).alias("sma50"), F.round("r20_std", 6).alias("sd20"),
        F.round(F.col("close") / F.max("close").over(W.trailing(252)) - 1, 6).alias("off_high"),
        F.round(4 * F.col("r4_mean"), 6).alias("sum4"), F.round(F.avg("close").over(W.trailing(5)), 8).alias("smooth5"),
        F.round(F.col("close") / F.col("c200_mean"), 6).alias("stretch200"),
    )


@query(
    "W7 A8 rolling correlation and beta",
    SIG + f"""SELECT symbol, {TS}, round(corr(intra,r) OVER w,6) AS corr, round(covar_pop(intra,r) OVER w/var_pop(intra) OVER w,6) AS beta
    FROM sig WHERE r IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w=60""",
)
def rolling_correlation(spark, sf):
    s = W.with_rolling_pair(signal_frame(spark, sf).where("r is not null"), "intra", "r", 60).where("corr is not null")
    return s.select("symbol", day().alias("ts"), F.round("corr", 6).alias("corr"), F.round("beta", 6).alias("beta"))


@query(
    "W8 X4 rolling Sharpe with population deviation",
    SIG + f"""SELECT symbol, {TS}, round(avg(r) OVER w/stddev_pop(r) OVER w*sqrt(252),5) AS sharpe
    FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) QUALIFY count(r) OVER w=252""",
)
def rolling_sharpe(spark, sf):
    k = 252
    s = W.with_rolling(signal_frame(spark, sf), {"r": ("r", k)}).where("r_std is not null")
    pop = F.col("r_std") * (((k - 1) / k) ** 0.5)
    return s.select("symbol", day().alias("ts"), F.round(F.col("r_mean") / pop * (TRADING_DAYS**0.5), 5).alias("sharpe"))


@query(
    "W9 rolling percentile rank",
    SIG + f"""SELECT symbol, {TS}, round((len(list_filter(a, lambda v: v<close))+(len(list_filter(a, lambda v: v=close))+1)/2.0::DOUBLE)/12.0::DOUBLE,6) AS prank
    FROM (SELECT symbol, ts, close, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS a FROM sig) WHERE len(a)=12""",
)
def rolling_percent_rank(spark, sf):
    s = signal_frame(spark, sf).withColumn("prank", F.round(W.rolling_percent_rank("close", 12), 6))
    return s.where("prank is not null").select("symbol", day().alias("ts"), "prank")


@query(
    "W10 W11 W12 W13 W17 drawdown path, compounded path, lags, padded change",
    SIG + f"""SELECT symbol, {TS}, round(close/max(close) {SY}-1,6) AS dd, round(product(1+coalesce(r,0)) {SY},5) AS growth,
    round(close-lag(close,5) {SY},6) AS diff5, round(f/lag(f,21) {SY}-1,6) AS chg21, round(lead(close) {SY},6) AS next_close
    FROM (SELECT *, last_value(CASE WHEN z>0 THEN close END IGNORE NULLS) {SY} AS f FROM sig)""",
)
def shifted_and_expanding(spark, sf):
    s = signal_frame(spark, sf).withColumn("f", W.filled(F.when(F.col("z") > 0, F.col("close"))))
    w = W.over()
    return s.select(
        "symbol", day().alias("ts"), F.round(F.col("close") / F.max("close").over(W.upto()) - 1, 6).alias("dd"),
        F.round(F.product(1 + F.coalesce("r", F.lit(0.0))).over(W.upto()), 5).alias("growth"),
        F.round(F.col("close") - F.lag("close", 5).over(w), 6).alias("diff5"), F.round(W.pct_change("f", 21), 6).alias("chg21"),
        F.round(F.lead("close").over(w), 6).alias("next_close"),
    )


def fwd_mdd_sql(lo, hi, need, name):
    return (
        f"SELECT symbol, pos, CASE WHEN count(*)>={need} THEN round(min(c/pk-1),6) END AS {name} FROM (SELECT a.symbol, a.pos, b.close AS c, "
        f"max(b.close) OVER (PARTITION BY a.symbol, a.pos ORDER BY b.pos) AS pk FROM sig a JOIN sig b ON a.symbol=b.symbol AND b.pos BETWEEN a.pos+{lo} AND a.pos+{hi}) GROUP BY 1,2"
    )


@query(
    "W14 W15 forward return and the four forward-drawdown frames",
    SIG.rstrip() + f""", a AS ({fwd_mdd_sql(0, 21, 22, 'mdd_a')}), b AS ({fwd_mdd_sql(0, 22, 23, 'mdd_b')}), c AS ({fwd_mdd_sql(1, 22, 10, 'mdd_c')}), d AS ({fwd_mdd_sql(1, 63, 10, 'mdd_d')})
    SELECT s.symbol, strftime(s.ts,'%Y-%m-%d') AS ts, CASE WHEN lead(s.pos,22) OVER (PARTITION BY s.symbol ORDER BY s.pos) IS NOT NULL THEN mdd_a END AS mdd_a, mdd_b, mdd_c, mdd_d,
    round(lead(close,22) OVER (PARTITION BY s.symbol ORDER BY s.pos)/close-1,6) AS fwd22
    FROM sig s LEFT JOIN a USING (symbol,pos) LEFT JOIN b USING (symbol,pos) LEFT JOIN c USING (symbol,pos) LEFT JOIN d USING (symbol,pos)""",
)
def forward_drawdowns(spark, sf):
    s = signal_frame(spark, sf)
    r6 = lambda c: F.round(c, 6)
    return s.select(
        "symbol", day().alias("ts"),
        r6(F.when(F.lead("pos", 22).over(W.over()).isNotNull(), W.forward_drawdown("close", 0, 21, require_full=True))).alias("mdd_a"),
        r6(W.forward_drawdown("close", 0, 22, require_full=True)).alias("mdd_b"),
        r6(W.forward_drawdown("close", 1, 22, min_count=10)).alias("mdd_c"),
        r6(W.forward_drawdown("close", 1, 63, min_count=10)).alias("mdd_d"),
        r6(W.forward_return("close", 22)).alias("fwd22"),
    )


@query(
    "W16 forward realised volatility",
    SIG + f"""SELECT symbol, {TS}, round(stddev_samp(r) OVER w*sqrt(252),6) AS fwd_vol FROM sig
    WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 FOLLOWING AND 22 FOLLOWING) QUALIFY count(r) OVER w>=5""",
)
def forward_volatility(spark, sf):
    w = W.over().rowsBetween(2, 22)
    s = signal_frame(spark, sf).withColumn("k", F.count("r").over(w)).withColumn("v", F.stddev_samp("r").over(w))
    return s.where("k >= 5").select("symbol", day().alias("ts"), F.round(F.col("v") * F.sqrt(F.lit(TRADING_DAYS)), 6).alias("fwd_vol"))


@query(
    "W18 W19 rising and falling edges",
    SIG + f"""SELECT symbol, {TS}, CASE WHEN on1 THEN 'rise' ELSE 'fall' END AS edge FROM (SELECT symbol, ts, coalesce(z>1.0,FALSE) AS on1, coalesce(lag(z>1.0) {SY},FALSE) AS on0 FROM sig) WHERE on1<>on0""",
)
def signal_edges(spark, sf):
    f = F.col("z") > 1.0
    s = signal_frame(spark, sf).withColumn("edge", F.when(W.rising(f), "rise").when(W.falling(f), "fall"))
    return s.where("edge is not null").select("symbol", day().alias("ts"), "edge")


BLOCKS = """
fl AS (SELECT symbol, ts, pos, close, coalesce(z>0.5,FALSE) AS f FROM sig),
bl0 AS (SELECT *, sum(CASE WHEN f<>coalesce(pf,NOT f) THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM (SELECT *, lag(f) OVER (PARTITION BY symbol ORDER BY ts) AS pf FROM fl)),
blk AS (SELECT symbol, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows, min(pos) AS p0, max(pos) AS p1 FROM bl0 WHERE f GROUP BY symbol, b)"""


@query(
    "W20 contiguous blocks with minimum duration; open last block",
    SIG.rstrip() + "," + BLOCKS + """ SELECT symbol, strftime(start_ts,'%Y-%m-%d') AS start_ts, strftime(end_ts,'%Y-%m-%d') AS end_ts, n_rows, p1=(SELECT max(pos) FROM sig s WHERE s.symbol=blk.symbol) AS open_ended FROM blk WHERE n_rows>=3""",
)
def flag_blocks(spark, sf):
    b = blocks(signal_frame(spark, sf), F.col("z") > 0.5, min_rows=3)
    return b.select("symbol", day("start_ts").alias("start_ts"), day("end_ts").alias("end_ts"), "n_rows", "open_ended")


@query(
    "W21 rank and row number within a day",
    SIG + f"""SELECT symbol, {TS}, CAST(rank() OVER (PARTITION BY ts ORDER BY round(r,3) DESC) AS INT) AS rnk, CAST(row_number() OVER (PARTITION BY ts ORDER BY r DESC, symbol) AS INT) AS rn FROM sig WHERE r IS NOT NULL""",
)
def daily_ranks(spark, sf):
    s = signal_frame(spark, sf).where("r is not null")
    d = Window.partitionBy("ts")
    return s.select(
        "symbol", day().alias("ts"), F.rank().over(d.orderBy(F.round("r", 3).desc())).alias("rnk"),
        F.row_number().over(d.orderBy(F.desc("r"), "symbol")).alias("rn"),
    )


ROLL2 = """
f0 AS (SELECT symbol, ts, pos, r AS y, gap AS x1, z AS x2 FROM sig WHERE r IS NOT NULL AND gap IS NOT NULL AND z IS NOT NULL),
f1 AS (SELECT symbol, ts, pos, y, x1, x2, count(*) OVER w AS c, covar_pop(x1,y) OVER w AS c1y, covar_pop(x2,y) OVER w AS c2y, covar_pop(x1,x2) OVER w AS c12, var_pop(x1) OVER w AS v1, var_pop(x2) OVER w AS v2, var_pop(y) OVER w AS vy
 FROM f0 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
ro AS (SELECT *, (c1y*v2-c2y*c12)/(v1*v2-c12*c12) AS b1, (c2y*v1-c1y*c12)/(v1*v2-c12*c12) AS b2 FROM f1 WHERE c=63)"""


@query(
    "W22 rolling OLS: betas, contributions and R2 over 63 rows",
    SIG.rstrip() + "," + ROLL2 + f""" SELECT symbol, {TS}, round(b1,5) AS beta_gap, round(b2,6) AS beta_z, round((b1*c1y+b2*c2y)/vy,5) AS r2 FROM ro""",
)
def rolling_factor_model(spark, sf):
    m = linear.rolling_ols(signal_frame(spark, sf), ["gap", "z"], "r", 63)
    return m.select("symbol", day().alias("ts"), F.round("beta_gap", 5).alias("beta_gap"), F.round("beta_z", 6).alias("beta_z"), F.round("r2", 5).alias("r2"))


ATTR = """ a0 AS (SELECT symbol, ts, r AS y, gap AS x1, z AS x2, vz AS x3 FROM sig WHERE r IS NOT NULL AND gap IS NOT NULL AND z IS NOT NULL AND vz IS NOT NULL),
a1 AS (SELECT *, count(*) OVER w AS c, avg(y) OVER w AS my, var_pop(y) OVER w AS vy, """ + ", ".join(f"avg(x{i}) OVER w AS m{i}, sqrt(var_pop(x{i}) OVER w) AS s{i}, covar_pop(x{i},y) OVER w AS y{i}" for i in (1, 2, 3)) + ", " + ", ".join(f"covar_pop(x{i},x{j}) OVER w AS c{i}{j}" for i, j in ((1, 2), (1, 3), (2, 3))) + """ FROM a0 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)),
-- correlations p, q, t of the factors and u1 to u3 with the target; the constant factor has no part
a2 AS (SELECT *, c12/(s1*s2) AS p, c13/(s1*s3) AS q, c23/(s2*s3) AS t, y1/s1 AS u1, y2/s2 AS u2, y3/s3 AS u3 FROM a1 WHERE c=63),
a3 AS (SELECT *, 1+2*p*q*t-p*p-q*q-t*t AS det FROM a2),
a4 AS (SELECT *, (u1*(1-t*t)-u2*(p-q*t)+u3*(p*t-q))/det AS b1, (-u1*(p-q*t)+u2*(1-q*q)-u3*(t-p*q))/det AS b2, (u1*(p*t-q)-u2*(t-p*q)+u3*(1-p*p))/det AS b3 FROM a3),
a5 AS (SELECT *, b1*(x1-m1)/s1 AS p1, b2*(x2-m2)/s2 AS p2, b3*(x3-m3)/s3 AS p3 FROM a4)"""


@query(
    "W22 A21 rolling regression standardised inside its 63-row window: weights, contributions, residual, R2, with a factor that never varies",
    SIG.rstrip() + "," + ATTR + f" SELECT symbol, {TS}, round(b1,6) AS weight_gap, round(b2,6) AS weight_z, round(p1,6) AS part_gap, round(p2,6) AS part_z, round(p3,6) AS part_vz, 0.0::DOUBLE AS part_days, round(my,7) AS base, round(y-my-p1-p2-p3,6) AS rest, round((b1*u1+b2*u2+b3*u3)/vy,5) AS r2 FROM a5",
)
def rolling_attribution(spark, sf):
    s = signal_frame(spark, sf).withColumn("days", F.lit(5.0))
    m = linear.rolling_attribution(s, ["gap", "z", "vz", "days"], "r", 63)
    r = lambda c, n, k=6: F.round(c, k).alias(n)
    return m.select("symbol", day().alias("ts"), r("gap_weight", "weight_gap"), r("z_weight", "weight_z"), r("gap_part", "part_gap"), r("z_part", "part_z"), r("vz_part", "part_vz"), r("days_part", "part_days"), r("base", "base", 7), r("rest", "rest"), r("r2", "r2", 5))


@query(
    "W23 A21 P12 rolling variance share of two contributions, every 5th row",
    SIG.rstrip() + "," + ROLL2 + f""", vs AS (SELECT symbol, ts, row_number() OVER w AS rn, count(*) OVER w63 AS c, var_pop(b1*x1) OVER w63 AS a, var_pop(b2*x2) OVER w63 AS b FROM ro
      WINDOW w AS (PARTITION BY symbol ORDER BY ts), w63 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))
    SELECT symbol, {TS}, round(a/(a+b),5) AS share_gap FROM vs WHERE c=63 AND (rn-63)%5=0""",
)
def rolling_variance_share(spark, sf):
    m = linear.rolling_ols(signal_frame(spark, sf), ["gap", "z"], "r", 63)
    m = m.withColumn("rn", F.row_number().over(W.over()))
    m = W.with_rolling(m, {"a": (F.col("beta_gap") * F.col("gap"), 63), "b": (F.col("beta_z") * F.col("z"), 63)})
    va, vb = F.col("a_std") * F.col("a_std"), F.col("b_std") * F.col("b_std")
    return m.where("a_std is not null and (rn - 63) % 5 = 0").select("symbol", day().alias("ts"), F.round(va / (va + vb), 5).alias("share_gap"))
