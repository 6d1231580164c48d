"""Aggregations, rankings, top-k, set operations and filters."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import stats as S
from tidemark.functions.expr import clip, null_if_zero, one_if_zero, tags
from tidemark.operators import linear
from tidemark.operators import windows as W
from tidemark.operators.signals import signal_frame
from tidemark.plans import base_sql as B
from tidemark.plans.base_queries import day
from tidemark.plans.registry import query
from tidemark.session import calendar_sized, fan_join
from tidemark.sources import market

SIG = B.with_(*B.signal_frame())
SIGX = SIG.rstrip() + ","
TS = "strftime(ts,'%Y-%m-%d') AS ts"
SY = "OVER (PARTITION BY symbol ORDER BY ts)"
r6 = lambda c, n=None: F.round(c, 6).alias(n or c)


@query(
    "A1 A2 A3 A4 K6 per-symbol summary with both deviations and exact percentiles",
    SIG + """SELECT symbol, count(r) AS n, round(avg(r),8) AS mean, min(r) AS lo, max(r) AS hi, round(stddev_samp(r),8) AS sd1, round(stddev_pop(r),8) AS sd0,
    round(median(r),8) AS med, round(quantile_cont(r,0.1),8) AS p10, round(quantile_cont(r,0.9),8) AS p90, round(avg(CASE WHEN r>0 THEN 1.0::DOUBLE ELSE 0 END),6) AS up FROM sig WHERE r IS NOT NULL GROUP BY symbol""",
)
def return_summary(spark, sf):
    s = signal_frame(spark, sf).where("r is not null")
    r8 = lambda e, n: F.round(e, 8).alias(n)
    return s.groupBy("symbol").agg(
        F.count("r").alias("n"), r8(F.avg("r"), "mean"), F.min("r").alias("lo"), F.max("r").alias("hi"),
        r8(F.stddev_samp("r"), "sd1"), r8(F.stddev_pop("r"), "sd0"), r8(F.median("r"), "med"),
        r8(F.percentile("r", 0.1), "p10"), r8(F.percentile("r", 0.9), "p90"), r6(S.share(F.col("r") > 0), "up"),
    )


@query(
    "A5 K6 bias-corrected skewness and excess kurtosis",
    SIG + "SELECT symbol, round(skewness(r),6) AS skew, round(kurtosis(r),6) AS kurt FROM sig GROUP BY symbol",
)
def return_shape(spark, sf):
    return signal_frame(spark, sf).groupBy("symbol").agg(r6(S.skew_corrected("r"), "skew"), r6(S.kurtosis_corrected("r"), "kurt"))


@query(
    "A6 correlation matrix of all pairs of series",
    SIG + "SELECT a.symbol AS a, b.symbol AS b, round(corr(a.r,b.r),6) AS corr, count(*) AS n FROM sig a JOIN sig b ON a.ts=b.ts AND a.symbol<b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1,2",
)
def correlation_matrix(spark, sf):
    """Day rows of all symbols meet on the day, each pair once; moments per pair combine map-side."""
    d = signal_frame(spark, sf).where("r is not null").select("ts", "symbol", "r")
    x = fan_join(d.toDF("ts", "a", "ra"), d.toDF("ts", "b", "rb"), ["ts"]).where("a < b")
    return x.groupBy("a", "b").agg(F.round(F.corr("ra", "rb"), 6).alias("corr"), F.count(F.lit(1)).alias("n"))


@query(
    "A7 M14 Spearman next to Pearson",
    SIGX + """ v AS (SELECT symbol, z, lead(close,5) OVER (PARTITION BY symbol ORDER BY ts)/close-1 AS f FROM sig),
    k AS (SELECT symbol, z, f, rank() OVER (PARTITION BY symbol ORDER BY z)+(count(*) OVER (PARTITION BY symbol,z)-1)/2.0::DOUBLE AS a, rank() OVER (PARTITION BY symbol ORDER BY f)+(count(*) OVER (PARTITION BY symbol,f)-1)/2.0::DOUBLE AS b FROM v WHERE z IS NOT NULL AND f IS NOT NULL)
    SELECT symbol, round(corr(a,b),6) AS spearman, round(corr(z,f),6) AS pearson FROM k GROUP BY symbol""",
)
def rank_correlation(spark, sf, by="flag"):
    s = signal_frame(spark, sf, by).withColumn("f", W.forward_return("close", 5)).where("z is not null and f is not null")
    s = S.average_rank(S.average_rank(s, "z", ["symbol"], "a"), "f", ["symbol"], "b")
    return s.groupBy("symbol").agg(r6(F.corr("a", "b"), "spearman"), r6(F.corr("z", "f"), "pearson"))


@query(
    "A8 A9 K10 K11 beta, slope, tracking difference and error against a base symbol",
    SIG + """SELECT a.symbol, round(covar_samp(a.r,b.r)/var_samp(b.r),6) AS beta, round(regr_slope(a.close,a.pos),8) AS slope, round(avg(a.r-b.r)*10000,6) AS drift_bp,
    round(stddev_samp(a.r-b.r)*sqrt(252),6) AS te, round(sum(ln(1+a.r)-ln(1+b.r)),6) AS log_alpha FROM sig a JOIN sig b ON a.ts=b.ts AND b.symbol='NO' WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY a.symbol""",
)
def tracking_against_base(spark, sf):
    s = signal_frame(spark, sf).where("r is not null")
    base = s.where("symbol = 'NO'").select("ts", F.col("r").alias("rb"))
    diff = F.col("r") - F.col("rb")
    return s.join(calendar_sized(base), "ts").groupBy("symbol").agg(
        r6(F.covar_samp("r", "rb") / F.var_samp("rb"), "beta"), F.round(F.regr_slope("close", "pos"), 8).alias("slope"),
        r6(F.avg(diff) * 10000, "drift_bp"), r6(F.stddev_samp(diff) * F.sqrt(F.lit(252)), "te"),
        r6(F.sum(F.log1p("r") - F.log1p("rb")), "log_alpha"),
    )


@query(
    "K11 A12 log-alpha against a base symbol by year, its running sum and share of the whole",
    SIG + """, j AS (SELECT a.symbol, year(a.ts) AS yr, ln(1+a.r)-ln(1+b.r) AS d FROM sig a JOIN sig b ON a.ts=b.ts AND b.symbol='NO' WHERE a.r IS NOT NULL AND b.r IS NOT NULL AND a.symbol<>'NO'), y AS (SELECT symbol, yr, count(*) AS n, sum(d) AS g, stddev_samp(d)*sqrt(252) AS te FROM j GROUP BY 1,2)
    SELECT symbol, CAST(yr AS INT) AS yr, n, round(g,6) AS log_alpha, round(te,6) AS te, round(sum(g) OVER (PARTITION BY symbol ORDER BY yr),6) AS running, round(g/nullif(sum(abs(g)) OVER (PARTITION BY symbol),0),6) AS share FROM y""",
)
def yearly_log_alpha(spark, sf):
    s = signal_frame(spark, sf).where("r is not null")
    base = s.where("symbol = 'NO'").select("ts", F.col("r").alias("rb"))
    d = F.log1p("r") - F.log1p("rb")
    y = s.where("symbol <> 'NO'").join(calendar_sized(base), "ts").groupBy("symbol", F.year("ts").alias("yr")).agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("g"), (F.stddev_samp(d) * F.sqrt(F.lit(252.0))).alias("te"))
    by = Window.partitionBy("symbol")
    return y.select(
        "symbol", "yr", "n", r6("g", "log_alpha"), r6("te"), r6(F.sum("g").over(by.orderBy("yr").rowsBetween(Window.unboundedPreceding, 0)), "running"), r6(F.col("g") / F.nullif(F.sum(F.abs("g")).over(by), F.lit(0.0)), "share")
    )


@query(
    "A10 multi-regressor OLS per symbol",
    SIGX + """ f AS (SELECT symbol, r AS y, gap AS x1, z AS x2 FROM sig WHERE r IS NOT NULL AND z IS NOT NULL AND gap IS NOT NULL),
    m AS (SELECT symbol, count(*) AS n_obs, avg(y) AS ay, avg(x1) AS a1, avg(x2) AS a2, covar_pop(x1,y) AS c1y, covar_pop(x2,y) AS c2y, covar_pop(x1,x2) AS c12, var_pop(x1) AS v1, var_pop(x2) AS v2, var_pop(y) AS vy FROM f GROUP BY symbol),
    b AS (SELECT *, (c1y*v2-c2y*c12)/(v1*v2-c12*c12) AS b1, (c2y*v1-c1y*c12)/(v1*v2-c12*c12) AS b2 FROM m)
    SELECT symbol, n_obs, round(ay-b1*a1-b2*a2,7) AS intercept, round(b1,6) AS beta_gap, round(b2,7) AS beta_z, round((b1*c1y+b2*c2y)/vy,6) AS r2 FROM b""",
)
def factor_regression(spark, sf):
    m = linear.ols(signal_frame(spark, sf), ["symbol"], ["gap", "z"], "r")
    return m.select("symbol", "n_obs", F.round("intercept", 7).alias("intercept"), r6("beta_gap"), F.round("beta_z", 7).alias("beta_z"), r6("r2"))


@query(
    "A11 A12 V14 compounded return and volatility by calendar year with a minimum row count",
    SIG + "SELECT symbol, CAST(year(ts) AS INT) AS yr, count(*) AS n, round(product(1+r)-1,6) AS ret, round(stddev_samp(r)*sqrt(252),6) AS vol FROM sig WHERE r IS NOT NULL GROUP BY 1,2 HAVING count(*)>=50",
)
def yearly_returns(spark, sf):
    s = signal_frame(spark, sf).where("r is not null").groupBy("symbol", F.year("ts").alias("yr"))
    s = s.agg(F.count(F.lit(1)).alias("n"), r6(S.compounded("r"), "ret"), r6(F.stddev_samp("r") * F.sqrt(F.lit(252)), "vol"))
    return s.where("n >= 50")


@query(
    "A13 P5 X2 named predicates: a row may belong to several regimes",
    SIGX + """ t AS (SELECT symbol, r, unnest(list_filter([CASE WHEN z>1 THEN 'stress' END, CASE WHEN vz>1 THEN 'volatile' END, CASE WHEN z<0 AND vz<0 THEN 'calm' END, CASE WHEN master=0 THEN 'out' END, 'all'], lambda x: x IS NOT NULL)) AS regime FROM sig)
    SELECT regime, count(*) AS n, round(avg(r),7) AS mean, round(stddev_pop(r),7) AS sd FROM t GROUP BY regime""",
)
def regime_profile(spark, sf):
    regimes = {
        "stress": F.col("z") > 1, "volatile": F.col("vz") > 1, "calm": (F.col("z") < 0) & (F.col("vz") < 0),
        "out": F.col("master") == 0, "all": F.lit(True),
    }
    s = signal_frame(spark, sf).withColumn("regime", F.explode(tags(regimes)))
    return s.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 7).alias("mean"), F.round(F.stddev_pop("r"), 7).alias("sd"))


@query("A14 K16 days per state", SIG + "SELECT symbol, CAST(master AS INT) AS master, count(*) AS n FROM sig GROUP BY 1,2")
def state_coverage(spark, sf):
    return signal_frame(spark, sf).groupBy("symbol", F.col("master").cast("int")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "A15 conditional crash probability and lift",
    SIGX + """ v AS (SELECT *, lead(close,21) OVER (PARTITION BY symbol ORDER BY ts)/close-1 AS f FROM sig)
    SELECT symbol, round(base,6) AS base, round(flagged,6) AS flagged, round(flagged-base,6) AS lift FROM (SELECT symbol, avg(CASE WHEN master=1 THEN CAST(f<=-0.05 AS INT) END) AS base,
    avg(CASE WHEN master=1 AND z>1 THEN CAST(f<=-0.05 AS INT) END) AS flagged FROM v WHERE f IS NOT NULL GROUP BY symbol)""",
)
def crash_lift(spark, sf):
    s = signal_frame(spark, sf).withColumn("f", W.forward_return("close", 21)).where("f is not null")
    hit, inside = F.col("f") <= -0.05, F.col("master") == 1
    a = s.groupBy("symbol").agg(S.prob(hit, inside).alias("base"), S.prob(hit, inside & (F.coalesce(F.col("z") > 1, F.lit(False)))).alias("flagged"))
    return a.select("symbol", r6("base"), r6("flagged"), r6(F.col("flagged") - F.col("base"), "lift"))


@query(
    "A16 best row per metric", SIG + """SELECT symbol, strftime(arg_max(ts,r),'%Y-%m-%d') AS best_day, strftime(arg_min(ts,r),'%Y-%m-%d') AS worst_day, strftime(arg_max(ts,close),'%Y-%m-%d') AS top_day FROM sig WHERE r IS NOT NULL GROUP BY symbol""",
)
def best_and_worst_days(spark, sf):
    s = signal_frame(spark, sf).where("r is not null").groupBy("symbol")
    return s.agg(day(F.max_by("ts", "r")).alias("best_day"), day(F.min_by("ts", "r")).alias("worst_day"), day(F.max_by("ts", "close")).alias("top_day"))


@query(
    "A17 A18 O6 distribution table and rank of the latest day",
    SIGX + """ l AS (SELECT symbol, arg_max(r,ts) AS last_r FROM sig GROUP BY symbol)
    SELECT s.symbol, CAST(count(CASE WHEN r>last_r THEN 1 END)+1 AS BIGINT) AS rnk, round(quantile_cont(r,0.1),7) AS p10, round(quantile_cont(r,0.25),7) AS p25, round(quantile_cont(r,0.5),7) AS p50, round(quantile_cont(r,0.75),7) AS p75, round(quantile_cont(r,0.9),7) AS p90
    FROM sig s JOIN l USING (symbol) WHERE r IS NOT NULL GROUP BY s.symbol""",
)
def distribution_rank(spark, sf):
    s = signal_frame(spark, sf).where("r is not null")
    last = s.groupBy("symbol").agg(F.max_by("r", "ts").alias("last_r"))
    qs = [0.1, 0.25, 0.5, 0.75, 0.9]
    a = s.join(last, "symbol").groupBy("symbol").agg(
        (F.count_if(F.col("r") > F.col("last_r")) + 1).alias("rnk"), F.percentile("r", F.array(*[F.lit(q) for q in qs])).alias("q")
    )
    return a.select("symbol", "rnk", *[F.round(F.col("q")[i], 7).alias(f"p{int(q * 100)}") for i, q in enumerate(qs)])


CONF = """ v AS (SELECT symbol, ts, z>0.5 AS p, lead(close,5) OVER (PARTITION BY symbol ORDER BY ts)/close-1<0 AS a FROM sig),
 c AS (SELECT symbol, count(CASE WHEN p AND a THEN 1 END) AS tp, count(CASE WHEN p AND NOT a THEN 1 END) AS fp, count(CASE WHEN NOT p AND a THEN 1 END) AS fn, count(CASE WHEN NOT p AND NOT a THEN 1 END) AS tn FROM v WHERE p IS NOT NULL AND a IS NOT NULL GROUP BY symbol),
 d AS (SELECT *, CAST(tp AS DOUBLE) t1, CAST(fp AS DOUBLE) f1, CAST(fn AS DOUBLE) f0, CAST(tn AS DOUBLE) t0 FROM c)"""


@query(
    "A19 M11 confusion matrix and scores",
    SIGX + CONF + """ SELECT symbol, tp, fp, fn, tn, round((t1+t0)/(t1+f1+f0+t0),6) AS accuracy, round((coalesce(t1/nullif(t1+f0,0),0)+coalesce(t0/nullif(t0+f1,0),0))/2,6) AS balanced,
    round(coalesce(t1/nullif(t1+f1,0),0),6) AS precision, round(coalesce(t0/nullif(t0+f0,0),0),6) AS precision_neg, round(coalesce(t1/nullif(t1+f0,0),0),6) AS recall, round(coalesce(t0/nullif(t0+f1,0),0),6) AS recall_neg,
    round(coalesce(2*t1/nullif(2*t1+f1+f0,0),0),6) AS f1, round(coalesce((t1*t0-f1*f0)/nullif(sqrt((t1+f1)*(t1+f0)*(t0+f1)*(t0+f0)),0),0),6) AS mcc, round(coalesce(f1/nullif(f1+t0,0),0),6) AS fpr, round(coalesce(f0/nullif(f0+t1,0),0),6) AS fnr FROM d""",
)
def signal_confusion(spark, sf):
    s = signal_frame(spark, sf).withColumn("f", W.forward_return("close", 5)).where("z is not null and f is not null")
    return S.classification_scores(s.groupBy("symbol").agg(*S.confusion(F.col("z") > 0.5, F.col("f") < 0)))


@query(
    "A20 M15 forecast quality of the naive volatility forecast",
    SIGX + f""" v AS (SELECT symbol, {B.std('r', 20)}*sqrt(252) AS p, stddev_samp(r) OVER w*sqrt(252) AS a, count(r) OVER w AS c FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 FOLLOWING AND 22 FOLLOWING))
    SELECT symbol, round(1-sum((a-p)*(a-p))/(var_pop(a)*count(*)),5) AS r2, round(avg(abs(a-p)),6) AS mae, round(corr(a,p),6) AS corr, round(avg(CASE WHEN sign(a-0.16)=sign(p-0.16) THEN 1.0::DOUBLE ELSE 0 END),6) AS agree FROM v WHERE p IS NOT NULL AND c>=5 GROUP BY symbol""",
)
def naive_volatility_forecast(spark, sf):
    w = W.over().rowsBetween(2, 22)
    s = W.with_rolling(signal_frame(spark, sf), {"v": ("r", 20)})
    s = s.withColumn("p", F.col("v_std") * F.sqrt(F.lit(252))).withColumn("a", F.stddev_samp("r").over(w) * F.sqrt(F.lit(252))).withColumn("c", F.count("r").over(w))
    err = F.col("a") - F.col("p")
    return s.where("p is not null and c >= 5").groupBy("symbol").agg(
        F.round(1 - F.sum(err * err) / (F.var_pop("a") * F.count(F.lit(1))), 5).alias("r2"), r6(F.avg(F.abs(err)), "mae"),
        r6(F.corr("a", "p"), "corr"), r6(S.share(F.sign(F.col("a") - 0.16) == F.sign(F.col("p") - 0.16)), "agree"),
    )


@query(
    "A22 concentration of gains: share of the three best years, win and lose counts",
    SIGX + """ y AS (SELECT symbol, year(ts) AS yr, sum(ln(1+r)) AS g FROM sig WHERE r IS NOT NULL GROUP BY 1,2), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY g DESC, yr) AS rn FROM y)
    SELECT symbol, round(sum(CASE WHEN rn<=3 THEN g END)/sum(CASE WHEN g>0 THEN g END),6) AS top3_share, count(CASE WHEN g>0.02 THEN 1 END) AS win, count(CASE WHEN abs(g)<=0.02 THEN 1 END) AS flat, count(CASE WHEN g< -0.02 THEN 1 END) AS lose FROM k GROUP BY symbol""",
)
def gain_concentration(spark, sf):
    y = signal_frame(spark, sf).where("r is not null").groupBy("symbol", F.year("ts").alias("yr")).agg(F.sum(F.log1p("r")).alias("g"))
    y = y.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("g"), "yr")))
    g = F.col("g")
    return y.groupBy("symbol").agg(
        r6(F.sum(F.when(F.col("rn") <= 3, g)) / F.sum(F.when(g > 0, g)), "top3_share"), F.count_if(g > 0.02).alias("win"),
        F.count_if(F.abs(g) <= 0.02).alias("flat"), F.count_if(g < -0.02).alias("lose"),
    )


@query("A25 distinct values", SIG + "SELECT symbol, count(DISTINCT year(ts)) AS years, count(DISTINCT strftime(ts,'%Y-%m')) AS months FROM sig GROUP BY symbol")
def distinct_periods(spark, sf):
    return signal_frame(spark, sf).groupBy("symbol").agg(F.count_distinct(F.year("ts")).alias("years"), F.count_distinct(F.trunc("ts", "month")).alias("months"))


@query(
    "O1 O2 V12 worst-k days overall (top-k report)",
    SIG + f"SELECT symbol, {TS}, round(r,6) AS r FROM sig WHERE r IS NOT NULL ORDER BY sig.r, symbol, sig.ts LIMIT 20",
)
def worst_days(spark, sf):
    return signal_frame(spark, sf).where("r is not null").orderBy("r", "symbol", "ts").limit(20).select("symbol", day().alias("ts"), r6("r"))


@query("O3 top-3 days per symbol", SIG + f"SELECT symbol, {TS}, round(r,6) AS r, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY r DESC, ts) AS rn FROM sig WHERE r IS NOT NULL) WHERE rn<=3")
def best_days_per_symbol(spark, sf):
    w = Window.partitionBy("symbol").orderBy(F.desc("r"), "ts")
    s = signal_frame(spark, sf).where("r is not null").withColumn("rn", F.row_number().over(w))
    return s.where("rn <= 3").select("symbol", day().alias("ts"), r6("r"), "rn")


@query(
    "O4 O5 composite ranking, first per dedup key in rank order",
    SIGX + f""" y AS (SELECT symbol, year(ts) AS yr, count(CASE WHEN z>1 THEN 1 END) AS hot, count(CASE WHEN vz>1 THEN 1 END) AS vol, round(min(r),8) AS worst FROM sig GROUP BY 1,2)
    SELECT symbol, CAST(yr AS INT) AS yr, hot, vol FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY hot DESC, vol, worst, yr) AS rn FROM y) WHERE rn=1""",
)
def ranked_years(spark, sf):
    y = signal_frame(spark, sf).groupBy("symbol", F.year("ts").alias("yr")).agg(
        F.count_if(F.col("z") > 1).alias("hot"), F.count_if(F.col("vz") > 1).alias("vol"), F.round(F.min("r"), 8).alias("worst")
    )
    w = Window.partitionBy("symbol").orderBy(F.desc("hot"), "vol", "worst", "yr")
    return y.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("symbol", "yr", "hot", "vol")


SETS = B.with_(B.bars(), B.OBS, B.CAL)


@query(
    "U1 U2 U3 U4 union, intersection and difference of date sets",
    SETS + """, od AS (SELECT DISTINCT ts FROM obs), cd AS (SELECT ts FROM cal)
    SELECT k, count(*) AS n, strftime(min(ts),'%Y-%m-%d') AS first_day, strftime(max(ts),'%Y-%m-%d') AS last_day FROM (
      SELECT 'both' AS k, ts FROM (SELECT ts FROM cd INTERSECT SELECT ts FROM od) UNION ALL SELECT 'calendar_only', ts FROM (SELECT ts FROM cd EXCEPT SELECT ts FROM od)
      UNION ALL SELECT 'observed_only', ts FROM (SELECT ts FROM od EXCEPT SELECT ts FROM cd) UNION ALL SELECT 'any', ts FROM (SELECT ts FROM od UNION SELECT ts FROM cd)) GROUP BY k""",
)
def date_set_operations(spark, sf):
    cal = market.calendar(spark, sf).select("ts")
    obs = market.observations(spark, sf).select("ts").distinct()
    parts = {
        "both": cal.intersect(obs), "calendar_only": cal.join(obs, "ts", "left_anti"),
        "observed_only": obs.exceptAll(cal), "any": cal.unionByName(obs).distinct(),
    }
    u = None
    for k, d in parts.items():
        d = d.withColumn("k", F.lit(k))
        u = d if u is None else u.unionByName(d)
    return u.groupBy("k").agg(F.count(F.lit(1)).alias("n"), day(F.min("ts")).alias("first_day"), day(F.max("ts")).alias("last_day"))


@query(
    "P1 P2 P3 P9 P10 P11 P21 filters, clipping and null handling",
    SIGX + """ inc AS (SELECT symbol, min(ts) AS since FROM sig WHERE z IS NOT NULL GROUP BY symbol)
    SELECT s.symbol, strftime(s.ts,'%Y-%m-%d') AS ts, CASE WHEN z IS NOT NULL THEN least(greatest(z,-1.0::DOUBLE),1.0::DOUBLE) END AS z_clip, round(nullif(gap,0),8) AS gap_nz, CASE WHEN rate=0 THEN 1.0::DOUBLE ELSE round(rate,9) END AS rate1, coalesce(nlz,2.0::DOUBLE) AS nlz_or2,
    coalesce(z>1,FALSE) OR coalesce(vz>1.5,FALSE) OR coalesce(iz>2.5,FALSE) OR coalesce(nlz< -1.5,FALSE) AS any_flag
    FROM sig s JOIN inc ON s.symbol=inc.symbol AND s.ts>=since WHERE s.ts BETWEEN DATE '1996-06-01' AND DATE '2000-06-30' AND r IS NOT NULL AND gap IS NOT NULL""",
)
def filtered_signals(spark, sf):
    s = signal_frame(spark, sf)
    inception = s.where("z is not null").groupBy("symbol").agg(F.min("ts").alias("since"))
    s = s.join(inception, "symbol").where("ts >= since and ts between date'1996-06-01' and date'2000-06-30'").na.drop("any", subset=["r", "gap"])
    yes = lambda c: F.coalesce(c, F.lit(False))
    any_flag = yes(F.col("z") > 1) | yes(F.col("vz") > 1.5) | yes(F.col("iz") > 2.5) | yes(F.col("nlz") < -1.5)
    return s.select(
        "symbol", day().alias("ts"), clip("z", -1.0, 1.0).alias("z_clip"), F.round(null_if_zero("gap"), 8).alias("gap_nz"),
        one_if_zero(F.round("rate", 9)).alias("rate1"), F.coalesce("nlz", F.lit(2.0)).alias("nlz_or2"), any_flag.alias("any_flag"),
    )


@query(
    "P4 null ratio per column; sparse columns",
    SIG + "SELECT c AS column_name, round(v,6) AS null_ratio, v>0.5 AS sparse FROM (SELECT unnest(['z','vz','iz','nlz']) AS c, unnest([avg(CASE WHEN z IS NULL THEN 1.0::DOUBLE ELSE 0 END), avg(CASE WHEN vz IS NULL THEN 1.0::DOUBLE ELSE 0 END), avg(CASE WHEN iz IS NULL THEN 1.0::DOUBLE ELSE 0 END), avg(CASE WHEN nlz IS NULL THEN 1.0::DOUBLE ELSE 0 END)]) AS v FROM sig)",
)
def column_sparsity(spark, sf):
    cols = ["z", "vz", "iz", "nlz"]
    a = signal_frame(spark, sf).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols])
    return a.unpivot([], cols, "column_name", "v").select("column_name", r6("v", "null_ratio"), (F.col("v") > 0.5).alias("sparse"))


@query(
    "P12 P13 stride and non-overlapping samples with a chronological split",
    SIGX + """ k AS (SELECT symbol, ts, pos, count(*) OVER (PARTITION BY symbol) AS n FROM sig)
    SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, CASE WHEN pos<=0.7*n THEN 'train' ELSE 'test' END AS part FROM k WHERE (pos-1)%21=0""",
)
def non_overlapping_samples(spark, sf):
    s = signal_frame(spark, sf).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    return s.where("(pos - 1) % 21 = 0").select("symbol", day().alias("ts"), F.when(F.col("pos") <= F.lit(0.7) * F.col("n"), "train").otherwise("test").alias("part"))


@query(
    "P14 P15 latest values and lead time between two first triggers per year",
    SIG + """SELECT symbol, CAST(year(ts) AS INT) AS yr, strftime(min(CASE WHEN z>1.5 THEN ts END),'%Y-%m-%d') AS first_credit, strftime(min(CASE WHEN vz>1.5 THEN ts END),'%Y-%m-%d') AS first_vol,
    CAST(date_diff('day', min(CASE WHEN z>1.5 THEN ts END), min(CASE WHEN vz>1.5 THEN ts END)) AS DOUBLE) AS lead_days, arg_max(z, ts) FILTER (z IS NOT NULL) AS last_z FROM sig GROUP BY 1,2""",
)
def first_triggers(spark, sf):
    a = F.min(F.when(F.col("z") > 1.5, F.col("ts")))
    b = F.min(F.when(F.col("vz") > 1.5, F.col("ts")))
    return signal_frame(spark, sf).groupBy("symbol", F.year("ts").alias("yr")).agg(
        day(a).alias("first_credit"), day(b).alias("first_vol"), F.datediff(b, a).cast("double").alias("lead_days"),
        F.max_by("z", F.when(F.col("z").isNotNull(), F.col("ts"))).alias("last_z"),
    )


@query(
    "P19 P8 divergence days with case labels",
    SIG + """SELECT a.symbol, strftime(a.ts,'%Y-%m-%d') AS ts, CASE WHEN a.r< -0.009 THEN 'severe' WHEN a.r< -0.007 THEN 'large' ELSE 'mild' END AS label FROM sig a JOIN sig b ON a.ts=b.ts AND b.symbol='NO' WHERE a.r< -0.005 AND b.r> -0.002""",
)
def divergence_days(spark, sf):
    s = signal_frame(spark, sf)
    base = s.where("symbol = 'NO' and r > -0.002").select("ts")
    label = F.when(F.col("r") < -0.009, "severe").when(F.col("r") < -0.007, "large").otherwise("mild")
    return s.where("r < -0.005").join(calendar_sized(base), "ts", "left_semi").select("symbol", day().alias("ts"), label.alias("label"))
