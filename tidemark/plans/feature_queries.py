"""Domain signals and feature frames."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.operators import asof as A
from tidemark.operators import projections as PJ
from tidemark.operators import windows as W
from tidemark.operators.quality import drop_sparse
from tidemark.operators.signals import signal_frame
from tidemark.plans import base_sql as B
from tidemark.plans.base_queries import day
from tidemark.plans.registry import query
from tidemark.session import calendar_sized
from tidemark.sources import market

SIG = B.with_(*B.signal_frame())
SIGX = SIG.rstrip() + ","
TS = "strftime(ts,'%Y-%m-%d') AS ts"
PX = B.with_(B.PROJ).rstrip() + ","
r6 = lambda c, n=None: F.round(c, 6).alias(n or c)
GRID = [(p, r) for p in (1.5, 2.0, 2.2) for r in (0.0, 0.25)]


@query(
    "G10 I8 projection signals over a threshold grid",
    PX + " g(pt,rt) AS (VALUES " + ",".join(f"({p}::DOUBLE,{r}::DOUBLE)" for p, r in GRID) + """), c AS (SELECT pt, rt, md, CASE WHEN rate-prev_rate>rt AND pce>pt AND pce>prev_pce THEN 0 WHEN rate<=prev_rate AND prev_pce IS NOT NULL THEN 1 END AS ev FROM sigrow JOIN g ON TRUE WHERE rn>1 AND pce IS NOT NULL),
    l AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY pt,rt ORDER BY md),1) AS st FROM c), s AS (SELECT *, lag(st,1,1) OVER (PARTITION BY pt,rt ORDER BY md) AS p FROM l)
    SELECT pt AS pce_floor, rt AS rate_step, count(CASE WHEN st=0 AND p=1 THEN 1 END) AS exits, count(CASE WHEN st=1 AND p=0 THEN 1 END) AS entries FROM s GROUP BY 1,2""",
)
def projection_threshold_grid(spark, sf):
    m = PJ.with_previous(market.projections(spark, sf))
    m = m.withColumn("g", F.explode(F.array(*[F.struct(F.lit(p).alias("pce_floor"), F.lit(r).alias("rate_step")) for p, r in GRID]))).select("*", "g.*").drop("g")
    by = ("pce_floor", "rate_step")
    s = PJ.alternating_signals(m, by, PJ.exit_condition(F.col("pce_floor"), F.col("rate_step")))
    return s.groupBy(*by).agg(F.count_if(F.col("signal") == "EXIT").alias("exits"), F.count_if(F.col("signal") == "ENTER").alias("entries"))


@query(
    "G11 G12b state-independent meetings and revision-sign state held between meetings",
    B.with_(B.bars(), B.CAL, B.PROJ).rstrip() + """, m AS (SELECT md, rate>prev_rate AND pce>2 AND pce>prev_pce AS raw_exit, rate<=prev_rate AND prev_pce IS NOT NULL AS raw_enter, rate-prev_rate>0 AND pce-prev_pce>0 AS hawk, rate-prev_rate<0 OR pce-prev_pce<0 AS dove FROM sigrow WHERE rn>1),
    u AS (SELECT m.*, (SELECT min(ts) FROM cal WHERE ts>=md+1) AS eff FROM m) SELECT strftime(c.ts,'%Y-%m-%d') AS ts, coalesce(raw_exit,FALSE) AS raw_exit, coalesce(raw_enter,FALSE) AS raw_enter, coalesce(hawk,FALSE) AS hawk, coalesce(dove,FALSE) AS dove FROM cal c ASOF LEFT JOIN (SELECT * FROM u WHERE eff IS NOT NULL) u ON c.ts>=u.eff""",
)
def revision_state(spark, sf):
    m = PJ.with_previous(market.projections(spark, sf))
    dr, dp = F.col("rate") - F.col("prev_rate"), F.col("pce") - F.col("prev_pce")
    flags = {"raw_exit": PJ.exit_condition(), "raw_enter": PJ.enter_condition(), "hawk": (dr > 0) & (dp > 0), "dove": (dr < 0) | (dp < 0)}
    ev = m.select(F.lit("X").alias("cal_id"), F.date_add("meeting_date", 1).alias("ts"), *[c.alias(n) for n, c in flags.items()])
    cal = market.calendar(spark, sf).select("cal_id", "ts")
    ev = A.asof(ev, cal.withColumn("eff", F.col("ts")), ["cal_id"], "ts", ["eff"], "forward").where("eff is not null")
    x = A.asof(cal, ev.drop("ts").withColumnRenamed("eff", "ts"), ["cal_id"], "ts", list(flags))
    return x.select(day().alias("ts"), *[F.coalesce(n, F.lit(False)).alias(n) for n in flags])


GAPQ = """ o AS (SELECT ts, max(CASE WHEN series_id='P1' THEN value END) AS fwd, max(CASE WHEN series_id='P2' THEN value END) AS tp, max(CASE WHEN series_id='P3' THEN value END) AS on1 FROM obs GROUP BY ts),
 h AS (SELECT ts, fwd-0.3::DOUBLE*tp AS ex, fwd-0.3::DOUBLE*tp-0.5::DOUBLE*on1 AS hp FROM o WHERE fwd IS NOT NULL AND tp IS NOT NULL AND on1 IS NOT NULL), d AS (SELECT ts, round(hp,11) AS hp, round(ex-lag(ex,20) OVER (ORDER BY ts),11) AS d20, round(ex-lag(ex,40) OVER (ORDER BY ts),11) AS d40 FROM h),
 s AS (SELECT *, coalesce(hp>0.5 AND d20>0.25,FALSE) AS strong FROM d)"""


@query(
    "G13 G14 policy-path gap with 20- and 40-row changes, strong state and its pulse",
    B.with_(B.OBS).rstrip() + "," + GAPQ + f" SELECT {TS}, hp, d20, d40, strong, strong AND NOT coalesce(lag(strong) OVER (ORDER BY s.ts),FALSE) AS pulse FROM s",
)
def policy_path_gap(spark, sf):
    o = market.observations(spark, sf)
    pick = lambda s, n: F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(n)
    w = o.groupBy("ts").agg(pick("P1", "fwd"), pick("P2", "tp"), pick("P3", "on1")).na.drop("any").withColumn("k", F.lit("path"))
    by = ("k",)
    w = w.withColumn("ex", F.col("fwd") - F.lit(0.3) * F.col("tp")).withColumn("hp", F.round(F.col("ex") - F.lit(0.5) * F.col("on1"), 11))
    w = w.withColumns({f"d{n}": F.round(F.col("ex") - F.lag("ex", n).over(W.over(by)), 11) for n in (20, 40)})
    w = w.withColumn("strong", F.coalesce((F.col("hp") > 0.5) & (F.col("d20") > 0.25), F.lit(False)))
    return w.select(day().alias("ts"), "hp", "d20", "d40", "strong", W.rising("strong", by).alias("pulse"))


@query(
    "G15 earnings momentum: danger and re-entry levels",
    SIGX + f""" m AS (SELECT symbol, ts, round((close/lag(close,26) OVER (PARTITION BY symbol ORDER BY ts)-1)*100,6) AS mom, round(15+4*vz,6) AS pe FROM sig) SELECT symbol, {TS}, mom, coalesce(mom>8 AND pe>18,FALSE) AS danger, coalesce(mom< -5,FALSE) AS back5, coalesce(mom< -3,FALSE) AS back3, coalesce(mom<0,FALSE) AS back0 FROM m WHERE mom IS NOT NULL""",
)
def earnings_momentum(spark, sf):
    s = signal_frame(spark, sf).withColumn("mom", F.round(W.pct_change("close", 26) * 100, 6)).withColumn("pe", F.round(15 + 4 * F.col("vz"), 6)).where("mom is not null")
    yes = lambda c, n: F.coalesce(c, F.lit(False)).alias(n)
    m = F.col("mom")
    return s.select("symbol", day().alias("ts"), "mom", yes((m > 8) & (F.col("pe") > 18), "danger"), *[yes(m < lv, n) for lv, n in ((-5, "back5"), (-3, "back3"), (0, "back0"))])


@query(
    "G16 G17 spreads, their z-scores, and one-row-shifted momentum features",
    B.with_(B.OBS).rstrip() + f""", o AS (SELECT ts, max(CASE WHEN series_id='P1' THEN value END) AS a, max(CASE WHEN series_id='P4' THEN value END) AS b FROM obs GROUP BY ts), p AS (SELECT 'k' AS symbol, ts, a-b AS sp, a FROM o WHERE a IS NOT NULL AND b IS NOT NULL)
    SELECT {TS}, {B.z('sp', 63)} AS z63, {B.z('sp', 126)} AS z126, {B.z('sp', 252)} AS z252, round(lag(sp,1) OVER w-lag(sp,64) OVER w,11) AS mom63, round(lag(a,1) OVER w-lag(a,22) OVER w,11) AS mom21 FROM p WINDOW w AS (ORDER BY ts)""",
)
def spread_features(spark, sf):
    o = market.observations(spark, sf)
    pick = lambda s, n: F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(n)
    w = o.groupBy("ts").agg(pick("P1", "a"), pick("P4", "b")).na.drop("any").withColumn("symbol", F.lit("k")).withColumn("sp", F.col("a") - F.col("b"))
    w = W.with_zscore(w, {f"z{k}": ("sp", k) for k in (63, 126, 252)})
    v = W.over()
    shifted = lambda c, k: F.round(F.lag(c, 1).over(v) - F.lag(c, k + 1).over(v), 11)
    return w.select(day().alias("ts"), "z63", "z126", "z252", shifted("sp", 63).alias("mom63"), shifted("a", 21).alias("mom21"))


@query(
    "G18 D12 J10 lagged inflation growth: 3m and 1m annualised, acceleration, 45-day publication",
    B.with_(B.bars(), B.OBS, B.CAL).rstrip() + """, m AS (SELECT CAST(date_trunc('month',ts) AS DATE) AS mo, avg(value)+10 AS x FROM obs GROUP BY 1), g AS (SELECT mo+45 AS pub, round((pow(x/lag(x,3) OVER w,4)-1)*100,6) AS g3, round((pow(x/lag(x,1) OVER w,12)-1)*100,6) AS g1 FROM m WINDOW w AS (ORDER BY mo)),
    a AS (SELECT pub, g3, g1, round(g3-lag(g3,3) OVER (ORDER BY pub),6) AS accel FROM g) SELECT strftime(c.ts,'%Y-%m-%d') AS ts, g3, g1, accel FROM cal c ASOF LEFT JOIN a ON c.ts>=a.pub""",
)
def inflation_growth(spark, sf):
    by = ("cal_id",)
    m = market.observations(spark, sf).groupBy(F.trunc("ts", "month").alias("ts")).agg((F.avg("value") + 10).alias("x")).withColumn("cal_id", F.lit("X"))
    w = W.over(by)
    m = m.withColumn("g3", F.round(E.compound_growth("x", F.lag("x", 3).over(w), 4), 6)).withColumn("g1", F.round(E.compound_growth("x", F.lag("x", 1).over(w), 12), 6))
    m = m.withColumn("accel", F.round(F.col("g3") - F.lag("g3", 3).over(w), 6)).withColumn("ts", F.date_add("ts", 45))
    x = A.asof(market.calendar(spark, sf).select("cal_id", "ts"), m, ["cal_id"], "ts", ["g3", "g1", "accel"])
    return x.select(day().alias("ts"), "g3", "g1", "accel")


SMA = (50, 100, 200)


@query(
    "G19 G25 SMA filters and ratio against its SMA",
    SIGX + f""" q AS (SELECT s.symbol, s.ts, s.close, s.close/b.close AS ra FROM sig s JOIN sig b ON b.ts=s.ts AND b.symbol='NO') SELECT symbol, {TS}, {', '.join(f"round(close/({B.mean('close', k)})-1,6) AS over{k}" for k in SMA)}, {', '.join(f"round(ra/({B.mean('ra', k)})-1,6) AS ratio{k}" for k in SMA)} FROM q""",
)
def sma_filters(spark, sf):
    s = signal_frame(spark, sf)
    q = s.join(calendar_sized(s.where("symbol = 'NO'").select("ts", F.col("close").alias("bc"))), "ts").withColumn("ra", F.col("close") / F.col("bc"))
    q = W.with_rolling(q, {**{f"c{k}": ("close", k) for k in SMA}, **{f"q{k}": ("ra", k) for k in SMA}})
    return q.select("symbol", day().alias("ts"), *[r6(F.col("close") / F.col(f"c{k}_mean") - 1, f"over{k}") for k in SMA], *[r6(F.col("ra") / F.col(f"q{k}_mean") - 1, f"ratio{k}") for k in SMA])


WFEAT = f""" wk AS (SELECT symbol, ts0 AS ts, close, z, vz, r5 FROM (SELECT symbol, CAST(ts+CAST((5-isodow(ts)+7)%7 AS INT) AS DATE) AS ts0, arg_max(close,ts) AS close, arg_max(z,ts) FILTER (z IS NOT NULL) AS z, arg_max(vz,ts) FILTER (vz IS NOT NULL) AS vz, round(sum(coalesce(r,0)),10) AS r5 FROM sig GROUP BY 1,2)),
 wf AS (SELECT symbol, ts, close, z, vz, round(z-lag(z,4) OVER w,6) AS dz4, round(close/lag(close,4) OVER w-1,6) AS mom4, round(close/lag(close,13) OVER w-1,6) AS mom13, round(close/lag(close,52) OVER w-1,6) AS mom52, round({B.std('r5', 20)}*sqrt(52),6) AS rv20, round(close/({B.mean('close', 40)})-1,6) AS vs_sma40 FROM wk WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def weekly_features(spark, sf):
    """Friday-labelled feature frame per symbol."""
    s = signal_frame(spark, sf).withColumn("wts", E.week_ending("ts", "FR"))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)
    g = s.groupBy("symbol", F.col("wts")).agg(F.max_by("close", "ts").alias("close"), latest("z"), latest("vz"), F.round(F.sum(F.coalesce("r", F.lit(0.0))), 10).alias("r5"))
    g = g.withColumnRenamed("wts", "ts")
    g = W.with_rolling(g, {"v": ("r5", 20), "c": ("close", 40)})
    w = W.over()
    return g.select(
        "symbol", "ts", "close", "z", "vz", r6(F.col("z") - F.lag("z", 4).over(w), "dz4"), *[r6(W.pct_change("close", k), f"mom{k}") for k in (4, 13, 52)],
        r6(F.col("v_std") * F.sqrt(F.lit(52)), "rv20"), r6(F.col("close") / F.col("c_mean") - 1, "vs_sma40"),
    )


@query("G20 D16 weekly feature frame", SIGX + WFEAT + f" SELECT symbol, {TS}, z, vz, dz4, mom4, mom13, mom52, rv20, vs_sma40 FROM wf")
def weekly_feature_frame(spark, sf):
    return weekly_features(spark, sf).drop("close").withColumn("ts", day())


#: What observation series stand for in the feature tables
LEVELS = {"stress": "P1", "credit": "P2", "yield": "P3", "conditions": "P4"}
#: Levels and their differences are decimals of few digits, often halfway between two of six
_digits = lambda c: 10 if re.match("(stress|credit|yield|conditions|curve|spread)(?!_z)|p[1-5]_(level|chg)", c) else 6
_win = lambda k, part="symbol": f"OVER (PARTITION BY {part} ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
_full = lambda e, x, k, part="symbol": f"CASE WHEN count({x}) {_win(k, part)}={k} THEN {e} {_win(k, part)} END"
_last = lambda c: f"arg_max({c},d) FILTER ({c} IS NOT NULL) AS {c}"
FRIDAY = "CAST(ts+CAST((5-isodow(ts)+7)%7 AS INT) AS DATE)"
WEEKLY_COLUMNS = ["rv20", "rv60", "rv_ratio", *[f"{n}{x}" for n in ("stress", "credit") for x in ("", "_z", "_chg4")], "yield", "yield_chg4", "curve", "conditions", "conditions_chg4", "mom4", "mom13", "mom52", "vs_sma200", "vs_base"]
WEEKLY_SQL = f""" dy AS (SELECT symbol, ts AS d, {FRIDAY} AS ts, close, {_full("stddev_samp(r)", "r", 20)}*sqrt(252) AS rv20, {_full("stddev_samp(r)", "r", 60)}*sqrt(252) AS rv60, close/({_full("avg(close)", "close", 200)})-1 AS vs_sma200 FROM sig),
 wk AS (SELECT symbol, ts, arg_max(close,d) AS close, {", ".join(map(_last, ("rv20", "rv60", "vs_sma200")))} FROM dy GROUP BY 1,2),
 ow AS (SELECT series_id, {FRIDAY} AS ts, arg_max(value,ts) AS v FROM obs GROUP BY 1,2), oz AS (SELECT series_id, ts, v, (v-{_full("avg(v)", "v", 52, "series_id")})/nullif({_full("stddev_samp(v)", "v", 52, "series_id")},0) AS z, v-lag(v,4) OVER (PARTITION BY series_id ORDER BY ts) AS c FROM ow),
 op AS (SELECT ts, {", ".join(f"max(v) FILTER (series_id='{p}') AS {n}_v, max(z) FILTER (series_id='{p}') AS {n}_q, max(c) FILTER (series_id='{p}') AS {n}_c" for n, p in LEVELS.items())} FROM oz GROUP BY 1),
 mo AS (SELECT *, {", ".join(f"close/lag(close,{k}) OVER (PARTITION BY symbol ORDER BY ts)-1 AS mom{k}" for k in (4, 13, 52))} FROM wk),
 wt AS (SELECT m.symbol, m.ts, m.rv20, m.rv60, m.rv20/nullif(m.rv60,0) AS rv_ratio, stress_v AS stress, stress_q AS stress_z, stress_c AS stress_chg4, credit_v AS credit, credit_q AS credit_z, credit_c AS credit_chg4, yield_v AS yield, yield_c AS yield_chg4, yield_v-credit_v AS curve, conditions_v AS conditions, conditions_c AS conditions_chg4, m.mom4, m.mom13, m.mom52, m.vs_sma200, m.mom13-b.mom13 AS vs_base
  FROM mo m LEFT JOIN op ON op.ts=m.ts LEFT JOIN mo b ON b.symbol='NO' AND b.ts=m.ts)"""


def _level_features(obs, label, changes, z_rows=None):
    """Last value of each period and series with its changes (and z-score), one row a period."""
    o = obs.withColumn("p", label).groupBy("series_id", "p").agg(F.max_by("value", "ts").alias("v")).withColumnRenamed("p", "ts")
    by = ("series_id",)
    if z_rows:
        o = W.with_rolling(o, {"z": ("v", z_rows)}, by)
        o = o.withColumn("q", (F.col("v") - F.col("z_mean")) / F.nullif(F.col("z_std"), F.lit(0.0)))
    return o.withColumns({f"c{k}": F.col("v") - F.lag("v", k).over(W.over(by)) for k in changes})


@query(
    "G20 D16 P3 the whole weekly feature table: volatility, levels with z-scores and changes, curve, momentum, trend, excess over the base",
    B.with_(*B.signal_frame()).rstrip() + "," + WEEKLY_SQL + f" SELECT symbol, {TS}, {', '.join(f'round({c},{_digits(c)}) AS {c}' for c in WEEKLY_COLUMNS)} FROM wt WHERE {' AND '.join(f'{c} IS NOT NULL' for c in WEEKLY_COLUMNS)}",
)
def weekly_feature_table(spark, sf):
    s = W.with_rolling(signal_frame(spark, sf), {"a": ("r", 20), "b": ("r", 60), "c": ("close", 200)})
    year = F.sqrt(F.lit(252.0))
    s = s.withColumns({"rv20": F.col("a_std") * year, "rv60": F.col("b_std") * year, "vs_sma200": F.col("close") / F.col("c_mean") - 1})
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)
    w = s.groupBy("symbol", E.week_ending("ts", "FR").alias("w")).agg(F.max_by("close", "ts").alias("close"), *map(latest, ("rv20", "rv60", "vs_sma200"))).withColumnRenamed("w", "ts")
    w = w.withColumns({f"mom{k}": W.pct_change("close", k) for k in (4, 13, 52)})
    o = _level_features(market.observations(spark, sf), E.week_ending("ts", "FR"), [4], 52)
    at = lambda c, p: F.max(F.when(F.col("series_id") == p, F.col(c)))
    o = o.groupBy("ts").agg(*[at(c, p).alias(f"{n}{x}") for n, p in LEVELS.items() for c, x in (("v", ""), ("q", "_z"), ("c4", "_chg4"))])
    base = w.where("symbol = 'NO'").select("ts", F.col("mom13").alias("b13"))
    x = w.join(calendar_sized(o), "ts").join(calendar_sized(base), "ts")
    x = x.withColumns({"rv_ratio": F.col("rv20") / F.nullif(F.col("rv60"), F.lit(0.0)), "curve": F.col("yield") - F.col("credit"), "vs_base": F.col("mom13") - F.col("b13")})
    return x.na.drop("any", subset=WEEKLY_COLUMNS).select("symbol", day().alias("ts"), *[F.round(c, _digits(c)).alias(c) for c in WEEKLY_COLUMNS])


SERIES = ["P1", "P2", "P3", "P4", "P5"]
MONTHLY_COLUMNS = [f"{p.lower()}_{x}" for p in SERIES for x in ("level", "chg3", "chg12", "yoy")] + ["spread12", "spread12_chg3", "spread32", "spread32_chg3", "ret1", "ret3", "ret6", "ret12", "vs_sma200", "vs_sma50", "rv20", "z", "vz", "iz", "vs_base3", "p1_rank12"]
_lagged = lambda e, k: f"{e}-lag({e},{k}) OVER (ORDER BY ts)"
MONTHLY_SQL = f""" dy AS (SELECT symbol, ts AS d, last_day(ts) AS ts, close, z, vz, iz, {_full("stddev_samp(r)", "r", 20)}*sqrt(252)*100 AS rv20, (close/({_full("avg(close)", "close", 200)})-1)*100 AS vs_sma200, (close/({_full("avg(close)", "close", 50)})-1)*100 AS vs_sma50 FROM sig),
 mk AS (SELECT symbol, ts, arg_max(close,d) AS close, {", ".join(map(_last, ("rv20", "vs_sma200", "vs_sma50", "z", "vz", "iz")))} FROM dy GROUP BY 1,2),
 rt AS (SELECT *, {", ".join(f"(close/lag(close,{k}) OVER (PARTITION BY symbol ORDER BY ts)-1)*100 AS ret{k}" for k in (1, 3, 6, 12))} FROM mk),
 om AS (SELECT series_id, last_day(ts) AS ts, arg_max(value,ts) AS v FROM obs GROUP BY 1,2), oc AS (SELECT *, v-lag(v,3) OVER w AS c3, v-lag(v,12) OVER w AS c12, (lag(v,1) OVER w/nullif(lag(v,13) OVER w,0)-1)*100 AS y FROM om WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
 op AS (SELECT ts, {", ".join(f"max({c}) FILTER (series_id='{p}') AS {p.lower()}_{n}" for p in SERIES for n, c in (("level", "v"), ("chg3", "c3"), ("chg12", "c12"), ("yoy", "y")))} FROM oc GROUP BY 1),
 os AS (SELECT *, p1_level-p2_level AS spread12, {_lagged("(p1_level-p2_level)", 3)} AS spread12_chg3, p3_level-p2_level AS spread32, {_lagged("(p3_level-p2_level)", 3)} AS spread32_chg3, list(p1_level) OVER (ORDER BY ts ROWS 11 PRECEDING) AS l FROM op),
 mt AS (SELECT r.symbol, os.* EXCLUDE (l), r.* EXCLUDE (symbol, ts, close), r.ret3-b.ret3 AS vs_base3, CASE WHEN len(list_filter(l, lambda x: x IS NOT NULL))=12 THEN (len(list_filter(l, lambda x: x<p1_level))+(len(list_filter(l, lambda x: x=p1_level))+1)/2.0::DOUBLE)/12 END AS p1_rank12 FROM rt r JOIN os ON os.ts=r.ts JOIN rt b ON b.symbol='NO' AND b.ts=r.ts)"""


@query(
    "G21 G22 D16 P3 the whole monthly feature table: levels, changes and lagged year-on-year of five series, spreads, returns, trend, scores, rank",
    B.with_(*B.signal_frame()).rstrip() + "," + MONTHLY_SQL + f" SELECT symbol, {TS}, {', '.join(f'round({c},{_digits(c)}) AS {c}' for c in MONTHLY_COLUMNS)} FROM mt WHERE {' AND '.join(f'{c} IS NOT NULL' for c in MONTHLY_COLUMNS)}",
)
def monthly_feature_table(spark, sf):
    s = W.with_rolling(signal_frame(spark, sf), {"a": ("r", 20), "b": ("close", 50), "c": ("close", 200)})
    over_mean = lambda m: (F.col("close") / F.col(m) - 1) * 100
    s = s.withColumns({"rv20": F.col("a_std") * F.sqrt(F.lit(252.0)) * 100, "vs_sma50": over_mean("b_mean"), "vs_sma200": over_mean("c_mean")})
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)
    m = s.groupBy("symbol", F.last_day("ts").alias("m")).agg(F.max_by("close", "ts").alias("close"), *map(latest, ("rv20", "vs_sma200", "vs_sma50", "z", "vz", "iz"))).withColumnRenamed("m", "ts")
    m = m.withColumns({f"ret{k}": W.pct_change("close", k) * 100 for k in (1, 3, 6, 12)})
    o = _level_features(market.observations(spark, sf), F.last_day("ts"), [3, 12])
    w = W.over(("series_id",))
    # a value of a month is known in the month after
    o = o.withColumn("y", (F.lag("v", 1).over(w) / F.nullif(F.lag("v", 13).over(w), F.lit(0.0)) - 1) * 100)
    at = lambda c, p: F.max(F.when(F.col("series_id") == p, F.col(c)))
    o = o.groupBy("ts").agg(*[at(c, p).alias(f"{p.lower()}_{n}") for p in SERIES for n, c in (("level", "v"), ("chg3", "c3"), ("chg12", "c12"), ("yoy", "y"))])
    # one row a month from here on
    o = o.withColumn("k", F.lit(1)).withColumns({"spread12": F.col("p1_level") - F.col("p2_level"), "spread32": F.col("p3_level") - F.col("p2_level")})
    o = o.withColumns({f"{c}_chg3": F.col(c) - F.lag(c, 3).over(W.over(("k",))) for c in ("spread12", "spread32")})
    o = o.withColumn("p1_rank12", W.rolling_percent_rank("p1_level", 12, ("k",))).drop("k")
    base = m.where("symbol = 'NO'").select("ts", F.col("ret3").alias("b3"))
    x = m.join(calendar_sized(o), "ts").join(calendar_sized(base), "ts").withColumn("vs_base3", F.col("ret3") - F.col("b3"))
    return x.na.drop("any", subset=MONTHLY_COLUMNS).select("symbol", day().alias("ts"), *[F.round(c, _digits(c)).alias(c) for c in MONTHLY_COLUMNS])


@query(
    "P4 P3 G20 weekly features filled forward, without columns that stay null in half the rows, then complete rows only",
    SIGX + WFEAT + f""", lw AS (SELECT *, round(close/lag(close,208) OVER w-1,6) AS mom208 FROM wf WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    ff AS (SELECT symbol, ts, {", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in ("z", "vz", "mom13", "mom52", "rv20"))} FROM lw WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, {TS}, z, vz, mom13, mom52, rv20 FROM ff WHERE z IS NOT NULL AND vz IS NOT NULL AND mom13 IS NOT NULL AND mom52 IS NOT NULL AND rv20 IS NOT NULL""",
)
def dense_weekly_features(spark, sf):
    w = W.over()
    f = weekly_features(spark, sf).withColumn("mom208", F.round(W.pct_change("close", 208), 6))
    # the 208 weeks before mom208 has a value are more than half of the sample, and filling forward cannot reach them
    cols = ["z", "vz", "mom13", "mom52", "rv20", "mom208"]
    filled = f.select("symbol", "ts", *[F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in cols])
    d = drop_sparse(filled, cols)
    return d.na.drop("any", subset=[c for c in cols if c in d.columns]).withColumn("ts", day())


@query(
    "G21 G22 monthly feature frame: level, 3- and 12-month change, year-on-year, lag option, valuation ratio",
    B.with_(B.OBS).rstrip() + """, m AS (SELECT series_id, last_day(ts) AS me, round(avg(value),12) AS v FROM obs GROUP BY 1,2), q AS (SELECT series_id, last_day(date_trunc('quarter',ts)+INTERVAL 2 MONTH) AS qe, round(avg(value),12) AS qv FROM obs GROUP BY 1,2), ql AS (SELECT series_id, CAST(last_day(qe + INTERVAL 3 MONTH) AS DATE) AS av, qv FROM q)
    SELECT m.series_id, strftime(me,'%Y-%m-%d') AS ts, v AS level, round(v-lag(v,3) OVER w,11) AS d3, round(v-lag(v,12) OVER w,11) AS d12, round(v/lag(v,12) OVER w-1,6) AS yoy, lag(v,1) OVER w AS lagged, round(v/qv,6) AS valuation FROM m ASOF LEFT JOIN ql ON ql.series_id=m.series_id AND me>=av WINDOW w AS (PARTITION BY m.series_id ORDER BY me)""",
)
def monthly_feature_frame(spark, sf):
    o = market.observations(spark, sf)
    by = ("series_id",)
    m = o.groupBy("series_id", E.month_end("ts").alias("ts")).agg(F.round(F.avg("value"), 12).alias("v"))
    q = o.groupBy("series_id", E.quarter_end("ts").alias("qe")).agg(F.round(F.avg("value"), 12).alias("qv"))
    q = q.select("series_id", F.last_day(F.add_months("qe", 3)).alias("ts"), "qv")
    x = A.asof(m, q, ["series_id"], "ts", ["qv"])
    w = W.over(by)
    return x.select(
        "series_id", day().alias("ts"), F.col("v").alias("level"), *[F.round(F.col("v") - F.lag("v", k).over(w), 11).alias(f"d{k}") for k in (3, 12)],
        r6(W.pct_change("v", 12, by), "yoy"), F.lag("v", 1).over(w).alias("lagged"), r6(F.col("v") / F.col("qv"), "valuation"),
    )


@query(
    "G23 P9 agent-style factor scores, clipped",
    SIGX + f""" f AS (SELECT symbol, ts, r, close/lag(close,20) OVER w-1 AS m20, lag(r) OVER w AS r1, z, vz FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, {TS}, round(least(greatest(m20*10,-1.0::DOUBLE),1.0::DOUBLE),9) AS momentum, round(least(greatest(-r1*50,-1.0::DOUBLE),1.0::DOUBLE),9) AS reversal, round(least(greatest(-z/2,-1.0::DOUBLE),1.0::DOUBLE),9) AS carry, round(-sign(r)*least(greatest(vz,0.0::DOUBLE),2.0::DOUBLE)/2,9) AS gamma, CAST(month(ts)=12 OR day(ts)>=28 AS INT) AS turn FROM f WHERE m20 IS NOT NULL AND z IS NOT NULL AND vz IS NOT NULL""",
)
def factor_scores(spark, sf):
    w = W.over()
    s = signal_frame(spark, sf).withColumn("m20", W.pct_change("close", 20)).withColumn("r1", F.lag("r").over(w)).where("m20 is not null and z is not null and vz is not null")
    turn = ((F.month("ts") == 12) | (F.day("ts") >= 28)).cast("int")
    return s.select(
        "symbol", day().alias("ts"), F.round(E.clip(F.col("m20") * 10, -1.0, 1.0), 9).alias("momentum"), F.round(E.clip(-F.col("r1") * 50, -1.0, 1.0), 9).alias("reversal"),
        F.round(E.clip(-F.col("z") / 2, -1.0, 1.0), 9).alias("carry"), F.round(-F.sign("r") * E.clip("vz", 0.0, 2.0) / 2, 9).alias("gamma"), turn.alias("turn"),
    )


@query(
    "G24 concentration: cap-weighted against equal-weighted index",
    B.with_(B.bars()).rstrip() + ", d AS (SELECT ts, sum(close*qty)/sum(qty) AS cw, avg(close) AS ew, count(*) AS k FROM bars GROUP BY ts) SELECT strftime(ts,'%Y-%m-%d') AS ts, round(cw/ew,8) AS ratio, k FROM d",
)
def concentration_ratio(spark, sf):
    d = market.bars(spark, sf).groupBy("ts").agg((F.sum(F.col("close") * F.col("qty")) / F.sum("qty")).alias("cw"), F.avg("close").alias("ew"), F.count(F.lit(1)).alias("k"))
    return d.select(day().alias("ts"), F.round(F.col("cw") / F.col("ew"), 8).alias("ratio"), "k")


@query(
    "D3 D4 D5 D6 D7 D8 D9 D10 D11 date and scalar functions over the order dates",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT strftime(d,'%Y-%m-%d') AS d, CAST(isodow(d)-1 AS INT) AS wd, strftime(CAST(d+CAST(((4-(isodow(d)-1)+7)%7)+4 AS INT) AS DATE),'%Y-%m-%d') AS tuesday,
    strftime(CAST(date_trunc('month',d) AS DATE)+CAST(14+(3-isodow(CAST(date_trunc('month',d) AS DATE)+14)+7)%7 AS INT),'%Y-%m-%d') AS third_wed, CAST(year(d)+CASE WHEN month(d)>=9 THEN 1 ELSE 0 END AS INT) AS target_year,
    strftime(CAST(date_trunc('month',d) AS DATE),'%Y-%m-%d') AS dec_date, strftime(last_day(d),'%Y-%m-%d') AS me, strftime(d + INTERVAL 1 MONTH,'%Y/%m') AS nxt, round(day(d)*sqrt(252),6) AS ann FROM d""",
)
def calendar_functions(spark, sf):
    d = market.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    decimal = F.year("d") + F.month("d") / 100
    return d.select(
        day("d").alias("d"), F.weekday("d").alias("wd"), day(E.publication_tuesday("d")).alias("tuesday"), day(E.third_wednesday("d")).alias("third_wed"), E.target_year("d").alias("target_year"),
        day(E.decimal_year_date(decimal)).alias("dec_date"), day(E.month_end("d")).alias("me"), F.date_format(F.add_months("d", 1), "yyyy/MM").alias("nxt"), r6(F.day("d") * F.sqrt(F.lit(252)), "ann"),
    )


@query(
    "D1 D2 D13 D14 D15 string, regex, array, map and JSON functions over event properties",
    """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props,'$.k') AS INT)) AS BIGINT) AS k_sum, CAST(max(CAST(regexp_extract(props,'(\\d+)',1) AS INT)) AS INT) AS k_max, upper(event_type)||lpad(CAST(count(DISTINCT user_id) AS VARCHAR),6,'0') AS tag, CAST(sum(len(props)) AS BIGINT) AS chars FROM events GROUP BY event_type""",
)
def event_properties(spark, sf):
    e = market.table(spark, sf, "events").withColumn("m", F.from_json("props", "map<string,int>"))
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.try_element_at("m", F.lit("k"))).alias("k_sum"), F.max(F.regexp_extract("props", r"(\d+)", 1).cast("int")).alias("k_max"),
        F.concat(F.upper("event_type"), F.lpad(F.count_distinct("user_id").cast("string"), 6, "0")).alias("tag"), F.sum(F.length("props").cast("long")).alias("chars"),
    )


