"""Leverage replay queries; oracles are recursive SQL over the bar position."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import machines as M
from tidemark.operators.asof import asof, latest_per_key
from tidemark.operators.fold import instrument_fold, leverage_fold, with_layers
from tidemark.operators.latch import latch
from tidemark.operators.linear import ols
from tidemark.operators.metrics import path_metrics
from tidemark.operators.quality import tolerance_gates
from tidemark.operators.projections import alternating_signals, with_previous
from tidemark.operators.signals import signal_frame
from tidemark.plans import base_sql as B
from tidemark.plans.registry import query
from tidemark.session import calendar_sized
from tidemark.sources import market


def latch_sql(name, x, on, off, part="symbol"):
    return (
        f"coalesce(last_value(CASE WHEN master=0 THEN 0 WHEN {x}{on} THEN 1 WHEN {x}{off} THEN 0 END IGNORE NULLS) "
        f"OVER (PARTITION BY {part} ORDER BY ts),0) AS {name}"
    )


LAYERS = f"""
lay0 AS (SELECT *, {latch_sql('in_credit', 'z', '>1.2', '<0.5')}, {latch_sql('in_vol', 'vz', '>1.5', '<0.5')},
  {latch_sql('in_ratio', 'iz', '>2.5', '<0.3')}, {latch_sql('in_liq', 'nlz', '<-1.5', '>-0.5')} FROM sig),
lay AS MATERIALIZED (SELECT *, CASE WHEN master=0 THEN 0 WHEN in_credit=1 THEN 1 WHEN in_ratio=1 THEN 2 WHEN in_vol=1 THEN 3 ELSE 5 END AS layer FROM lay0)"""


def run_sql(src="lay", key="symbol", stay="3.0", nsl=True, split=True, vz_lev="2.0", inf_lev="1.0", cr_lev="1.0", nl_lev="2.0", bps="25.0", cash="rate", extra=""):
    """Recursive replay: one step per bar for all keys at once."""
    win = "(held AND eq>basis)" if nsl else "TRUE"
    sw = "lv<>lev" if split else "FALSE"
    return f"""
run(k,pos,ts,eq,lev,pend,held,basis,trades,peq,plev,rt) AS (
  SELECT {key}, CAST(0 AS BIGINT), CAST(NULL AS DATE), 1.0::DOUBLE, 3.0::DOUBLE, -1.0::DOUBLE, FALSE, 1.0::DOUBLE, 0, 1.0::DOUBLE, 3.0::DOUBLE, 0.0::DOUBLE
  FROM {src} WHERE pos=1
  UNION ALL
  SELECT k, pos, ts, CASE WHEN pos>1 THEN greatest(eq*(1+gross+carry+csh-cost),0.001::DOUBLE) ELSE eq END, lv,
    CASE WHEN target<>lv THEN target ELSE -1.0::DOUBLE END, lv>0,
    CASE WHEN lv>0 AND NOT held THEN eq WHEN lev>0 AND lv>lev THEN (basis*lev+eq*(lv-lev))/lv ELSE basis END,
    trades+CASE WHEN lv<>lev THEN 1 ELSE 0 END, eq, lev, gross
  FROM (SELECT *, CASE WHEN {sw} THEN (1+lev*g)*(1+lv*i)-1 ELSE lv*rr END AS gross,
      CASE WHEN lv>1 THEN -(lv-1)*rate-0.0086::DOUBLE/252*least(lv/3,1.0::DOUBLE) ELSE 0.0::DOUBLE END AS carry,
      CASE WHEN lv=0 THEN {cash} ELSE 0.0::DOUBLE END AS csh, abs(lv-lev)*(({bps})::DOUBLE/10000) AS cost,
      CASE layer WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN CASE WHEN {win} THEN ({cr_lev})::DOUBLE ELSE ({stay})::DOUBLE END
        WHEN 2 THEN CASE WHEN {win} THEN ({inf_lev})::DOUBLE ELSE lv END WHEN 3 THEN CASE WHEN {win} THEN ({vz_lev})::DOUBLE ELSE lv END
        WHEN 4 THEN CASE WHEN {win} THEN ({nl_lev})::DOUBLE ELSE lv END ELSE 3.0::DOUBLE END AS target
    FROM (SELECT r.k, s.pos, s.ts, r.eq, r.lev, r.held, r.basis, r.trades, CASE WHEN r.pend>=0 THEN r.pend ELSE r.lev END AS lv,
        s.layer, s.rate, coalesce(s.r,0) AS rr, coalesce(s.gap,0) AS g, coalesce(s.intra,0) AS i{extra}
      FROM run r JOIN {src} s ON s.{key}=r.k AND s.pos=r.pos+1))),
path AS MATERIALIZED (SELECT * FROM run WHERE pos>0)"""


METRICS = """
dd AS (SELECT *, eq/max(eq) OVER (PARTITION BY k ORDER BY pos)-1 AS dd, eq/lag(eq) OVER (PARTITION BY k ORDER BY pos)-1 AS er FROM path),
met AS (SELECT k, count(*) AS n, arg_max(eq,pos) AS final, pow(arg_max(eq,pos),252.0::DOUBLE/count(*))-1 AS cagr, min(dd) AS mdd,
  coalesce(avg(er)/nullif(stddev_samp(er),0)*sqrt(252),0) AS sharpe, CAST(max(trades) AS INT) AS trades,
  avg(CASE WHEN lev>0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS in_market FROM dd GROUP BY k)"""


def recursive(*parts):
    return B.with_(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


ROUNDED = "CAST(n AS INT) AS n, round(final,5) AS final, round(cagr,5) AS cagr, round(mdd,5) AS mdd, round(sharpe,5) AS sharpe, trades, round(in_market,5) AS in_market"


def rounded(df, *keys):
    return df.select(*keys, "n", *[F.round(c, 5).alias(c) for c in ("final", "cagr", "mdd", "sharpe")], "trades", F.round("in_market", 5).alias("in_market"))


@query("E1 L1 L3 K1 K2 K3 K7 production leverage replay", recursive(*B.signal_frame(), LAYERS, run_sql(), METRICS) + f"SELECT k AS symbol, {ROUNDED} FROM met")
def leverage_backtest(spark, sf):
    return rounded(leverage_fold(with_layers(signal_frame(spark, sf), ["symbol"]), ["symbol"]), "symbol")


REAL = """
ri(k,pos,eq,lev,pend,held,basis) AS (SELECT symbol, CAST(0 AS BIGINT), 1.0::DOUBLE, 3.0::DOUBLE, -1.0::DOUBLE, FALSE, 1.0::DOUBLE FROM lay WHERE pos=1 UNION ALL
 SELECT k, pos, CASE WHEN pos>1 THEN greatest(eq*CASE WHEN lv<>lev THEN (1+lev*g)*(1+lv*i)*(1-abs(lv-lev)*0.0025::DOUBLE) WHEN lv=0 THEN 1+rate ELSE 1+(lv*rr-0.00002::DOUBLE*lv*(lv-1)) END,0.001::DOUBLE) ELSE eq END, lv, CASE WHEN tg<>lv THEN tg ELSE -1.0::DOUBLE END, lv>0, CASE WHEN lv>0 AND NOT held THEN eq ELSE basis END
 FROM (SELECT *, CASE layer WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN CASE WHEN held AND eq>basis THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END WHEN 2 THEN CASE WHEN held AND eq>basis THEN 1.0::DOUBLE ELSE lv END WHEN 3 THEN CASE WHEN held AND eq>basis THEN 2.0::DOUBLE ELSE lv END ELSE 3.0::DOUBLE END AS tg
  FROM (SELECT r.k, s.pos, r.eq, r.lev, r.held, r.basis, CASE WHEN r.pend>=0 THEN r.pend ELSE r.lev END AS lv, s.layer, s.rate, coalesce(s.r,0) AS rr, coalesce(s.gap,0) AS g, coalesce(s.intra,0) AS i FROM ri r JOIN lay s ON s.symbol=r.k AND s.pos=r.pos+1))),
rd AS (SELECT *, eq/max(eq) OVER (PARTITION BY k ORDER BY pos)-1 AS dd FROM ri WHERE pos>0)"""


@query("E3 replay on separate 3x, 2x and 1x instruments", recursive(*B.signal_frame(), LAYERS, REAL) + "SELECT k AS symbol, CAST(count(*) AS INT) AS n, round(arg_max(eq,pos),5) AS final, round(pow(arg_max(eq,pos),252.0::DOUBLE/count(*))-1,5) AS cagr, round(min(dd),5) AS mdd FROM rd GROUP BY 1")
def instrument_replay(spark, sf):
    inst = {k: {"r": k * F.col("r") - 0.00002 * k * (k - 1), "gap": k * F.col("gap"), "intra": k * F.col("intra")} for k in (3, 2, 1)}
    m = instrument_fold(with_layers(signal_frame(spark, sf), ["symbol"]), ["symbol"], inst)
    return m.select("symbol", "n", *[F.round(c, 5).alias(c) for c in ("final", "cagr", "mdd")])


def renamed(sql: str, names: tuple[str, ...], suffix: str) -> str:
    """The CTEs under other names, so that a second run stands beside the first."""
    for n in names:
        sql = re.sub(rf"(?<=FROM ){n}\b|(?<=JOIN ){n}\b|\b{n}(?= AS (MATERIALIZED )?\()|\b{n}(?=\(k,)", n + suffix, sql)
    return sql


CLOSE_RUN = renamed(run_sql(split=False), ("run", "path"), "_c") + "," + renamed(METRICS, ("path", "dd", "met"), "_c")
GATES = """, rm AS (SELECT k, pow(arg_max(eq,pos),252.0::DOUBLE/count(*))-1 AS cagr, min(dd) AS mdd FROM rd GROUP BY 1),
 mm AS (SELECT met.k AS symbol, met.cagr AS o, met_c.cagr AS c, rm.cagr AS i, met.mdd AS mo, rm.mdd AS mi FROM met JOIN met_c ON met_c.k=met.k JOIN rm ON rm.k=met.k)
 SELECT symbol, gate, round(base,5) AS base, round(other,5) AS other, round(abs(base-other),5) AS gap, tolerance, abs(base-other)<tolerance AS ok FROM (
 SELECT symbol, 'instruments_cagr' AS gate, o AS base, i AS other, 0.15::DOUBLE AS tolerance FROM mm UNION ALL SELECT symbol, 'close_to_close_cagr', o, c, 0.05::DOUBLE FROM mm UNION ALL SELECT symbol, 'instruments_mdd', mo, mi, 0.15::DOUBLE FROM mm)"""


@query(
    "Q7 E1 E3 model comparison gates: replay on scaled returns against instruments (15 points) and against close-to-close fills (5 points)",
    recursive(*B.signal_frame(), LAYERS, run_sql(), METRICS, CLOSE_RUN, REAL) + GATES,
)
def model_gates(spark, sf):
    s = with_layers(signal_frame(spark, sf), ["symbol"])
    inst = {k: {"r": k * F.col("r") - 0.00002 * k * (k - 1), "gap": k * F.col("gap"), "intra": k * F.col("intra")} for k in (3, 2, 1)}
    models = {"open": leverage_fold(s, ["symbol"]), "close": leverage_fold(s, ["symbol"], next_open=False), "instruments": instrument_fold(s, ["symbol"], inst)}
    return tolerance_gates(models, ["symbol"], "open", [("instruments_cagr", "instruments", "cagr", 0.15), ("close_to_close_cagr", "close", "cagr", 0.05), ("instruments_mdd", "instruments", "mdd", 0.15)]).select(
        "symbol", "gate", *[F.round(c, 5).alias(c) for c in ("base", "other", "gap")], "tolerance", "ok"
    )


TC_RUN = renamed(run_sql(bps="200.0"), ("run", "path"), "_t") + "," + renamed(METRICS, ("path", "dd", "met"), "_t")
ONLY_RUN = "lay_p AS (SELECT *, CASE WHEN master=0 THEN 0 ELSE 5 END AS layer FROM sig)," + renamed(run_sql(src="lay_p"), ("run", "path"), "_p") + "," + renamed(METRICS, ("path", "dd", "met"), "_p")
CHECKS = """docs_ok rates_complete returns_complete gap_ok long_enough exit_events signals_mapped next_day_execution beats_hold_return beats_hold_drawdown overlay_improves_drawdown
 sharpe_ok trades_ok drawdown_ok costs_200_sharpe trades_per_year_ok instruments_within_15 close_fills_within_5 has_trades turnover_ok alive exposure_ok signals_present no_repeated_day costs_reduce_return""".split()
CHECK_SQL = f""", rm AS (SELECT k, pow(arg_max(eq,pos),252.0::DOUBLE/count(*))-1 AS cagr FROM rd GROUP BY 1),
 oc AS (SELECT series_id, count(*) AS docs FROM obs GROUP BY 1), pm AS (SELECT max(md) FILTER (signal<>'') <= (SELECT max(ts) FROM cal) AS mapped FROM psig),
 da AS (SELECT symbol, any_value({B.SID}) AS sid, count(rate)=count(*) AS rates, count(*)-count(r)<=1 AS rets, max(abs((1+gap)*(1+intra)-1-r))<0.0001 AS gap, count(*)>252 AS long, count(*) FILTER (master=0)>0 AS exits, count(z)>0 AND count(vz)>0 AS sigs, count(DISTINCT ts)=count(*) AS days FROM sig GROUP BY 1),
 h0 AS (SELECT symbol, pos, exp(sum(ln(greatest(1+3*coalesce(r,0),0.001::DOUBLE))) OVER (PARTITION BY symbol ORDER BY pos)) AS eq FROM sig), h1 AS (SELECT *, eq/max(eq) OVER (PARTITION BY symbol ORDER BY pos)-1 AS dd FROM h0), ho AS (SELECT symbol, pow(arg_max(eq,pos),252.0::DOUBLE/count(*))-1 AS cagr, min(dd) AS mdd FROM h1 GROUP BY 1),
 dl AS (SELECT k, coalesce(bool_and(ts>pts) FILTER (lev<>plev0),TRUE) AS ok FROM (SELECT k, ts, lev, lag(lev) OVER w AS plev0, lag(ts) OVER w AS pts FROM path WINDOW w AS (PARTITION BY k ORDER BY pos)) GROUP BY 1),
 cj AS (SELECT da.symbol, docs>=20 AS docs_ok, rates AS rates_complete, rets AS returns_complete, gap AS gap_ok, long AS long_enough, exits AS exit_events, mapped AS signals_mapped, dl.ok AS next_day_execution, met.cagr>ho.cagr AS beats_hold_return, met.mdd>ho.mdd AS beats_hold_drawdown, met.mdd>met_p.mdd AS overlay_improves_drawdown,
  met.sharpe>1.33 AS sharpe_ok, met.trades<80 AS trades_ok, met.mdd>= -0.45 AS drawdown_ok, met_t.sharpe>1 AS costs_200_sharpe, met.trades*252.0::DOUBLE/met.n<=5 AS trades_per_year_ok, abs(met.cagr-rm.cagr)<0.15 AS instruments_within_15, abs(met.cagr-met_c.cagr)<0.05 AS close_fills_within_5, met.trades>=1 AS has_trades, met.trades*252.0::DOUBLE/met.n<60 AS turnover_ok, met.final>0.001 AS alive, met.in_market BETWEEN 0.2 AND 1 AS exposure_ok, sigs AS signals_present, days AS no_repeated_day, met_t.cagr<=met.cagr AS costs_reduce_return
  FROM da JOIN met ON met.k=da.symbol JOIN met_c ON met_c.k=da.symbol JOIN met_t ON met_t.k=da.symbol JOIN met_p ON met_p.k=da.symbol JOIN rm ON rm.k=da.symbol JOIN ho ON ho.symbol=da.symbol JOIN dl ON dl.k=da.symbol JOIN oc ON oc.series_id=da.sid, pm)
 SELECT symbol, "check", ok FROM cj UNPIVOT (ok FOR "check" IN ({", ".join(CHECKS)}))"""


@query(
    "I23 Q2 Q3 Q4 Q7 the whole structural checklist: data, execution, performance, cost stress and model comparison",
    recursive(*B.signal_frame(), LAYERS, run_sql(), METRICS, CLOSE_RUN, TC_RUN, ONLY_RUN, REAL) + CHECK_SQL,
)
def full_checklist(spark, sf):
    by = ["symbol"]
    sig = signal_frame(spark, sf)
    s = with_layers(sig, by)
    inst = {k: {"r": k * F.col("r") - 0.00002 * k * (k - 1), "gap": k * F.col("gap"), "intra": k * F.col("intra")} for k in (3, 2, 1)}
    metrics = ("n", "final", "cagr", "mdd", "sharpe", "trades", "in_market")
    of = lambda m, tag, cols: m.select("symbol", *[F.col(c).alias(f"{tag}_{c}") for c in cols])
    base = leverage_fold(s, by)
    late = F.exists("log", lambda t: t["exec_date"] <= t["signal_date"])
    m = base.select("symbol", *metrics, (~F.coalesce(late, F.lit(False))).alias("next_day"))
    m = m.join(of(leverage_fold(s, by, next_open=False), "close", ["cagr"]), by).join(of(instrument_fold(s, by, inst), "inst", ["cagr"]), by)
    m = m.join(of(leverage_fold(s, by, p={"tc_bps": 200.0}), "tc", ["cagr", "sharpe"]), by)
    m = m.join(of(leverage_fold(with_layers(sig, by, credit=False, vol=False, ratio=False), by), "only", ["mdd"]), by)
    run = Window.partitionBy("symbol").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hold = sig.withColumn("eq", F.exp(F.sum(F.log(F.greatest(1 + 3 * F.coalesce("r", F.lit(0.0)), F.lit(0.001)))).over(run))).withColumn("dd", F.col("eq") / F.max("eq").over(run) - 1)
    hold = hold.groupBy("symbol").agg((F.pow(F.max_by("eq", "pos"), 252.0 / F.count(F.lit(1))) - 1).alias("hold_cagr"), F.min("dd").alias("hold_mdd"))
    n = F.count(F.lit(1))
    data = sig.groupBy("symbol").agg(
        (F.count("rate") == n).alias("rates"), (n - F.count("r") <= 1).alias("rets"), (F.max(F.abs((1 + F.col("gap")) * (1 + F.col("intra")) - 1 - F.col("r"))) < 0.0001).alias("gap_fits"), (n > 252).alias("long"),
        (F.count_if(F.col("master") == 0) > 0).alias("exits"), ((F.count("z") > 0) & (F.count("vz") > 0)).alias("sigs"), (F.count_distinct("ts") == n).alias("days"),
    )
    docs = market.observations(spark, sf).groupBy("series_id").agg(F.count(F.lit(1)).alias("docs"))
    data = data.withColumn("series_id", market.series_of_symbol()).join(docs, "series_id")
    # two single rows: the last signal and the last trading day
    ev = alternating_signals(with_previous(market.projections(spark, sf))).where("signal <> ''").agg(F.max("meeting_date").alias("md")).withColumn("__k", F.lit(1))
    ends = market.calendar(spark, sf).agg(F.max("ts").alias("last")).withColumn("__k", F.lit(1)).join(F.broadcast(ev), "__k")
    m = m.join(data, by).join(hold, by).withColumn("__k", F.lit(1)).join(F.broadcast(ends.select("__k", (F.col("md") <= F.col("last")).alias("mapped"))), "__k")
    c, per_year = F.col, F.col("trades") * 252.0 / F.col("n")
    tests = [
        c("docs") >= 20, c("rates"), c("rets"), c("gap_fits"), c("long"), c("exits"), c("mapped"), c("next_day"), c("cagr") > c("hold_cagr"), c("mdd") > c("hold_mdd"), c("mdd") > c("only_mdd"),
        c("sharpe") > 1.33, c("trades") < 80, c("mdd") >= -0.45, c("tc_sharpe") > 1, per_year <= 5, F.abs(c("cagr") - c("inst_cagr")) < 0.15, F.abs(c("cagr") - c("close_cagr")) < 0.05, c("trades") >= 1, per_year < 60,
        c("final") > 0.001, c("in_market").between(0.2, 1), c("sigs"), c("days"), c("tc_cagr") <= c("cagr"),
    ]
    return m.select("symbol", *[t.alias(k) for k, t in zip(CHECKS, tests)]).unpivot(["symbol"], CHECKS, "check", "ok")


@query(
    "E16 E13 fire-once events met by equality on the day after, cash yield while out",
    B.with_(*B.signal_frame()).rstrip() + """, ev AS (SELECT ts, arg_max(signal,md) AS signal FROM (SELECT (SELECT min(ts) FROM cal WHERE ts>=md+1) AS ts, md, signal FROM psig WHERE signal<>'') WHERE ts IS NOT NULL GROUP BY 1),
    st AS (SELECT s.*, coalesce(last_value(CASE signal WHEN 'ENTER' THEN 1 WHEN 'EXIT' THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY s.ts),1) AS st FROM sig s LEFT JOIN ev ON ev.ts=s.ts), rr AS (SELECT symbol, ts, CASE WHEN coalesce(lag(st) OVER (PARTITION BY symbol ORDER BY ts),1)=1 THEN coalesce(r,0) ELSE rate END AS sr FROM st), e AS (SELECT *, product(1+sr) OVER (PARTITION BY symbol ORDER BY ts) AS eq FROM rr), d AS (SELECT *, eq/max(eq) OVER (PARTITION BY symbol ORDER BY ts)-1 AS dd FROM e)
    SELECT symbol, count(*) AS n, round(arg_max(eq,ts),5) AS final, round(min(dd),6) AS mdd, round(avg(sr)/stddev_pop(sr)*sqrt(252),5) AS sharpe FROM d GROUP BY 1""",
)
def event_driven_strategy(spark, sf):
    s = signal_frame(spark, sf)
    cal = market.calendar(spark, sf).select("cal_id", "ts").withColumn("use_on", F.col("ts"))
    ev = alternating_signals(with_previous(market.projections(spark, sf))).where("signal <> ''")
    ev = ev.select(F.lit("X").alias("cal_id"), F.date_add("meeting_date", 1).alias("ts"), "meeting_date", "state")
    ev = asof(ev, cal, ["cal_id"], "ts", ["use_on"], "forward").where("use_on is not null").select(F.col("use_on").alias("ts"), "meeting_date", "state")
    s = s.join(calendar_sized(latest_per_key(ev, ["ts"], "meeting_date", ["state"])), "ts", "left").withColumn("st", latch(F.col("state"), initial=1))
    m = path_metrics(M.in_out_returns(s, "st", cash=F.col("rate")))
    return m.select("symbol", "n", F.round("final", 5).alias("final"), F.round("mdd", 6).alias("mdd"), F.round("sharpe", 5).alias("sharpe"))


@query(
    "P17 A10 regression with one calendar block excluded from training",
    B.with_(*B.signal_frame()) + "SELECT symbol, count(*) AS n_obs, round(regr_slope(r,gap),6) AS beta, round(regr_intercept(r,gap),8) AS intercept FROM sig WHERE r IS NOT NULL AND gap IS NOT NULL AND NOT (ts BETWEEN DATE '1998-01-01' AND DATE '1998-12-31') GROUP BY 1",
)
def regression_without_block(spark, sf):
    m = ols(signal_frame(spark, sf).where("not ts between date'1998-01-01' and date'1998-12-31'"), ["symbol"], ["gap"], "r")
    return m.select("symbol", "n_obs", F.round("beta_gap", 6).alias("beta"), F.round("intercept", 8).alias("intercept"))
