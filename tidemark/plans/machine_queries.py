"""Latches, machines, episodes, memoryless strategies and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.expr import clip
from tidemark.operators import machines as M
from tidemark.operators import metrics as K
from tidemark.operators import windows as W
from tidemark.operators.asof import asof
from tidemark.operators.episodes import blocks, cooled_episodes, drawdown_episodes
from tidemark.operators.fold import with_layers
from tidemark.operators.latch import latch, latch_event
from tidemark.operators.signals import signal_frame
from tidemark.plans import base_sql as B
from tidemark.plans.base_queries import day
from tidemark.plans.fold_queries import LAYERS
from tidemark.plans.registry import query
from tidemark.functions.expr import publication_tuesday

SIG = B.with_(*B.signal_frame())
SIGX = SIG.rstrip() + ","
RSIGX = SIGX.replace("WITH ", "WITH RECURSIVE ", 1)
TS = "strftime(ts,'%Y-%m-%d') AS ts"
r6 = lambda c, n=None: F.round(c, 6).alias(n or c)


@query("L1 L3 hysteresis latches and priority", SIGX + LAYERS + f" SELECT symbol, {TS}, CAST(in_credit AS INT) AS in_credit, CAST(in_ratio AS INT) AS in_ratio, CAST(in_vol AS INT) AS in_vol, CAST(in_liq AS INT) AS in_liq, CAST(layer AS INT) AS layer FROM lay")
def latched_layers(spark, sf):
    s = with_layers(signal_frame(spark, sf), ["symbol"], liq=True)
    s = s.withColumn("layer", F.when(F.col("layer") == 4, 5).otherwise(F.col("layer")))
    return s.select("symbol", day().alias("ts"), "in_credit", "in_ratio", "in_vol", "in_liq", F.col("layer").cast("int"))


WK = f""" wk AS (SELECT symbol, CAST(ts+CAST((5-isodow(ts)+7)%7 AS INT) AS DATE) AS wts, arg_max(z,ts) AS z, arg_max(vz,ts) AS vz FROM sig GROUP BY 1,2),
 wl AS (SELECT symbol, wts, coalesce(last_value(CASE WHEN coalesce(z,0)>1.0 THEN 1 WHEN coalesce(z,0)<0.5 THEN 0 END IGNORE NULLS) OVER w,0) AS a, coalesce(last_value(CASE WHEN coalesce(vz,0)>1.5 THEN 1 WHEN coalesce(vz,0)<0.5 THEN 0 END IGNORE NULLS) OVER w,0) AS b FROM wk WINDOW w AS (PARTITION BY symbol ORDER BY wts))"""


@query("L4 weekly any-danger latch, missing counts as zero", SIGX + WK + " SELECT symbol, strftime(wts,'%Y-%m-%d') AS ts, CAST(greatest(a,b) AS INT) AS danger FROM wl")
def weekly_danger(spark, sf):
    w = weekly(spark, sf)
    a, b = (latch(latch_event(c, hi, 0.5, on_null="zero")) for c, hi in (("z", 1.0), ("vz", 1.5)))
    return w.select("symbol", day().alias("ts"), F.greatest(a, b).alias("danger"))


def weekly(spark, sf):
    """Friday-labelled weeks; the week's last row speaks, missing or not."""
    from tidemark.functions.expr import week_ending

    g = signal_frame(spark, sf).withColumn("wts", week_ending("ts", "FR")).groupBy("symbol", "wts").agg(F.max_by(F.struct("z", "vz", "close"), "ts").alias("v"))
    return g.select("symbol", F.col("wts").alias("ts"), "v.*")


HOLD = """
hm(k,pos,st,hold) AS (SELECT symbol, CAST(0 AS BIGINT), 1, 0 FROM cond WHERE pos=1
 UNION ALL SELECT k, pos, CASE WHEN st=1 THEN CASE WHEN e THEN 0 ELSE 1 END WHEN hold+1>={hold} AND n THEN 1 ELSE 0 END, CASE WHEN st=1 THEN CASE WHEN e THEN 0 ELSE hold END ELSE hold+1 END
 FROM (SELECT h.k, c.pos, h.st, h.hold, c.e, c.n FROM hm h JOIN cond c ON c.symbol=h.k AND c.pos=h.pos+1)),
hs AS MATERIALIZED (SELECT s.symbol, s.ts, s.pos, s.r, s.rate, s.close, h.st AS state FROM hm h JOIN sig s ON s.symbol=h.k AND s.pos=h.pos)"""


def cond_sql(e, n):
    return f" cond AS MATERIALIZED (SELECT symbol, pos, ts, coalesce({e},FALSE) AS e, coalesce({n},FALSE) AS n FROM sig),"


@query("E4 W24 two-state machine with a minimum hold of 42 rows", RSIGX + cond_sql("z>1.0 AND iz>0", "vz<0.5") + HOLD.format(hold=42) + f" SELECT symbol, {TS}, CAST(state AS INT) AS state FROM hs")
def hold_machine_state(spark, sf):
    s = signal_frame(spark, sf)
    sw = M.hold_machine(s, (F.col("z") > 1.0) & (F.col("iz") > 0), F.col("vz") < 0.5, 42)
    return M.with_state(s, sw).select("symbol", day().alias("ts"), "state")


TOGGLES = [(c, v, o) for c in (0, 1) for v in (0, 1) for o in (0, 1)]


@query(
    "E5 enhanced machine: condition switches as variant columns",
    RSIGX + " v(vid,uc,uv,un) AS (VALUES " + ",".join(f"({i},{c},{v},{o})" for i, (c, v, o) in enumerate(TOGGLES)) + """),
 cond AS MATERIALIZED (SELECT symbol||'-'||vid AS symbol, vid, pos, coalesce(z>1.0,FALSE) OR (uc=1 AND coalesce(iz>2.0,FALSE)) OR (uv=1 AND coalesce(vz>1.5,FALSE)) AS e, coalesce(z<0.5,FALSE) AND (un=0 OR coalesce(vz<1.0,FALSE)) AS n FROM sig JOIN v ON TRUE),"""
    + HOLD.format(hold=21).split("hs AS")[0].rstrip().rstrip(",") + " SELECT substr(k,1,2) AS symbol, CAST(substr(k,4) AS INT) AS variant, count(*) AS n, CAST(sum(1-st) AS BIGINT) AS days_out FROM hm WHERE pos>0 GROUP BY 1,2",
)
def toggled_machine(spark, sf):
    s = signal_frame(spark, sf)
    v = F.explode(F.array(*[F.struct(F.lit(i).alias("variant"), F.lit(c).alias("uc"), F.lit(x).alias("uv"), F.lit(o).alias("un")) for i, (c, x, o) in enumerate(TOGGLES)]))
    yes = lambda c: F.coalesce(c, F.lit(False))
    s = s.withColumn("v", v).select("*", "v.*").drop("v")
    ex = yes(F.col("z") > 1.0) | ((F.col("uc") == 1) & yes(F.col("iz") > 2.0)) | ((F.col("uv") == 1) & yes(F.col("vz") > 1.5))
    en = yes(F.col("z") < 0.5) & ((F.col("un") == 0) | yes(F.col("vz") < 1.0))
    by = ("symbol", "variant")
    st = M.with_state(s, M.hold_machine(s, ex, en, 21, by=by), by=by)
    return st.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("state")).alias("days_out"))


PROB = " pr AS MATERIALIZED (SELECT *, coalesce(round(1/(1+exp(-z)),6),0.5::DOUBLE) AS p, coalesce(last_value(CASE WHEN vz>1.5 THEN 1 WHEN vz<0.5 THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts),0) AS zs FROM sig),"


@query(
    "E6 probability hysteresis machines A, B and C",
    RSIGX + PROB + """ cond AS MATERIALIZED (SELECT symbol||m AS symbol, m, pos, CASE m WHEN 'A' THEN p>0.7 WHEN 'B' THEN zs=1 OR p>0.7 ELSE zs=1 END AS e, CASE m WHEN 'A' THEN p<0.5 ELSE zs=0 AND p<0.5 END AS n FROM pr JOIN (VALUES ('A'),('B'),('C')) t(m) ON TRUE),"""
    + HOLD.format(hold=4).split("hs AS")[0].rstrip().rstrip(",") + " SELECT substr(k,1,2) AS symbol, substr(k,3) AS version, CAST(sum(1-st) AS BIGINT) AS defensive FROM hm WHERE pos>0 GROUP BY 1,2",
)
def probability_machines(spark, sf):
    s = signal_frame(spark, sf)
    s = s.withColumn("p", F.coalesce(F.round(1 / (1 + F.exp(-F.col("z"))), 6), F.lit(0.5))).withColumn("zs", latch(latch_event("vz", 1.5, 0.5)))
    s = s.withColumn("version", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))))
    v, p, zs = F.col("version"), F.col("p"), F.col("zs")
    ex = F.when(v == "A", p > 0.7).when(v == "B", (zs == 1) | (p > 0.7)).otherwise(zs == 1)
    en = F.when(v == "A", p < 0.5).otherwise((zs == 0) & (p < 0.5))
    by = ("symbol", "version")
    st = M.with_state(s, M.hold_machine(s, ex, en, 4, by=by), by=by)
    return st.groupBy(*by).agg(F.sum(1 - F.col("state")).alias("defensive"))


@query(
    "E7 machine with per-fold thresholds; the state carries over",
    RSIGX + " cond AS MATERIALIZED (SELECT symbol, pos, ts, coalesce(z>CASE WHEN year(ts)%2=0 THEN 1.5 ELSE 1.0 END,FALSE) AS e, coalesce(z<CASE WHEN year(ts)%2=0 THEN 0.2 ELSE 0.5 END,FALSE) AS n FROM sig)," + HOLD.format(hold=4) + " SELECT symbol, CAST(year(ts) AS INT) AS yr, CAST(sum(1-state) AS BIGINT) AS days_out FROM hs GROUP BY 1,2",
)
def fold_parameter_machine(spark, sf):
    s = signal_frame(spark, sf)
    even = F.year("ts") % 2 == 0
    sw = M.hold_machine(s, F.col("z") > F.when(even, 1.5).otherwise(1.0), F.col("z") < F.when(even, 0.2).otherwise(0.5), 4)
    return M.with_state(s, sw).groupBy("symbol", F.year("ts").alias("yr")).agg(F.sum(1 - F.col("state")).alias("days_out"))


PMET = """
eqs AS (SELECT symbol, ts, sr, product(1+sr) OVER (PARTITION BY symbol ORDER BY ts) AS eq FROM rets), dds AS (SELECT *, eq/max(eq) OVER (PARTITION BY symbol ORDER BY ts)-1 AS dd FROM eqs),
pm AS (SELECT symbol, count(*) AS n, round(arg_max(eq,ts),5) AS final, round(min(dd),6) AS mdd, round(coalesce(avg(sr)/nullif(stddev_pop(sr),0)*sqrt(252),0),5) AS sharpe, round(pow(arg_max(eq,ts),252.0::DOUBLE/count(*))-1,6) AS cagr FROM dds GROUP BY symbol)"""


def slim(m, *keys):
    return m.select(*keys, "n", F.round("final", 5).alias("final"), r6("mdd"), F.round("sharpe", 5).alias("sharpe"), r6("cagr"))


@query(
    "E13 generic IN/OUT runner: same-close execution, cash yield while out",
    RSIGX + cond_sql("z>1.0", "z<0") + HOLD.format(hold=1) + ", rets AS (SELECT symbol, ts, CASE WHEN coalesce(lag(state) OVER (PARTITION BY symbol ORDER BY ts),1)=1 THEN coalesce(r,0) ELSE rate END AS sr FROM hs)," + PMET + " SELECT * FROM pm",
)
def in_out_strategy(spark, sf):
    s = signal_frame(spark, sf)
    st = M.with_state(s, M.hold_machine(s, F.col("z") > 1.0, F.col("z") < 0, 1))
    return slim(K.path_metrics(M.in_out_returns(st, "state", cash=F.col("rate"))), "symbol")


@query(
    "E13 P20 trade list with reasons; last trade may still be open",
    RSIGX + cond_sql("z>1.0", "z<0") + HOLD.format(hold=1) + """, sw AS (SELECT *, lag(state,1,1) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM hs), ch AS (SELECT symbol, ts, close, state FROM sw WHERE state<>p),
    pr AS (SELECT *, lead(ts) OVER w AS ets, lead(close) OVER w AS ec FROM ch WINDOW w AS (PARTITION BY symbol ORDER BY ts)), lastc AS (SELECT symbol, max(ts) AS lts, arg_max(close,ts) AS lc FROM sig GROUP BY 1)
    SELECT symbol, strftime(ts,'%Y-%m-%d') AS exit_ts, strftime(coalesce(ets,lts),'%Y-%m-%d') AS entry_ts, round(coalesce(ec,lc)/close-1,6) AS ret, ets IS NULL AS still_out FROM pr JOIN lastc USING (symbol) WHERE state=0 AND date_diff('day',ts,coalesce(ets,lts))>5""",
)
def in_out_trades(spark, sf):
    """Also P20: trades out for five calendar days or less are dropped as noise."""
    s = signal_frame(spark, sf)
    sw = M.hold_machine(s, F.col("z") > 1.0, F.col("z") < 0, 1).join(s.select("symbol", "ts", "close"), ["symbol", "ts"])
    w = W.over()
    p = sw.withColumn("ets", F.lead("ts").over(w)).withColumn("ec", F.lead("close").over(w)).where("state = 0")
    last = s.groupBy("symbol").agg(F.max("ts").alias("lts"), F.max_by("close", "ts").alias("lc"))
    p = p.join(last, "symbol").withColumn("end", F.coalesce("ets", "lts")).where(F.datediff("end", "ts") > 5)
    return p.select("symbol", day().alias("exit_ts"), day("end").alias("entry_ts"), r6(F.coalesce("ec", "lc") / F.col("close") - 1, "ret"), F.col("ets").isNull().alias("still_out"))


@query(
    "E14 X5 cool-down exits: 60 calendar days since the last fired exit",
    RSIGX + cond_sql("z>1.0", "z<0.5") + """
 cm(k,pos,st,fired) AS (SELECT symbol, CAST(0 AS BIGINT), 1, DATE '1900-01-01' FROM cond WHERE pos=1 UNION ALL
  SELECT k, pos, CASE WHEN st=1 THEN CASE WHEN e AND ts-fired>=60 THEN 0 ELSE 1 END WHEN n THEN 1 ELSE 0 END, CASE WHEN st=1 AND e AND ts-fired>=60 THEN ts ELSE fired END
  FROM (SELECT h.k, c.pos, c.ts, h.st, h.fired, c.e, c.n FROM cm h JOIN cond c ON c.symbol=h.k AND c.pos=h.pos+1))
 SELECT k AS symbol, strftime(fired,'%Y-%m-%d') AS exit_ts FROM (SELECT DISTINCT k, fired FROM cm WHERE fired>DATE '1900-01-01')""",
)
def cooldown_exits(spark, sf):
    sw = M.hold_machine(signal_frame(spark, sf), F.col("z") > 1.0, F.col("z") < 0.5, 0, cooldown_days=60)
    return sw.where("state = 0").select("symbol", day().alias("exit_ts"))


@query(
    "E15 X1 context-conditional re-entry",
    RSIGX + """ cx AS MATERIALIZED (SELECT symbol, pos, ts, coalesce(z>1.0,FALSE) AS e, coalesce(iz>0.3,FALSE) AS hi, coalesce(iz<=0.3,FALSE) AS lo, coalesce(vz< -1.0,FALSE) AS nm FROM sig),
 cr(k,pos,ts,st,late,above,rs) AS (SELECT symbol, CAST(0 AS BIGINT), CAST(NULL AS DATE), 1, FALSE, FALSE, '' FROM cx WHERE pos=1 UNION ALL
  SELECT k, pos, ts, CASE WHEN st=1 THEN CASE WHEN e THEN 0 ELSE 1 END WHEN back THEN 1 ELSE 0 END, CASE WHEN st=1 AND e THEN lo ELSE late END, CASE WHEN st=1 THEN CASE WHEN e THEN hi ELSE above END ELSE ab END,
   CASE WHEN st=1 AND e THEN 'exit' WHEN st=0 AND back THEN CASE WHEN late THEN 'recovery' WHEN ab AND lo THEN 'new_low' ELSE 'normalised' END ELSE '' END
  FROM (SELECT *, CASE WHEN late THEN hi ELSE (ab AND lo) OR nm END AS back FROM (SELECT h.k, c.pos, c.ts, h.st, h.late, h.above, h.above OR c.hi AS ab, c.e, c.hi, c.lo, c.nm FROM cr h JOIN cx c ON c.symbol=h.k AND c.pos=h.pos+1)))
 SELECT k AS symbol, strftime(ts,'%Y-%m-%d') AS ts, CAST(st AS INT) AS state, rs AS reason FROM cr WHERE rs<>''""",
)
def conditional_reentry_trades(spark, sf):
    sw = M.conditional_reentry(signal_frame(spark, sf), F.col("z") > 1.0, F.col("iz"), 0.3, F.col("vz") < -1.0)
    return sw.select("symbol", day().alias("ts"), "state", "reason")


HYB = " ab AS MATERIALIZED (SELECT symbol, ts, pos, CAST(master AS INT) AS a, CASE WHEN coalesce(last_value(CASE WHEN z>1.0 THEN 1 WHEN z<0.5 THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts),0)=1 THEN 0 ELSE 1 END AS b FROM sig)"


@query(
    "E22 hybrids of two states: H1, H2, H3",
    RSIGX + HYB + """, h3(k,pos,st,wants) AS (SELECT symbol, CAST(0 AS BIGINT), 1, TRUE FROM ab WHERE pos=1 UNION ALL SELECT h.k, c.pos, CASE WHEN h.st=1 THEN c.a WHEN (h.wants OR c.a=1) AND c.b=1 THEN 1 ELSE 0 END, CASE WHEN h.st=1 THEN CASE WHEN c.a=0 THEN FALSE ELSE h.wants END ELSE h.wants OR c.a=1 END FROM h3 h JOIN ab c ON c.symbol=h.k AND c.pos=h.pos+1)
 SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, CAST(coalesce(last_value(CASE WHEN a=0 THEN 0 WHEN b=1 THEN 1 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts),1) AS INT) AS h1, CAST(a*b AS INT) AS h2, CAST(h3.st AS INT) AS h3 FROM ab JOIN h3 ON h3.k=ab.symbol AND h3.pos=ab.pos""",
)
def hybrid_states(spark, sf):
    s = signal_frame(spark, sf).withColumn("a", F.col("master").cast("int")).withColumn("b", 1 - latch(latch_event("z", 1.0, 0.5)))
    a, b = F.col("a"), F.col("b")
    s = s.withColumn("h1", latch(F.when(a == 0, 0).when(b == 1, 1), initial=1)).withColumn("h2", a * b)
    s = M.with_state(s, M.confirmed_return(s, a, b), "h3")
    return s.select("symbol", day().alias("ts"), "h1", "h2", "h3")


@query(
    "E17 weekly signal overlaid on days: as-of, shifted by one, missing counts as zero",
    SIGX + WK + """, j AS (SELECT s.symbol, s.ts, s.r, s.master, CASE WHEN w.a=1 OR w.b=1 THEN 1 ELSE 0 END AS d FROM sig s ASOF LEFT JOIN wl w ON w.symbol=s.symbol AND s.ts>=w.wts)
    SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, CAST(CASE WHEN coalesce(lag(d) OVER (PARTITION BY symbol ORDER BY ts),0)=1 THEN 0 ELSE master END AS INT) AS eff FROM j""",
)
def weekly_overlay(spark, sf):
    w = weekly(spark, sf)
    a, b = (latch(latch_event(c, hi, 0.5, on_null="zero")) for c, hi in (("z", 1.0), ("vz", 1.5)))
    w = w.select("symbol", "ts", F.greatest(a, b).alias("d"))
    s = asof(signal_frame(spark, sf).select("symbol", "ts", "master"), w, ["symbol"], "ts", ["d"])
    hostile = F.coalesce(F.lag(F.coalesce("d", F.lit(0))).over(W.over()), F.lit(0)) == 1
    return s.select("symbol", day().alias("ts"), F.when(hostile, 0).otherwise(F.col("master")).cast("int").alias("eff"))


@query(
    "E18 E19 K4 K5 K7 memoryless leverage: volatility target with turnover cost, full metric set",
    SIGX + f""" l0 AS (SELECT *, {B.std('r', 20)}*sqrt(252) AS rv FROM sig), l1 AS (SELECT *, coalesce(lag(CASE WHEN rv IS NOT NULL THEN least(greatest(0.15/rv,0.5),3.0) ELSE 1.0 END) OVER (PARTITION BY symbol ORDER BY ts),1.0) AS lev FROM l0),
    rets AS (SELECT symbol, ts, lev, lev*coalesce(r,0)-abs(lev-coalesce(lag(lev) OVER (PARTITION BY symbol ORDER BY ts),lev))*(10.0::DOUBLE/10000) AS sr FROM l1),""" + PMET + """, x AS (SELECT symbol, round(avg(sr)/sqrt(avg(CASE WHEN sr<0 THEN sr*sr END))*sqrt(252),5) AS sortino, round(sum(CASE WHEN sr>0 THEN sr END)/abs(sum(CASE WHEN sr<0 THEN sr END)),5) AS omega FROM rets GROUP BY 1)
    SELECT pm.*, sortino, omega, round(cagr/abs(mdd),3) AS calmar FROM pm JOIN x USING (symbol)""",
)
def volatility_target(spark, sf):
    s = W.with_rolling(signal_frame(spark, sf), {"v": ("r", 20)}).withColumn("rv", F.col("v_std") * F.sqrt(F.lit(252)))
    lev = F.coalesce(clip(F.lit(0.15) / F.col("rv"), 0.5, 3.0), F.lit(1.0))
    m = K.path_metrics(M.leverage_returns(s, lev, 10.0))
    out = slim(m.select("*"), "symbol", F.round("sortino", 5).alias("sortino"), F.round("omega", 5).alias("omega"))
    return out.withColumn("calmar", F.round(F.col("cagr") / F.abs("mdd"), 3))


@query(
    "E20 K13 naive mask strategy next to buy and hold",
    SIGX + """ rets0 AS (SELECT symbol, ts, CASE WHEN coalesce(lag(z) OVER (PARTITION BY symbol ORDER BY ts)>1,FALSE) THEN 0 ELSE coalesce(r,0) END AS m, coalesce(r,0) AS b FROM sig)
    SELECT symbol, round(product(1+m)-1,6) AS masked, round(product(1+b)-1,6) AS hold FROM rets0 GROUP BY 1""",
)
def mask_strategy(spark, sf):
    flag = F.coalesce(F.lag("z").over(W.over()) > 1, F.lit(False))
    r = F.coalesce("r", F.lit(0.0))
    s = signal_frame(spark, sf).withColumn("m", F.when(flag, 0.0).otherwise(r)).withColumn("b", r)
    return s.groupBy("symbol").agg(r6(F.product(1 + F.col("m")) - 1, "masked"), r6(F.product(1 + F.col("b")) - 1, "hold"))


@query(
    "E21 K12 reversal leverage rule with win and loss averages",
    SIGX + """ l1 AS (SELECT symbol, ts, r, CASE WHEN lag(r) OVER (PARTITION BY symbol ORDER BY ts)<0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS lev FROM sig), q AS (SELECT symbol, lev*r AS sr FROM l1 WHERE r IS NOT NULL)
    SELECT symbol, round(avg(CASE WHEN sr>0 THEN sr END),8) AS win, round(avg(CASE WHEN sr<0 THEN sr END),8) AS loss, round(avg(CASE WHEN sr>0 THEN sr END)/abs(avg(CASE WHEN sr<0 THEN sr END)),6) AS ratio, round(min(sr),7) AS worst FROM q GROUP BY 1""",
)
def reversal_rule(spark, sf):
    lev = F.when(F.lag("r").over(W.over()) < 0, 3.0).otherwise(1.0)
    s = signal_frame(spark, sf).withColumn("lev", lev).where("r is not null").withColumn("sr", F.col("lev") * F.col("r"))
    sr = F.col("sr")
    win, loss = F.avg(F.when(sr > 0, sr)), F.avg(F.when(sr < 0, sr))
    return s.groupBy("symbol").agg(F.round(win, 8).alias("win"), F.round(loss, 8).alias("loss"), r6(win / F.abs(loss), "ratio"), F.round(F.min("sr"), 7).alias("worst"))


@query(
    "E23 forecast-combination leverage without a shift",
    SIGX + WK + """, j AS (SELECT s.symbol, s.ts, coalesce(s.r,0) AS r, CASE WHEN w.a=1 THEN 1.0::DOUBLE WHEN s.vz IS NULL THEN 2.0::DOUBLE ELSE least(greatest(0.20::DOUBLE/(0.16+0.04*s.vz),0.5),3.0) END AS lev FROM sig s ASOF LEFT JOIN wl w ON w.symbol=s.symbol AND s.ts>=w.wts),
    rets AS (SELECT symbol, ts, lev*r AS sr FROM j),""" + PMET + " SELECT * FROM pm",
)
def forecast_leverage(spark, sf):
    w = weekly(spark, sf).select("symbol", "ts", latch(latch_event("z", 1.0, 0.5, on_null="zero")).alias("hostile"))
    s = asof(signal_frame(spark, sf).select("symbol", "ts", "r", "vz"), w, ["symbol"], "ts", ["hostile"])
    scaled = clip(F.lit(0.20) / (0.16 + 0.04 * F.col("vz")), 0.5, 3.0)
    lev = F.when(F.col("hostile") == 1, 1.0).otherwise(F.coalesce(scaled, F.lit(2.0)))
    return slim(K.path_metrics(M.leverage_returns(s, lev, 0.0, shift=0)), "symbol")


# episodes ------------------------------------------------------------------

DDE = """ d0 AS (SELECT symbol, ts, pos, close, max(close) OVER (PARTITION BY symbol ORDER BY ts) AS pk FROM sig), d1 AS (SELECT *, close/pk-1 AS dd, max(CASE WHEN close=pk THEN ts END) OVER (PARTITION BY symbol ORDER BY ts) AS pk_ts FROM d0),
 d2 AS (SELECT *, coalesce(last_value(CASE WHEN dd< -0.10 THEN 1 WHEN dd> -0.03 THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts),0) AS f FROM d1),
 d3 AS (SELECT *, sum(CASE WHEN f<>pf THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM (SELECT *, lag(f,1,0) OVER (PARTITION BY symbol ORDER BY ts) AS pf FROM d2)),
 de AS (SELECT symbol, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows, min(dd) AS depth, arg_min(ts,dd) AS trough_ts, arg_min(pk_ts,ts) AS peak_ts FROM d3 WHERE f=1 GROUP BY symbol, b)"""


@query("E8 drawdown episodes with peak and trough", SIGX + DDE + " SELECT symbol, strftime(start_ts,'%Y-%m-%d') AS start_ts, strftime(end_ts,'%Y-%m-%d') AS end_ts, n_rows, round(depth,6) AS depth, strftime(trough_ts,'%Y-%m-%d') AS trough_ts, strftime(peak_ts,'%Y-%m-%d') AS peak_ts FROM de")
def drawdown_episode_list(spark, sf, by="flag"):
    e = drawdown_episodes(signal_frame(spark, sf, by, reused=by == "flag"), "close", -0.10, -0.03)
    return e.select("symbol", *[day(c).alias(c) for c in ("start_ts", "end_ts")], "n_rows", r6("depth"), day("trough_ts").alias("trough_ts"), day("peak_ts").alias("peak_ts"))


@query("O6 V12 three deepest drawdown episodes per symbol", SIGX + DDE + " SELECT symbol, round(depth,6) AS depth, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY depth, start_ts) AS rn FROM de) WHERE rn<=3")
def deepest_episodes(spark, sf):
    from pyspark.sql import Window

    e = drawdown_episodes(signal_frame(spark, sf), "close", -0.10, -0.03)
    e = e.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("depth", "start_ts")))
    return e.where("rn <= 3").select("symbol", r6("depth"), "rn")


@query(
    "E9 spike episodes: above 1.5 until below 0.5, duration and peak",
    SIGX + """ f0 AS (SELECT *, coalesce(last_value(CASE WHEN vz>1.5 THEN 1 WHEN vz<0.5 THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts),0) AS f FROM sig),
 f1 AS (SELECT *, sum(CASE WHEN f<>pf THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM (SELECT *, lag(f,1,0) OVER (PARTITION BY symbol ORDER BY ts) AS pf FROM f0))
 SELECT symbol, strftime(min(ts),'%Y-%m-%d') AS start_ts, CAST(date_diff('day',min(ts),max(ts)) AS INT) AS days, max(vz) AS peak FROM f1 WHERE f=1 GROUP BY symbol, b""",
)
def volatility_spikes(spark, sf):
    s = signal_frame(spark, sf).withColumn("f", latch(latch_event("vz", 1.5, 0.5)) == 1)
    b = blocks(s, F.col("f"), aggs=[F.max("vz").alias("peak")])
    return b.select("symbol", day("start_ts").alias("start_ts"), F.datediff("end_ts", "start_ts").alias("days"), "peak")


COOL = """ g0 AS (SELECT symbol, ts, pos, close, coalesce(z>1.0,FALSE) AS f, coalesce(lag(z>1.0) OVER (PARTITION BY symbol ORDER BY ts),FALSE) AS pf FROM sig),
 g1 AS (SELECT *, CASE WHEN NOT f AND pf THEN ts END AS off FROM g0), g2 AS (SELECT *, last_value(off IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_off, min(off) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_off FROM g1),
 ep AS (SELECT symbol, ts, pos, close, next_off FROM g2 WHERE f AND NOT pf AND (last_off IS NULL OR ts-last_off>={g}))"""


@query(
    "E10 signal episodes with a cool-off of 20 calendar days, next-row execution",
    SIGX + COOL.format(g=20) + " SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, strftime(next_off,'%Y-%m-%d') AS off_ts, round(s.close,6) AS exec_price FROM ep LEFT JOIN (SELECT symbol AS sy, pos AS sp, close FROM sig) s ON s.sy=ep.symbol AND s.sp=ep.pos+1",
)
def cooled_signal_episodes(spark, sf):
    s = signal_frame(spark, sf).withColumn("exec_price", F.lead("close").over(W.over()))
    e = cooled_episodes(s, F.col("z") > 1.0, 20)
    return e.select("symbol", day().alias("ts"), day("off_ts").alias("off_ts"), r6("exec_price"))


@query(
    "E11 episodes traded on the publication date",
    SIGX + COOL.format(g=20) + " SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, strftime(pub,'%Y-%m-%d') AS pub, strftime(trade,'%Y-%m-%d') AS trade, CAST(date_diff('day',ts,trade) AS INT) AS lag_days FROM (SELECT symbol, ts, pub, (SELECT min(s.ts) FROM sig s WHERE s.symbol=e.symbol AND s.ts>=pub) AS trade FROM (SELECT *, CAST(ts+CAST(((4-(isodow(ts)-1)+7)%7)+4 AS INT) AS DATE) AS pub FROM ep) e) WHERE trade IS NOT NULL",
)
def publication_episodes(spark, sf):
    s = signal_frame(spark, sf)
    e = cooled_episodes(s, F.col("z") > 1.0, 20).select("symbol", F.col("ts").alias("signal_ts"), publication_tuesday("ts").alias("ts"))
    x = asof(e, s.select("symbol", "ts", F.col("ts").alias("trade")), ["symbol"], "ts", ["trade"], "forward").where("trade is not null")
    return x.select("symbol", day("signal_ts").alias("ts"), day("ts").alias("pub"), day("trade").alias("trade"), F.datediff("trade", "signal_ts").alias("lag_days"))


@query(
    "E12 clusters of starts more than 60 days apart",
    SIGX + COOL.format(g=0) + ", c AS (SELECT symbol, ts, sum(CASE WHEN ts-p>60 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS cl FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM ep)) SELECT symbol, strftime(min(ts),'%Y-%m-%d') AS first_ts, strftime(max(ts),'%Y-%m-%d') AS last_ts, count(*) AS n FROM c GROUP BY symbol, cl",
)
def start_clusters(spark, sf):
    e = cooled_episodes(signal_frame(spark, sf), F.col("z") > 1.0, 0)
    gap = F.coalesce((F.datediff("ts", F.lag("ts").over(W.over())) > 60).cast("int"), F.lit(0))
    e = e.withColumn("g", gap).withColumn("cl", F.sum("g").over(W.upto()))
    return e.groupBy("symbol", "cl").agg(day(F.min("ts")).alias("first_ts"), day(F.max("ts")).alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("cl")


@query(
    "K2 deepest drawdown with peak, trough and recovery dates",
    SIGX + """ k0 AS (SELECT symbol, ts, close, max(close) OVER (PARTITION BY symbol ORDER BY ts) AS pk FROM sig), k1 AS (SELECT *, close/pk-1 AS dd, max(CASE WHEN close=pk THEN ts END) OVER (PARTITION BY symbol ORDER BY ts) AS pk_ts FROM k0), k2 AS (SELECT symbol, min(dd) AS mdd, arg_min(ts,dd) AS tr, arg_min(pk_ts,dd) AS pt, arg_min(pk,dd) AS lv FROM k1 GROUP BY 1)
    SELECT k2.symbol, round(mdd,6) AS mdd, strftime(pt,'%Y-%m-%d') AS peak_ts, strftime(tr,'%Y-%m-%d') AS trough_ts, strftime(min(s.ts),'%Y-%m-%d') AS recovery_ts FROM k2 LEFT JOIN sig s ON s.symbol=k2.symbol AND s.ts>tr AND s.close>=lv GROUP BY k2.symbol, mdd, pt, tr""",
)
def deepest_drawdown(spark, sf):
    d = K.drawdown_dates(signal_frame(spark, sf), "close")
    return d.select("symbol", r6("mdd"), *[day(c).alias(c) for c in ("peak_ts", "trough_ts", "recovery_ts")])
