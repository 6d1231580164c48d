"""Alignment, as-of, lagged-availability and event joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.expr import month_end, publication_tuesday, quarter_end, week_ending
from tidemark.operators import asof as A
from tidemark.operators import windows as W
from tidemark.operators.events import following_rows, nearest_event, round_trips, transitions, within_periods
from tidemark.operators.latch import latch, latch_event
from tidemark.operators.signals import signal_frame
from tidemark.plans import base_sql as B
from tidemark.plans.base_queries import day
from tidemark.plans.registry import query
from tidemark.sources import market

SIG = B.with_(*B.signal_frame())
SIGX = SIG.rstrip() + ","
BO = B.with_(B.bars(), B.OBS, B.CAL)
BOX = BO.rstrip() + ","
SC = f"sc AS (SELECT symbol, ts, pos, close, {B.SID} AS series_id FROM bars)"
D = lambda c, a=None: f"strftime({c},'%Y-%m-%d') AS {a or c}"


def symbol_calendar(spark, sf):
    return market.bars(spark, sf).select("symbol", "ts", "pos", "close").withColumn("series_id", market.series_of_symbol())


@query("J1 inner join on date of two series", BOX + "x AS (SELECT ts, max(CASE WHEN series_id='P1' THEN value END) AS a, max(CASE WHEN series_id='P2' THEN value END) AS b FROM obs GROUP BY ts) " + f"SELECT {D('ts')}, a-b AS spread FROM x WHERE a IS NOT NULL AND b IS NOT NULL")
def spread_of_two_series(spark, sf):
    o = market.observations(spark, sf)
    a = o.where("series_id = 'P1'").select("ts", F.col("value").alias("a"))
    b = o.where("series_id = 'P2'").select("ts", F.col("value").alias("b"))
    return a.join(b, "ts").select(day().alias("ts"), (F.col("a") - F.col("b")).alias("spread"))


@query(
    "J2 J3 J4 left join with zero, exact reindex, reindex with forward fill",
    BOX + SC + """, x AS (SELECT sc.symbol, sc.ts, o.value FROM sc LEFT JOIN obs o ON o.series_id=sc.series_id AND o.ts=sc.ts)
    SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, value AS exact, coalesce(value,0) AS zero, last_value(value IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS filled FROM x""",
)
def reindex_and_fill(spark, sf):
    x = A.reindex(symbol_calendar(spark, sf), market.observations(spark, sf), ("series_id", "ts"))
    return x.select(
        "symbol", day().alias("ts"), F.col("value").alias("exact"), F.coalesce("value", F.lit(0.0)).alias("zero"),
        W.filled("value").alias("filled"),
    )


@query(
    "J5 as-of backward, hot keys split by month",
    BOX + SC + " SELECT symbol, strftime(sc.ts,'%Y-%m-%d') AS ts, value AS value, strftime(o.ts,'%Y-%m-%d') AS obs_ts FROM sc ASOF LEFT JOIN obs o ON sc.series_id=o.series_id AND sc.ts>=o.ts",
)
def asof_backward(spark, sf):
    x = A.asof(symbol_calendar(spark, sf), market.observations(spark, sf), ["series_id"], "ts", ["value"], obs_on="obs_ts", bucket=F.trunc("ts", "month"))
    return x.select("symbol", day().alias("ts"), F.col("value"), day("obs_ts").alias("obs_ts"))


@query(
    "J6 J7 next trading day at or after and strictly after an observation",
    BO + """SELECT series_id, strftime(ts,'%Y-%m-%d') AS ts, strftime((SELECT min(c.ts) FROM cal c WHERE c.ts>=o.ts),'%Y-%m-%d') AS at_or_after, strftime((SELECT min(c.ts) FROM cal c WHERE c.ts>o.ts),'%Y-%m-%d') AS after FROM obs o""",
)
def next_trading_day(spark, sf):
    cal = market.calendar(spark, sf).select("ts", "cal_id")
    days = market.observations(spark, sf).select("ts").distinct().withColumn("cal_id", F.lit("X"))
    x = A.asof(days, cal.withColumn("at_or_after", F.col("ts")), ["cal_id"], "ts", ["at_or_after"], "forward")
    x = A.asof(x, cal.withColumn("after", F.col("ts")), ["cal_id"], "ts", ["after"], "forward", strict=True)
    o = market.observations(spark, sf).select("series_id", "ts").join(x, "ts")
    return o.select("series_id", day().alias("ts"), day("at_or_after").alias("at_or_after"), day("after").alias("after"))


@query(
    "J8 nearest-date join, tie to the later date",
    BOX + SC + """, n AS (SELECT sc.symbol, sc.ts, p.ts AS pd, p.value AS pv, n.ts AS nd, n.value AS nv FROM sc ASOF LEFT JOIN obs p ON sc.series_id=p.series_id AND sc.ts>=p.ts ASOF LEFT JOIN obs n ON sc.series_id=n.series_id AND sc.ts<=n.ts)
    SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, strftime(CASE WHEN nd IS NOT NULL AND (pd IS NULL OR nd-ts<=ts-pd) THEN nd ELSE pd END,'%Y-%m-%d') AS obs_ts, CASE WHEN nd IS NOT NULL AND (pd IS NULL OR nd-ts<=ts-pd) THEN nv ELSE pv END AS value FROM n""",
)
def nearest_observation(spark, sf):
    x = A.nearest(symbol_calendar(spark, sf), market.observations(spark, sf), ["series_id"], "ts", ["value"], "obs_ts")
    return x.select("symbol", day().alias("ts"), day("obs_ts").alias("obs_ts"), F.col("value"))


PUB = """ p AS (SELECT series_id, ts AS obs_date, value, CAST(ts + CAST(((4-(isodow(ts)-1)+7)%7)+4 AS INT) AS DATE) AS pub FROM obs),
 l AS (SELECT p.*, (SELECT min(c.ts) FROM cal c WHERE c.ts>=pub) AS use_on FROM p), k AS (SELECT series_id, use_on AS ts, max(obs_date) AS obs_date, arg_max(value,obs_date) AS value FROM l WHERE use_on IS NOT NULL GROUP BY 1,2)"""


def for_every_series(rows, obs):
    """Each row once for every observed series; the list of series is one row."""
    ids = obs.agg(F.array_sort(F.collect_set("series_id")).alias("__ids")).withColumn("__k", F.lit(1))
    return rows.withColumn("__k", F.lit(1)).join(F.broadcast(ids), "__k").withColumn("series_id", F.explode("__ids")).drop("__k", "__ids")


@query(
    "J9 D6 publication-lag availability of every series on the trading calendar",
    BOX + "cs AS (SELECT series_id, cal.ts FROM cal, (SELECT DISTINCT series_id FROM obs))," + PUB + " SELECT cs.series_id, strftime(cs.ts,'%Y-%m-%d') AS ts, strftime(obs_date,'%Y-%m-%d') AS obs_date, value AS value FROM cs ASOF LEFT JOIN k ON cs.series_id=k.series_id AND cs.ts>=k.ts",
)
def publication_lag(spark, sf):
    obs = market.observations(spark, sf)
    base = for_every_series(market.calendar(spark, sf).select("ts"), obs)
    x = A.available_on_calendar(base, obs, ["series_id"], "ts", publication_tuesday("ts"), ["value"])
    return x.select("series_id", day().alias("ts"), day("obs_date").alias("obs_date"), F.col("value"))


@query(
    "J10 fixed-lag availability: 45 days, one business day, one month, one quarter",
    BO + """SELECT series_id, strftime(ts,'%Y-%m-%d') AS ts, strftime(ts+45,'%Y-%m-%d') AS d45, strftime(coalesce((SELECT min(c.ts) FROM cal c WHERE c.ts>o.ts),ts),'%Y-%m-%d') AS b1,
    strftime(ts + INTERVAL 1 MONTH,'%Y-%m-%d') AS m1, strftime(ts + INTERVAL 3 MONTH,'%Y-%m-%d') AS q1 FROM obs o""",
)
def fixed_lag_availability(spark, sf):
    cal = market.calendar(spark, sf).select("ts", "cal_id").withColumn("nxt", F.col("ts"))
    o = market.observations(spark, sf).withColumn("cal_id", F.lit("X"))
    days = o.select("cal_id", "ts").distinct()
    nxt = A.asof(days, cal, ["cal_id"], "ts", ["nxt"], "forward", strict=True)
    return o.join(nxt, ["cal_id", "ts"]).select(
        "series_id", day().alias("ts"), day(F.date_add("ts", 45)).alias("d45"), day(F.coalesce("nxt", "ts")).alias("b1"),
        day(F.add_months("ts", 1)).alias("m1"), day(F.add_months("ts", 3)).alias("q1"),
    )


EV = """ ev AS (SELECT md, series_id FROM proj, (SELECT DISTINCT series_id FROM obs)),
 e1 AS (SELECT ev.*, a.value AS before FROM ev ASOF LEFT JOIN obs a ON ev.series_id=a.series_id AND ev.md>a.ts), e2 AS (SELECT e1.*, b.value AS atv FROM e1 ASOF LEFT JOIN obs b ON e1.series_id=b.series_id AND e1.md>=b.ts),
 e3 AS (SELECT md, series_id, round(atv-before,11) AS shock, round(sum(atv-before) OVER (PARTITION BY series_id ORDER BY md ROWS 2 PRECEDING),11) AS shock3 FROM e2),
 cs AS (SELECT series_id, cal.ts FROM cal, (SELECT DISTINCT series_id FROM obs))"""


@query(
    "J11 event value of every series carried to the next event, rolling sum of three events",
    B.with_(B.bars(), B.OBS, B.CAL, B.PROJ).rstrip() + "," + EV + " SELECT cs.series_id, strftime(cs.ts,'%Y-%m-%d') AS ts, shock, shock3 FROM cs ASOF LEFT JOIN e3 ON cs.series_id=e3.series_id AND cs.ts>=e3.md",
)
def event_shock_carried(spark, sf):
    obs = market.observations(spark, sf)
    ev = for_every_series(market.projections(spark, sf).select(F.col("meeting_date").alias("ts")), obs)
    e = A.asof(ev, obs.withColumnRenamed("value", "before"), ["series_id"], "ts", ["before"], strict=True)
    e = A.asof(e, obs.withColumnRenamed("value", "at"), ["series_id"], "ts", ["at"])
    w = Window.partitionBy("series_id").orderBy("ts")
    raw = F.col("at") - F.col("before")
    e = e.select("series_id", "ts", F.round(raw, 11).alias("shock"), F.round(F.sum(raw).over(w.rowsBetween(-2, 0)), 11).alias("shock3"))
    cal = for_every_series(market.calendar(spark, sf).select("ts"), obs)
    return A.asof(cal, e, ["series_id"], "ts", ["shock", "shock3"]).select("series_id", day().alias("ts"), "shock", "shock3")


EDGE = """ ed AS (SELECT symbol, ts, pos, close FROM (SELECT *, coalesce(z>1.0,FALSE) AS f, coalesce(lag(z>1.0) OVER (PARTITION BY symbol ORDER BY ts),FALSE) AS g FROM sig) WHERE f AND NOT g)"""


def pulses(spark, sf, col="z", level=1.0):
    s = signal_frame(spark, sf)
    return s.withColumn("__e", W.rising(F.col(col) > level)).where("__e").select("symbol", "ts", "pos", "close")


@query(
    "J12 event to the next n bars, strictly after",
    SIGX + EDGE + " SELECT e.symbol, strftime(e.ts,'%Y-%m-%d') AS ts, count(*) AS n, round(min(s.close)/e.close-1,6) AS worst, round(max(s.close)/e.close-1,6) AS best FROM ed e JOIN sig s ON s.symbol=e.symbol AND s.pos BETWEEN e.pos+1 AND e.pos+10 GROUP BY e.symbol, e.ts, e.close",
)
def bars_after_event(spark, sf):
    e = pulses(spark, sf).withColumnRenamed("close", "c0")
    x = following_rows(e, signal_frame(spark, sf), 10, ["close"])
    g = x.groupBy("symbol", "ts", "c0").agg(F.count(F.lit(1)).alias("n"), F.min("close").alias("lo"), F.max("close").alias("hi"))
    return g.select("symbol", day().alias("ts"), "n", F.round(F.col("lo") / F.col("c0") - 1, 6).alias("worst"), F.round(F.col("hi") / F.col("c0") - 1, 6).alias("best"))


NEAR = """ st AS (SELECT symbol, ts, pos, coalesce(last_value(CASE WHEN z>1.0 THEN 1 WHEN z<0.5 THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts),0) AS on1 FROM sig),
 cd AS (SELECT * FROM (SELECT *, lag(on1) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM st) WHERE on1=1 AND p=0),
 bm AS (SELECT symbol, ts, pos FROM (SELECT *, coalesce(vz>1.5,FALSE) AS f, coalesce(lag(vz>1.5) OVER (PARTITION BY symbol ORDER BY ts),FALSE) AS g FROM sig) WHERE f AND NOT g),
 nr AS (SELECT b.symbol, b.ts, b.pos, arg_min(c.pos-b.pos, abs(c.pos-b.pos)*10000+c.pos) AS delay FROM bm b LEFT JOIN cd c ON c.symbol=b.symbol AND c.pos BETWEEN b.pos-30 AND b.pos+120 GROUP BY 1,2,3),
 lt AS (SELECT nr.symbol, nr.ts, nr.pos, nr.delay, s.on1, l.pos-nr.pos AS last_on FROM nr JOIN st s ON s.symbol=nr.symbol AND s.pos=nr.pos ASOF LEFT JOIN cd l ON l.symbol=nr.symbol AND nr.pos>=l.pos)"""


@query(
    "J15 J16 nearest event in an asymmetric window, match classes A/B/C/D",
    SIGX + NEAR + """ SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, CAST(delay AS DOUBLE) AS delay, CASE WHEN on1=1 THEN 'A' WHEN delay<0 THEN 'B' WHEN delay>=0 THEN 'C' ELSE 'D' END AS match_class, CAST(CASE WHEN on1=1 THEN last_on END AS DOUBLE) AS on_since FROM lt""",
)
def event_matching(spark, sf, by="flag"):
    s = signal_frame(spark, sf, by)
    s = s.withColumn("on1", latch(latch_event("z", 1.0, 0.5)))
    cand = s.withColumn("__p", F.lag("on1").over(W.over())).where("on1 = 1 and __p = 0").select("symbol", "pos")
    bench = s.withColumn("__e", W.rising(F.col("vz") > 1.5)).where("__e").select("symbol", "pos", "ts", "on1")
    m = nearest_event(bench, cand, 30, 120)
    m = A.asof(m, cand.withColumn("since", F.col("pos")), ["symbol"], "pos", ["since"])
    cls = F.when(F.col("on1") == 1, "A").when(F.col("delay") < 0, "B").when(F.col("delay") >= 0, "C").otherwise("D")
    return m.select(
        "symbol", day().alias("ts"), F.col("delay").cast("double"), cls.alias("match_class"),
        F.when(F.col("on1") == 1, F.col("since") - F.col("pos")).cast("double").alias("on_since"),
    )


@query(
    "J17 P18 matched, extra and missed events",
    SIGX + NEAR + """, x AS (SELECT c.symbol, c.pos, bool_or(b.pos IS NOT NULL) AS hit FROM cd c LEFT JOIN bm b ON b.symbol=c.symbol AND c.pos BETWEEN b.pos-30 AND b.pos+120 GROUP BY 1,2)
    SELECT n.symbol, matched, missed, extra FROM (SELECT symbol, count(delay) AS matched, count(*)-count(delay) AS missed FROM nr GROUP BY 1) n JOIN (SELECT symbol, count(CASE WHEN NOT hit THEN 1 END) AS extra FROM x GROUP BY 1) e USING (symbol)""",
)
def matched_and_missed(spark, sf):
    s = signal_frame(spark, sf).withColumn("on1", latch(latch_event("z", 1.0, 0.5)))
    cand = s.withColumn("__p", F.lag("on1").over(W.over())).where("on1 = 1 and __p = 0").select("symbol", "pos")
    bench = s.withColumn("__e", W.rising(F.col("vz") > 1.5)).where("__e").select("symbol", "pos")
    m = nearest_event(bench, cand, 30, 120).groupBy("symbol").agg(F.count("delay").alias("matched"), F.count_if(F.col("delay").isNull()).alias("missed"))
    x = nearest_event(cand, bench, 120, 30).groupBy("symbol").agg(F.count_if(F.col("delay").isNull()).alias("extra"))
    return m.join(x, "symbol")


TRIP = """ mt AS (SELECT symbol, ts, pos, close, master, lag(master) OVER (PARTITION BY symbol ORDER BY ts) AS pm FROM sig),
 tr AS (SELECT *, CASE WHEN master=0 THEN 'exit' ELSE 'enter' END AS kind FROM mt WHERE pm<>master),
 rt AS (SELECT * FROM (SELECT *, lead(ts) OVER w AS ets, lead(pos) OVER w AS epos, lead(close) OVER w AS ec FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WHERE kind='exit')"""


@query(
    "J19 A23 K8 exits paired with re-entries: avoided loss and missed gain",
    SIGX + TRIP + """ SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, strftime(ets,'%Y-%m-%d') AS entry_ts, CAST(epos-pos AS DOUBLE) AS out_rows, round(greatest(1-ec/close,0),6) AS avoided, round(greatest(ec/close-1,0),6) AS missed FROM rt""",
)
def exit_reentry_cycles(spark, sf):
    t = transitions(signal_frame(spark, sf), "master")
    c = round_trips(t.select("symbol", "ts", "pos", "close", "kind"), ["pos", "close"])
    ret = F.col("entry_close") / F.col("close") - 1
    pos = lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
    return c.select(
        "symbol", day().alias("ts"), day("entry_ts").alias("entry_ts"), (F.col("entry_pos") - F.col("pos")).cast("double").alias("out_rows"),
        F.round(pos(-ret), 6).alias("avoided"), F.round(pos(ret), 6).alias("missed"),
    )


PERIODS = [("full", "1995-01-01", "2001-12-31"), ("insample", "1995-01-01", "1997-12-31"), ("holdout", "1998-01-01", "1999-12-31"), ("forward", "2000-01-01", "2001-12-31")]
PSQL = " pr(period,a,b) AS (VALUES " + ",".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PERIODS) + ")"


@query(
    "J22 J24 I7 V6 S14 overlapping named periods",
    SIGX + PSQL + " SELECT symbol, period, count(r) AS n, round(avg(r)/stddev_samp(r)*sqrt(252),5) AS sharpe, round(product(1+r)-1,6) AS ret FROM sig JOIN pr ON ts BETWEEN a AND b WHERE r IS NOT NULL GROUP BY 1,2",
)
def period_metrics(spark, sf):
    from tidemark.functions.stats import compounded, sharpe

    s = signal_frame(spark, sf).where("r is not null").withColumn("period", F.explode(within_periods("ts", PERIODS)))
    return s.groupBy("symbol", "period").agg(F.count("r").alias("n"), F.round(sharpe("r"), 5).alias("sharpe"), F.round(compounded("r"), 6).alias("ret"))


@query(
    "J23 latest and previous available quarter of every series at each meeting",
    B.with_(B.OBS, B.PROJ) + """, q AS (SELECT series_id, last_day(date_trunc('quarter',ts)+INTERVAL 2 MONTH) AS qe, avg(value) AS v FROM obs GROUP BY 1,2), g AS (SELECT series_id, qe, v/lag(v) OVER (PARTITION BY series_id ORDER BY qe)-1 AS growth FROM q), h AS (SELECT series_id, qe, growth, lag(growth) OVER (PARTITION BY series_id ORDER BY qe) AS prev_growth FROM g),
    ev AS (SELECT md, series_id FROM proj, (SELECT DISTINCT series_id FROM obs))
    SELECT ev.series_id, strftime(md,'%Y-%m-%d') AS meeting_date, strftime(qe,'%Y-%m-%d') AS quarter, round(growth,6) AS growth, round(prev_growth,6) AS prev_growth FROM ev ASOF LEFT JOIN h ON ev.series_id=h.series_id AND md>=qe""",
)
def quarters_at_meeting(spark, sf):
    obs = market.observations(spark, sf)
    q = obs.withColumn("ts", quarter_end("ts")).groupBy("series_id", "ts").agg(F.avg("value").alias("v"))
    by = ("series_id",)
    q = q.withColumn("growth", W.pct_change("v", 1, by)).withColumn("prev_growth", F.lag("growth").over(W.over(by)))
    ev = for_every_series(market.projections(spark, sf).select(F.col("meeting_date").alias("ts")), obs)
    x = A.asof(ev, q, ["series_id"], "ts", ["growth", "prev_growth"], obs_on="quarter")
    return x.select("series_id", day().alias("meeting_date"), day("quarter").alias("quarter"), F.round("growth", 6).alias("growth"), F.round("prev_growth", 6).alias("prev_growth"))


@query(
    "D16 B3 resampling: week to Sunday, week to Friday, month end, month start, quarter start",
    BO + """SELECT rule, series_id, strftime(label,'%Y-%m-%d') AS label, arg_max(value,ts) AS last_value, round(avg(value),11) AS mean_value FROM (
      SELECT 'W' AS rule, series_id, ts, value, ts+CAST(7-isodow(ts) AS INT) AS label FROM obs UNION ALL SELECT 'W-FRI', series_id, ts, value, ts+CAST((5-isodow(ts)+7)%7 AS INT) FROM obs
      UNION ALL SELECT 'ME', series_id, ts, value, last_day(ts) FROM obs UNION ALL SELECT 'MS', series_id, ts, value, CAST(date_trunc('month',ts) AS DATE) FROM obs UNION ALL SELECT 'QS', series_id, ts, value, CAST(date_trunc('quarter',ts) AS DATE) FROM obs) GROUP BY 1,2,3""",
)
def resampled_series(spark, sf):
    rules = {"W": week_ending("ts", "SU"), "W-FRI": week_ending("ts", "FR"), "ME": month_end("ts"), "MS": F.trunc("ts", "month"), "QS": F.trunc("ts", "quarter")}
    o = market.observations(spark, sf)
    o = o.withColumn("__r", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), e.alias("label")) for n, e in rules.items()])))
    g = o.groupBy("__r.rule", "series_id", "__r.label").agg(F.max_by("value", "ts").alias("l"), F.avg("value").alias("m"))
    return g.select("rule", "series_id", day("label").alias("label"), F.col("l").alias("last_value"), F.round("m", 11).alias("mean_value"))


@query(
    "D16 S13 daily forward fill over a generated day range",
    BO + """SELECT series_id, count(*) AS days, round(sum(v),4) AS total FROM (SELECT r.series_id, r.d, o.value AS v FROM (SELECT series_id, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS d FROM obs GROUP BY series_id) r ASOF LEFT JOIN obs o ON o.series_id=r.series_id AND r.d>=o.ts) GROUP BY 1""",
)
def daily_forward_fill(spark, sf):
    o = market.observations(spark, sf)
    span = o.groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    days = span.select("series_id", F.explode(F.sequence("a", "b")).alias("ts"))
    x = A.asof(days, o, ["series_id"], "ts", ["value"])
    return x.groupBy("series_id").agg(F.count(F.lit(1)).alias("days"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "P16 centre row of every series in a +/-10-day neighbourhood of each meeting",
    B.with_(B.OBS, B.PROJ) + """SELECT series_id, strftime(md,'%Y-%m-%d') AS meeting_date, strftime(ts,'%Y-%m-%d') AS centre, value AS value FROM (SELECT md, series_id, ts, value, row_number() OVER (PARTITION BY md, series_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY md, series_id) AS n FROM proj JOIN obs ON ts BETWEEN md-10 AND md+10) WHERE rn=n//2+1""",
)
def centre_of_neighbourhood(spark, sf):
    ev = market.projections(spark, sf).select("meeting_date", F.explode(F.sequence(F.date_sub("meeting_date", 10), F.date_add("meeting_date", 10))).alias("ts"))
    x = ev.join(market.observations(spark, sf), "ts")
    w = Window.partitionBy("meeting_date", "series_id")
    x = x.withColumn("rn", F.row_number().over(w.orderBy("ts"))).withColumn("n", F.count(F.lit(1)).over(w))
    return x.where("rn = floor(n / 2) + 1").select("series_id", day("meeting_date").alias("meeting_date"), day().alias("centre"), F.col("value"))
