"""Event and outcome studies, transition accounting, attribution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import stats as S
from tidemark.functions.expr import tags
from tidemark.operators import asof as A
from tidemark.operators import machines as M
from tidemark.operators import windows as W
from tidemark.operators.episodes import blocks, drawdown_episodes
from tidemark.operators.events import nearest_event, round_trips, transitions, virtual_trades, within_periods
from tidemark.operators.latch import latch, latch_event
from tidemark.operators.signals import signal_frame
from tidemark.plans import base_sql as B
from tidemark.plans.base_queries import day
from tidemark.plans.join_queries import NEAR, PERIODS, PSQL, TRIP
from tidemark.plans.machine_queries import DDE, HOLD, cond_sql
from tidemark.plans.registry import query
from tidemark.session import calendar_sized, fan_join
from tidemark.plans.window_queries import BLOCKS, fwd_mdd_sql
from tidemark.sources import market

SIG = B.with_(*B.signal_frame())
SIGX = SIG.rstrip() + ","
RSIGX = SIGX.replace("WITH ", "WITH RECURSIVE ", 1)
r6 = lambda c, n=None: F.round(c, 6).alias(n or c)
SY = "OVER (PARTITION BY symbol ORDER BY pos)"


@query(
    "V1 forward return and drawdown distribution by regime and horizon",
    SIGX + f""" m21 AS ({fwd_mdd_sql(0, 21, 22, 'm')}), m63 AS ({fwd_mdd_sql(0, 63, 64, 'm')}), x AS (SELECT s.symbol, s.pos, s.z, s.vz, s.master, lead(close,21) {SY.replace('symbol', 's.symbol').replace('pos', 's.pos')}/close-1 AS f21, lead(close,63) {SY.replace('symbol', 's.symbol').replace('pos', 's.pos')}/close-1 AS f63, a.m AS d21, b.m AS d63 FROM sig s LEFT JOIN m21 a ON a.symbol=s.symbol AND a.pos=s.pos LEFT JOIN m63 b ON b.symbol=s.symbol AND b.pos=s.pos),
    t AS (SELECT *, unnest(list_filter([CASE WHEN z>1 THEN 'stress' END, CASE WHEN vz>1 THEN 'volatile' END, CASE WHEN z<0 AND vz<0 THEN 'calm' END, 'all'], lambda v: v IS NOT NULL)) AS regime FROM x), u AS (SELECT regime, 21 AS h, f21 AS f, d21 AS d FROM t UNION ALL SELECT regime, 63, f63, d63 FROM t)
    SELECT regime, CAST(h AS INT) AS h, count(f) AS n, round(avg(f),7) AS mean, round(median(f),7) AS med, round(avg(CAST(f<0 AS INT)),6) AS neg, round(avg(d),7) AS mdd_mean, round(quantile_cont(d,0.1),7) AS mdd_p10 FROM u GROUP BY 1,2""",
)
def regime_outcomes(spark, sf):
    s = signal_frame(spark, sf)
    regimes = {"stress": F.col("z") > 1, "volatile": F.col("vz") > 1, "calm": (F.col("z") < 0) & (F.col("vz") < 0), "all": F.lit(True)}
    one = lambda h, frame: F.struct(F.lit(h).alias("h"), W.forward_return("close", h).alias("f"), F.round(frame, 6).alias("d"))
    s = s.withColumn("o", F.array(one(21, W.forward_drawdown("close", 0, 21, require_full=True)), one(63, W.forward_drawdown("close", 0, 63, require_full=True))))
    s = s.select(F.explode(tags(regimes)).alias("regime"), "o").select("regime", F.explode("o").alias("o")).select("regime", "o.*")
    return s.groupBy("regime", "h").agg(
        F.count("f").alias("n"), F.round(F.avg("f"), 7).alias("mean"), F.round(F.median("f"), 7).alias("med"), r6(F.avg((F.col("f") < 0).cast("int")), "neg"),
        F.round(F.avg("d"), 7).alias("mdd_mean"), F.round(F.percentile("d", 0.1), 7).alias("mdd_p10"),
    )


HORIZONS = [21, 63, 126, 252]


@query(
    "V1 W15 forward returns and drawdowns by regime over 1, 3, 6 and 12 months",
    SIGX + ", ".join(f"m{h} AS ({fwd_mdd_sql(0, h, h + 1, 'm')})" for h in HORIZONS) + f""", x AS (SELECT s.symbol, s.pos, s.z, s.vz, {", ".join(f"lead(close,{h}) OVER (PARTITION BY s.symbol ORDER BY s.pos)/close-1 AS f{h}, m{h}.m AS d{h}" for h in HORIZONS)} FROM sig s {" ".join(f"LEFT JOIN m{h} ON m{h}.symbol=s.symbol AND m{h}.pos=s.pos" for h in HORIZONS)}),
    t AS (SELECT *, unnest(list_filter([CASE WHEN z>1 THEN 'stress' END, CASE WHEN vz>1 THEN 'volatile' END, CASE WHEN z<0 AND vz<0 THEN 'calm' END, 'all'], lambda v: v IS NOT NULL)) AS regime FROM x), u AS ({" UNION ALL ".join(f"SELECT regime, {h} AS h, f{h} AS f, d{h} AS d FROM t" for h in HORIZONS)})
    SELECT regime, CAST(h AS INT) AS h, count(f) AS n, round(avg(f),7) AS mean, round(median(f),7) AS med, round(quantile_cont(f,0.1),7) AS p10, round(avg(CAST(f<0 AS INT)),6) AS neg, round(avg(d),7) AS mdd_mean, round(min(d),6) AS mdd_worst, round(quantile_cont(d,0.1),7) AS mdd_p10 FROM u GROUP BY 1,2""",
)
def regime_horizons(spark, sf):
    s = W.forward_drawdowns(signal_frame(spark, sf), "close", HORIZONS)
    regimes = {"stress": F.col("z") > 1, "volatile": F.col("vz") > 1, "calm": (F.col("z") < 0) & (F.col("vz") < 0), "all": F.lit(True)}
    s = s.withColumn("o", F.array(*[F.struct(F.lit(h).alias("h"), W.forward_return("close", h).alias("f"), F.round(f"mdd{h}", 6).alias("d")) for h in HORIZONS]))
    s = s.select(F.explode(tags(regimes)).alias("regime"), "o").select("regime", F.explode("o").alias("o")).select("regime", "o.*")
    return s.groupBy("regime", "h").agg(
        F.count("f").alias("n"), F.round(F.avg("f"), 7).alias("mean"), F.round(F.median("f"), 7).alias("med"), F.round(F.percentile("f", 0.1), 7).alias("p10"), r6(F.avg((F.col("f") < 0).cast("int")), "neg"),
        F.round(F.avg("d"), 7).alias("mdd_mean"), r6(F.min("d"), "mdd_worst"), F.round(F.percentile("d", 0.1), 7).alias("mdd_p10"),
    )


LOOKBACKS = {"3m": 91, "6m": 182, "12m": 365, "24m": 730}


@query(
    "V3 look-backs of 3 to 24 months before drawdowns: days flagged, extremes, mean, first flag and lead days",
    SIGX + DDE + f""", w AS (SELECT unnest([{",".join(f"'{n}'" for n in LOOKBACKS)}]) AS span, unnest([{",".join(str(d) for d in LOOKBACKS.values())}]) AS days),
    l AS (SELECT e.symbol, e.start_ts, span, count(*) AS n, count(CASE WHEN z>1 THEN 1 END) AS flagged, min(z) AS lo, max(z) AS hi, avg(z) AS mean, min(CASE WHEN z>1 THEN s.ts END) AS first_flag FROM de e JOIN w ON TRUE JOIN sig s ON s.symbol=e.symbol AND s.ts BETWEEN CAST(e.start_ts-days AS DATE) AND e.start_ts-1 GROUP BY 1,2,3)
    SELECT symbol, strftime(start_ts,'%Y-%m-%d') AS start_ts, span, n, flagged, lo, hi, round(mean,6) AS mean, CAST(date_diff('day',first_flag,start_ts) AS DOUBLE) AS lead_days FROM l""",
)
def pre_event_lookbacks(spark, sf):
    s = signal_frame(spark, sf)
    e = drawdown_episodes(s, "close", -0.10, -0.03).select("symbol", "start_ts")
    # an episode meets each of its days once; the day then counts for every span that reaches it
    e = e.withColumn("ts", F.explode(F.sequence(F.date_sub("start_ts", max(LOOKBACKS.values())), F.date_sub("start_ts", 1))))
    x = fan_join(e, s.select("symbol", "ts", "z"), ["symbol", "ts"])
    reach = F.array(*[F.when(F.col("ts") >= F.date_sub("start_ts", d), F.lit(n)) for n, d in LOOKBACKS.items()])
    x = x.withColumn("span", F.explode(F.filter(reach, lambda v: v.isNotNull())))
    flag = F.col("z") > 1
    g = x.groupBy("symbol", "start_ts", "span").agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("flagged"), F.min("z").alias("lo"), F.max("z").alias("hi"), r6(F.avg("z"), "mean"), F.min(F.when(flag, F.col("ts"))).alias("ff"))
    return g.select("symbol", day("start_ts").alias("start_ts"), "span", "n", "flagged", "lo", "hi", "mean", F.datediff("start_ts", "ff").cast("double").alias("lead_days"))


@query(
    "V6 K1 K3 period table: annual return, volatility, Sharpe, mean level of the signal and its growth",
    SIGX + PSQL + """, c AS (SELECT symbol, period, count(r) AS n, exp(sum(ln(1+r))*252.0::DOUBLE/count(r))-1 AS cagr, stddev_samp(r)*sqrt(252) AS vol, avg(r)/stddev_samp(r)*sqrt(252) AS sharpe, avg(rate)*252 AS level, arg_max(rate,ts)/nullif(arg_min(rate,ts),0)-1 AS growth FROM sig JOIN pr ON ts BETWEEN a AND b WHERE r IS NOT NULL GROUP BY 1,2)
    SELECT symbol, period, n, round(cagr,6) AS cagr, round(vol,6) AS vol, round(sharpe,5) AS sharpe, round(level,6) AS mean_level, round(growth,6) AS level_growth FROM c""",
)
def period_table(spark, sf):
    s = signal_frame(spark, sf).where("r is not null").withColumn("period", F.explode(within_periods("ts", PERIODS)))
    g = s.groupBy("symbol", "period").agg(
        F.count("r").alias("n"), F.sum(F.log1p("r")).alias("l"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.avg("rate").alias("level"), F.max_by("rate", "ts").alias("last"), F.min_by("rate", "ts").alias("first")
    )
    root = F.sqrt(F.lit(252.0))
    return g.select(
        "symbol", "period", "n", r6(F.exp(F.col("l") * 252.0 / F.col("n")) - 1, "cagr"), r6(F.col("sd") * root, "vol"), F.round(F.col("m") / F.nullif(F.col("sd"), F.lit(0.0)) * root, 5).alias("sharpe"),
        r6(F.col("level") * 252, "mean_level"), r6(F.col("last") / F.nullif(F.col("first"), F.lit(0.0)) - 1, "level_growth"),
    )


@query(
    "V7 A6 correlations and levels before and after a break, with Fisher's z of the difference",
    SIGX + """ x AS (SELECT symbol, ts>=DATE '1999-01-01' AS g, r, z, vz, iz, rate FROM sig WHERE r IS NOT NULL AND z IS NOT NULL AND vz IS NOT NULL AND iz IS NOT NULL),
    p AS (SELECT symbol, 'r~z' AS pair, g, r AS a, z AS b FROM x UNION ALL SELECT symbol, 'z~vz', g, z, vz FROM x UNION ALL SELECT symbol, 'vz~iz', g, vz, iz FROM x),
    c AS (SELECT symbol, pair, count(*) FILTER (NOT g) AS n0, count(*) FILTER (g) AS n1, corr(a,b) FILTER (NOT g) AS c0, corr(a,b) FILTER (g) AS c1, avg(b) FILTER (NOT g) AS m0, avg(b) FILTER (g) AS m1 FROM p GROUP BY 1,2)
    SELECT symbol, pair, n0, n1, round(c0,6) AS before, round(c1,6) AS after, round(c1-c0,6) AS change, round((atanh(c1)-atanh(c0))/sqrt(1.0::DOUBLE/(n0-3)+1.0::DOUBLE/(n1-3)),5) AS fisher_z, round(m1-m0,6) AS level_change FROM c""",
)
def pre_post_correlations(spark, sf):
    s = signal_frame(spark, sf).na.drop("any", subset=["r", "z", "vz", "iz"]).withColumn("g", F.col("ts") >= F.to_date(F.lit("1999-01-01")))
    pairs = F.array(*[F.struct(F.lit(f"{a}~{b}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("r", "z"), ("z", "vz"), ("vz", "iz"))])
    p = s.select("symbol", "g", F.explode(pairs).alias("p")).select("symbol", "g", "p.*")
    side = lambda c, late: F.when(F.col("g") == late, F.col(c))
    g = p.groupBy("symbol", "pair").agg(
        F.count_if(~F.col("g")).alias("n0"), F.count_if("g").alias("n1"), F.corr(side("a", False), side("b", False)).alias("c0"), F.corr(side("a", True), side("b", True)).alias("c1"), (F.avg(side("b", True)) - F.avg(side("b", False))).alias("m")
    )
    c0, c1 = F.col("c0"), F.col("c1")
    z = (F.atanh(c1) - F.atanh(c0)) / F.sqrt(1 / (F.col("n0") - 3.0) + 1 / (F.col("n1") - 3.0))
    return g.select("symbol", "pair", "n0", "n1", r6(c0, "before"), r6(c1, "after"), r6(c1 - c0, "change"), F.round(z, 5).alias("fisher_z"), r6("m", "level_change"))


@query(
    "V2 flagged against normal days: forward return and tail probability",
    SIGX + f""" x AS (SELECT symbol, coalesce(z>1,FALSE) AS f, lead(close,63) {SY}/close-1 AS r FROM sig) SELECT f AS flagged, count(*) AS n, round(avg(r),7) AS mean, round(avg(CAST(r< -0.08 AS INT)),6) AS tail FROM x WHERE r IS NOT NULL GROUP BY 1""",
)
def flagged_outcomes(spark, sf):
    s = signal_frame(spark, sf).withColumn("f", W.forward_return("close", 63)).where("f is not null")
    return s.groupBy(F.coalesce(F.col("z") > 1, F.lit(False)).alias("flagged")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("f"), 7).alias("mean"), r6(F.avg((F.col("f") < -0.08).cast("int")), "tail")
    )


@query(
    "V3 look-back before drawdowns: days flagged, extremes, first flag and lead days",
    SIGX + DDE + """, l AS (SELECT e.symbol, e.start_ts, count(*) AS n, count(CASE WHEN z>1 THEN 1 END) AS flagged, min(z) AS lo, max(z) AS hi, min(CASE WHEN z>1 THEN s.ts END) AS first_flag FROM de e JOIN sig s ON s.symbol=e.symbol AND s.ts BETWEEN e.start_ts-90 AND e.start_ts-1 GROUP BY 1,2)
    SELECT symbol, strftime(start_ts,'%Y-%m-%d') AS start_ts, n, flagged, lo, hi, CAST(date_diff('day',first_flag,start_ts) AS DOUBLE) AS lead_days FROM l""",
)
def pre_event_lookback(spark, sf):
    s = signal_frame(spark, sf)
    e = drawdown_episodes(s, "close", -0.10, -0.03).select("symbol", "start_ts")
    e = e.withColumn("ts", F.explode(F.sequence(F.date_sub("start_ts", 90), F.date_sub("start_ts", 1))))
    x = fan_join(e, s.select("symbol", "ts", "z"), ["symbol", "ts"])
    flag = F.col("z") > 1
    g = x.groupBy("symbol", "start_ts").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("flagged"), F.min("z").alias("lo"), F.max("z").alias("hi"), F.min(F.when(flag, F.col("ts"))).alias("ff")
    )
    return g.select("symbol", day("start_ts").alias("start_ts"), "n", "flagged", "lo", "hi", F.datediff("start_ts", "ff").cast("double").alias("lead_days"))


@query(
    "V4 outcomes in calendar days after blocks, from start and from end",
    SIGX + BLOCKS + """, b AS (SELECT blk.symbol, start_ts, end_ts FROM blk WHERE n_rows>=3), f AS (SELECT b.symbol, b.start_ts, b.end_ts, a.close AS c0, z.close AS c1 FROM b JOIN sig a ON a.symbol=b.symbol AND a.ts=b.start_ts JOIN sig z ON z.symbol=b.symbol AND z.ts=b.end_ts)
    SELECT f.symbol, strftime(f.start_ts,'%Y-%m-%d') AS start_ts, round(min(CASE WHEN s.ts>f.start_ts AND s.ts<=f.start_ts+60 THEN s.close END)/c0-1,6) AS worst_from_start, round(min(CASE WHEN s.ts>f.end_ts AND s.ts<=f.end_ts+60 THEN s.close END)/c1-1,6) AS worst_from_end
    FROM f JOIN sig s ON s.symbol=f.symbol AND s.ts>f.start_ts AND s.ts<=f.end_ts+60 GROUP BY f.symbol, f.start_ts, f.end_ts, c0, c1""",
)
def post_block_outcomes(spark, sf):
    s = signal_frame(spark, sf)
    b = blocks(s, F.col("z") > 0.5, min_rows=3, aggs=[F.min_by("close", "ts").alias("c0"), F.max_by("close", "ts").alias("c1")])
    b = b.withColumn("ts", F.explode(F.sequence(F.date_add("start_ts", 1), F.date_add("end_ts", 60))))
    x = fan_join(b, s.select("symbol", "ts", "close"), ["symbol", "ts"])
    near = lambda c: (F.col("ts") > F.col(c)) & (F.col("ts") <= F.date_add(c, 60))
    worst = lambda c, base: F.min(F.when(near(c), F.col("close"))) / F.first(base) - 1
    return x.groupBy("symbol", "start_ts", "end_ts").agg(r6(worst("start_ts", "c0"), "worst_from_start"), r6(worst("end_ts", "c1"), "worst_from_end")).select(
        "symbol", day("start_ts").alias("start_ts"), "worst_from_start", "worst_from_end"
    )


def meetings_of_symbols(spark, sf, s):
    """(symbol, meeting_date): quarters spanned by each symbol, met with the meetings by key."""
    meetings = market.projections(spark, sf).select("meeting_date")
    q = s.groupBy("symbol").agg(F.trunc(F.min("ts"), "quarter").alias("a"), F.max("ts").alias("b"))
    q = q.select("symbol", F.explode(F.expr("sequence(a, b, interval 3 month)")).alias("q"))
    return q.select("symbol", F.date_add(F.add_months("q", 2), 14).alias("meeting_date")).join(meetings, "meeting_date", "left_semi")


EVD = B.with_(*B.signal_frame()).rstrip() + """, nd AS (SELECT md, symbol, arg_min(pos, abs(ts-md)*10+CASE WHEN ts>=md THEN 0 ELSE 1 END) AS pos FROM proj JOIN sig ON ts BETWEEN md-7 AND md+7 GROUP BY 1,2)"""


@query(
    "V5 J8 effect of a meeting day on price after one and five days, and on another series",
    EVD + """ SELECT s.symbol, strftime(nd.md,'%Y-%m-%d') AS meeting_date, round(s1.close/s.close-1,6) AS d1, round(s5.close/s.close-1,6) AS d5, round(s5.z-s.z,6) AS dz5 FROM nd JOIN sig s ON s.symbol=nd.symbol AND s.pos=nd.pos LEFT JOIN sig s1 ON s1.symbol=nd.symbol AND s1.pos=nd.pos+1 LEFT JOIN sig s5 ON s5.symbol=nd.symbol AND s5.pos=nd.pos+5""",
)
def meeting_day_effect(spark, sf):
    s = signal_frame(spark, sf)
    w = W.over()
    x = s.select("symbol", "ts", (F.lead("close", 1).over(w) / F.col("close") - 1).alias("d1"), (F.lead("close", 5).over(w) / F.col("close") - 1).alias("d5"), (F.lead("z", 5).over(w) - F.col("z")).alias("dz5"))
    e = meetings_of_symbols(spark, sf, s).withColumnRenamed("meeting_date", "ts")
    n = A.nearest(e, x.withColumn("hit", F.struct("d1", "d5", "dz5")), ["symbol"], "ts", ["hit"], "obs_ts").where("abs(datediff(obs_ts, ts)) <= 7")
    return n.select("symbol", day().alias("meeting_date"), r6("hit.d1", "d1"), r6("hit.d5", "d5"), r6("hit.dz5", "dz5"))


@query(
    "V8 P16 indicator snapshot at events and 60 days before",
    EVD.split(", nd AS")[0] + ", d AS (SELECT md, md-60 AS d60 FROM proj), syms AS (SELECT DISTINCT symbol FROM sig), e AS (SELECT * FROM d JOIN syms ON TRUE), a AS (SELECT e.symbol, md, d60, z AS z0, vz AS v0 FROM e ASOF LEFT JOIN sig s ON s.symbol=e.symbol AND e.md>=s.ts) SELECT a.symbol, strftime(md,'%Y-%m-%d') AS meeting_date, z0, v0, s.z AS z60, s.vz AS v60 FROM a ASOF LEFT JOIN sig s ON s.symbol=a.symbol AND a.d60>=s.ts",
)
def event_snapshots(spark, sf):
    s = signal_frame(spark, sf)
    both = F.array(*[F.struct(F.date_sub("meeting_date", b).alias("ts"), F.lit(b).alias("back")) for b in (0, 60)])
    e = meetings_of_symbols(spark, sf, s).select("symbol", "meeting_date", F.explode(both).alias("e")).select("symbol", "meeting_date", "e.*")
    x = A.asof(e, s.select("symbol", "ts", "z", "vz"), ["symbol"], "ts", ["z", "vz"])
    at = lambda c, b, n: F.max(F.when(F.col("back") == b, F.col(c))).alias(n)
    return x.groupBy("symbol", day("meeting_date").alias("meeting_date")).agg(at("z", 0, "z0"), at("vz", 0, "v0"), at("z", 60, "z60"), at("vz", 60, "v60"))


@query(
    "V9 K17 event audit: delay, late cost, return before the event, false entries",
    SIGX + NEAR + """, au AS (SELECT nr.symbol, nr.ts, nr.delay, c.close/b.close-1 AS late_cost, b.close/p.close-1 AS pre_ret FROM nr JOIN sig b ON b.symbol=nr.symbol AND b.pos=nr.pos LEFT JOIN sig c ON c.symbol=nr.symbol AND c.pos=nr.pos+nr.delay LEFT JOIN sig p ON p.symbol=nr.symbol AND p.pos=nr.pos-20)
    SELECT symbol, count(*) AS events, count(delay) AS matched, round(avg(delay),5) AS mean_delay, round(avg(CASE WHEN delay>0 THEN late_cost END),6) AS late_cost, round(avg(pre_ret),6) AS pre_ret FROM au GROUP BY 1""",
)
def event_audit(spark, sf):
    s = signal_frame(spark, sf).withColumn("on1", latch(latch_event("z", 1.0, 0.5)))
    w = W.over()
    s = s.withColumn("pre", F.col("close") / F.lag("close", 20).over(w) - 1)
    cand = s.withColumn("__p", F.lag("on1").over(w)).where("on1 = 1 and __p = 0").select("symbol", "pos", "close")
    bench = s.withColumn("__e", W.rising(F.col("vz") > 1.5)).where("__e").select("symbol", "pos", "close", "pre")
    m = nearest_event(bench, cand, 30, 120, cand_values=["close"])
    cost = F.when(F.col("delay") > 0, F.col("cand_close") / F.col("close") - 1)
    return m.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("events"), F.count("delay").alias("matched"), F.round(F.avg("delay"), 5).alias("mean_delay"), r6(F.avg(cost), "late_cost"), r6(F.avg("pre"), "pre_ret")
    )


@query(
    "V9 K17 event audit on two instruments: delays, late cost on the series and on the base, entries that no event explains",
    SIGX + NEAR + """, nb AS (SELECT ts, close FROM sig WHERE symbol='NO'), au AS (SELECT nr.symbol, nr.delay, c.close/b.close-1 AS own, cb.close/bb.close-1 AS base FROM nr JOIN sig b ON b.symbol=nr.symbol AND b.pos=nr.pos LEFT JOIN sig c ON c.symbol=nr.symbol AND c.pos=nr.pos+nr.delay LEFT JOIN nb bb ON bb.ts=b.ts LEFT JOIN nb cb ON cb.ts=c.ts),
    a AS (SELECT symbol, count(*) AS events, count(delay) AS matched, count(*) FILTER (delay<0) AS early, count(*) FILTER (delay>0) AS late, round(avg(delay) FILTER (delay>0),5) AS mean_late, CAST(max(delay) AS DOUBLE) AS worst_late, round(avg(own) FILTER (delay>0),6) AS late_cost, round(avg(base) FILTER (delay>0),6) AS late_cost_base FROM au GROUP BY 1),
    fe AS (SELECT cd.symbol, cd.pos FROM cd WHERE NOT EXISTS (SELECT 1 FROM bm WHERE bm.symbol=cd.symbol AND cd.pos BETWEEN bm.pos-30 AND bm.pos+120)), f AS (SELECT fe.symbol, count(*) AS false_entries, round(avg(x.close/s.close-1),6) AS after_false FROM fe JOIN sig s ON s.symbol=fe.symbol AND s.pos=fe.pos LEFT JOIN sig x ON x.symbol=fe.symbol AND x.pos=fe.pos+21 GROUP BY 1)
    SELECT a.*, coalesce(false_entries,0) AS false_entries, after_false FROM a LEFT JOIN f ON f.symbol=a.symbol""",
)
def event_audit_two(spark, sf):
    s = signal_frame(spark, sf).withColumn("on1", latch(latch_event("z", 1.0, 0.5))).withColumn("f21", W.forward_return("close", 21))
    base = s.where("symbol = 'NO'").select("ts", F.col("close").alias("base"))
    w = W.over()
    s = s.join(calendar_sized(base), "ts", "left").withColumn("__p", F.lag("on1").over(w)).withColumn("__e", W.rising(F.col("vz") > 1.5))
    cand = s.where("on1 = 1 and __p = 0").select("symbol", "pos", "close", "base", "f21")
    bench = s.where("__e").select("symbol", "pos", "close", "base")
    m = nearest_event(bench, cand, 30, 120, cand_values=["close", "base"])
    late = F.col("delay") > 0
    a = m.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("events"), F.count("delay").alias("matched"), F.count_if(F.col("delay") < 0).alias("early"), F.count_if(late).alias("late"), F.round(F.avg(F.when(late, F.col("delay"))), 5).alias("mean_late"),
        F.max("delay").cast("double").alias("worst_late"), r6(F.avg(F.when(late, F.col("cand_close") / F.col("close") - 1)), "late_cost"), r6(F.avg(F.when(late, F.col("cand_base") / F.col("base") - 1)), "late_cost_base"),
    )
    # an entry is explained by an event from 120 rows before it to 30 after
    lone = nearest_event(cand, bench, 120, 30).where("delay is null")
    f = lone.groupBy("symbol").agg(F.count(F.lit(1)).alias("false_entries"), r6(F.avg("f21"), "after_false"))
    return a.join(f, "symbol", "left").withColumn("false_entries", F.coalesce("false_entries", F.lit(0)))


@query(
    "V10 V11 K17 K14 round-trip accounting: alpha, good and false exits, penalty without re-entry, after-returns",
    SIGX + TRIP + """ SELECT rt.symbol, strftime(rt.ts,'%Y-%m-%d') AS ts, round(CASE WHEN ec IS NULL THEN -10.0 ELSE (rt.close/ec-1)*100 END,5) AS alpha, CASE WHEN ec IS NULL THEN 'open' WHEN ec<rt.close THEN 'good' ELSE 'false' END AS verdict, round(a.close/rt.close-1,6) AS after63, round(b.close/ec-1,6) AS entry63
    FROM rt LEFT JOIN sig a ON a.symbol=rt.symbol AND a.pos=rt.pos+63 LEFT JOIN sig b ON b.symbol=rt.symbol AND b.pos=rt.epos+63""",
)
def round_trip_accounting(spark, sf):
    s = signal_frame(spark, sf).withColumn("f63", W.forward_return("close", 63))
    c = round_trips(transitions(s, "master").select("symbol", "ts", "close", "f63", "kind"), ["close", "f63"])
    ec = F.col("entry_close")
    alpha = F.when(ec.isNull(), -10.0).otherwise((F.col("close") / ec - 1) * 100)
    verdict = F.when(ec.isNull(), "open").when(ec < F.col("close"), "good").otherwise("false")
    return c.select("symbol", day().alias("ts"), F.round(alpha, 5).alias("alpha"), verdict.alias("verdict"), r6("f63", "after63"), r6("entry_f63", "entry63"))


@query(
    "V11 E15 X1 virtual trade per pulse: conditional re-entry, return while out, avoided and missed moves, returns 63 and 126 rows after",
    SIGX + f""" f AS MATERIALIZED (SELECT symbol, ts, pos, close, iz<=-0.5 AS danger, iz>-0.5 AS safe, vz<0.5 AS calm, vz>1.5 AND NOT coalesce(lag(vz) {SY}>1.5, FALSE) AS pulse, max(pos) OVER (PARTITION BY symbol) AS last, lead(close,63) {SY}/close-1 AS a63, lead(close,126) {SY}/close-1 AS a126 FROM sig),
    p AS (SELECT f.*, (SELECT min(g.pos) FROM f g WHERE g.symbol=f.symbol AND g.pos>f.pos AND g.safe) AS ns, (SELECT min(g.pos) FROM f g WHERE g.symbol=f.symbol AND g.pos>f.pos AND g.calm) AS nc FROM f WHERE pulse),
    q AS (SELECT p.*, (SELECT min(g.pos) FROM f g WHERE g.symbol=p.symbol AND g.danger AND g.pos>CASE WHEN coalesce(p.safe,FALSE) THEN p.pos ELSE p.ns END) AS fresh FROM p),
    e AS (SELECT *, CASE WHEN coalesce(danger,FALSE) THEN ns ELSE least(fresh,nc) END AS en FROM q),
    x AS (SELECT e.*, coalesce(en,last) AS entry, CASE WHEN en IS NULL THEN 'still_out' WHEN coalesce(danger,FALSE) THEN 'recovered' WHEN fresh IS NOT NULL AND fresh<=coalesce(nc,fresh) THEN 'new_danger' ELSE 'calm' END AS reason FROM e),
    m AS (SELECT x.symbol, x.pos, min(g.close) AS lo, max(g.close) AS hi FROM x JOIN f g ON g.symbol=x.symbol AND g.pos BETWEEN x.pos AND x.entry GROUP BY 1,2)
    SELECT x.symbol, strftime(x.ts,'%Y-%m-%d') AS ts, CASE WHEN coalesce(x.danger,FALSE) THEN 'late' ELSE 'early' END AS kind, strftime(h.ts,'%Y-%m-%d') AS re_entry, reason, datediff('day', x.ts, h.ts) AS days_out, round(h.close/x.close-1,6) AS out, round(lo/x.close-1,6) AS avoided, round(hi/x.close-1,6) AS missed, round(h.a63,6) AS after63, round(h.a126,6) AS after126
    FROM x JOIN f h ON h.symbol=x.symbol AND h.pos=x.entry JOIN m ON m.symbol=x.symbol AND m.pos=x.pos""",
)
def virtual_trade_per_pulse(spark, sf):
    s = signal_frame(spark, sf).select("symbol", "ts", F.col("pos").cast("long").alias("pos"), "close", "iz", "vz")
    pulse = (F.col("vz") > 1.5) & ~F.coalesce(F.lag(F.col("vz") > 1.5).over(W.over()), F.lit(False))
    # a century of trading days is below 2 ** 15
    t = virtual_trades(s, pulse, F.col("iz") <= -0.5, F.col("vz") < 0.5, "close", (1 << 15) - 1)
    t = t.join(s.select("symbol", F.col("pos").alias("entry"), F.col("ts").alias("re")), ["symbol", "entry"])
    return t.select("symbol", day().alias("ts"), "kind", day("re").alias("re_entry"), "reason", F.datediff("re", "ts").cast("long").alias("days_out"), *[r6(c) for c in ("out", "avoided", "missed", "after63", "after126")])


@query(
    "V13 A21 V6 variance share and dominant factor inside event windows",
    SIGX + PSQL + """, c AS (SELECT symbol, period, var_pop(gap) AS a, var_pop(intra) AS b, sum(r)*10000 AS flow FROM sig JOIN pr ON ts BETWEEN a AND b WHERE r IS NOT NULL GROUP BY 1,2) SELECT symbol, period, round(a/(a+b),6) AS gap_share, round(flow,4) AS flow_bp, CASE WHEN a>b THEN 'gap' ELSE 'intra' END AS dominant FROM c""",
)
def window_attribution(spark, sf):
    s = signal_frame(spark, sf).where("r is not null").withColumn("period", F.explode(within_periods("ts", PERIODS)))
    g = s.groupBy("symbol", "period").agg(F.var_pop("gap").alias("a"), F.var_pop("intra").alias("b"), (F.sum("r") * 10000).alias("flow"))
    return g.select("symbol", "period", r6(F.col("a") / (F.col("a") + F.col("b")), "gap_share"), F.round("flow", 4).alias("flow_bp"), F.when(F.col("a") > F.col("b"), "gap").otherwise("intra").alias("dominant"))


@query(
    "V16 premium percentile regimes with conditional groups",
    SIGX + f""" q AS (SELECT symbol, quantile_cont(z,0.2) AS lo, quantile_cont(z,0.8) AS hi FROM sig WHERE z IS NOT NULL GROUP BY 1), x AS (SELECT s.symbol, z, vz, lead(close,21) OVER (PARTITION BY s.symbol ORDER BY pos)/close-1 AS f FROM sig s)
    SELECT CASE WHEN z>hi THEN 'rich' WHEN z<lo THEN 'cheap' ELSE 'middle' END AS bucket, coalesce(vz>0,FALSE) AS volatile, count(*) AS n, round(avg(f),7) AS mean FROM x JOIN q USING (symbol) WHERE z IS NOT NULL AND f IS NOT NULL GROUP BY 1,2""",
)
def percentile_regimes(spark, sf):
    s = signal_frame(spark, sf).withColumn("f", W.forward_return("close", 21)).where("z is not null")
    q = s.groupBy("symbol").agg(F.percentile("z", F.array(F.lit(0.2), F.lit(0.8))).alias("q"))
    x = s.join(q, "symbol").where("f is not null")
    bucket = F.when(F.col("z") > F.col("q")[1], "rich").when(F.col("z") < F.col("q")[0], "cheap").otherwise("middle")
    return x.groupBy(bucket.alias("bucket"), F.coalesce(F.col("vz") > 0, F.lit(False)).alias("volatile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f"), 7).alias("mean"))


@query(
    "V17 continuation of drops: share of episodes reaching deeper thresholds",
    SIGX + DDE.replace("dd< -0.10", "dd< -0.05").replace("dd> -0.03", "dd> -0.01") + " SELECT symbol, count(*) AS episodes, round(avg(CAST(depth<=-0.10 AS INT)),6) AS to10, round(avg(CAST(depth<=-0.15 AS INT)),6) AS to15 FROM de GROUP BY 1",
)
def drop_continuation(spark, sf):
    e = drawdown_episodes(signal_frame(spark, sf), "close", -0.05, -0.01)
    return e.groupBy("symbol").agg(F.count(F.lit(1)).alias("episodes"), r6(S.share(F.col("depth") <= -0.10), "to10"), r6(S.share(F.col("depth") <= -0.15), "to15"))


@query(
    "V18 A6 signal against past and future returns, partial correlation",
    SIGX + f""" x AS (SELECT symbol, z, vz, close/lag(close,20) {SY}-1 AS p20, lead(close,20) {SY}/close-1 AS f20, lead(close,60) {SY}/close-1 AS f60 FROM sig), c AS (SELECT symbol, corr(z,p20) AS zp, corr(z,f20) AS zf, corr(z,f60) AS zl, corr(z,vz) AS zv, corr(vz,f20) AS vf FROM x WHERE z IS NOT NULL AND vz IS NOT NULL AND p20 IS NOT NULL AND f20 IS NOT NULL GROUP BY 1)
    SELECT symbol, round(zp,6) AS past20, round(zf,6) AS future20, round(zl,6) AS future60, round((zf-zv*vf)/sqrt((1-zv*zv)*(1-vf*vf)),6) AS partial FROM c""",
)
def signal_lead_lag(spark, sf):
    s = signal_frame(spark, sf).withColumn("p20", W.pct_change("close", 20)).withColumn("f20", W.forward_return("close", 20)).withColumn("f60", W.forward_return("close", 60)).na.drop("any", subset=["z", "vz", "p20", "f20"])
    c = s.groupBy("symbol").agg(F.corr("z", "p20").alias("zp"), F.corr("z", "f20").alias("zf"), F.corr("z", "f60").alias("zl"), F.corr("z", "vz").alias("zv"), F.corr("vz", "f20").alias("vf"))
    zf, zv, vf = F.col("zf"), F.col("zv"), F.col("vf")
    return c.select("symbol", r6("zp", "past20"), r6("zf", "future20"), r6("zl", "future60"), r6((zf - zv * vf) / F.sqrt((1 - zv * zv) * (1 - vf * vf)), "partial"))


@query(
    "V19 which layer triggers first in each drawdown episode",
    SIGX + DDE + """, f AS (SELECT e.symbol, e.start_ts, min(CASE WHEN z>1.2 THEN s.ts END) AS c, min(CASE WHEN iz>2.0 THEN s.ts END) AS i, min(CASE WHEN vz>1.5 THEN s.ts END) AS v FROM de e JOIN sig s ON s.symbol=e.symbol AND s.ts BETWEEN e.start_ts AND e.end_ts GROUP BY 1,2)
    SELECT symbol, strftime(start_ts,'%Y-%m-%d') AS start_ts, CASE WHEN c IS NULL AND i IS NULL AND v IS NULL THEN 'none' WHEN c<=least(coalesce(i,c),coalesce(v,c)) THEN 'credit' WHEN i<=coalesce(v,i) THEN 'ratio' ELSE 'vol' END AS first_layer FROM f""",
)
def first_layer(spark, sf):
    s = signal_frame(spark, sf)
    dd = F.col("close") / F.max("close").over(W.upto()) - 1
    s = s.withColumn("dd", dd)
    s = s.withColumn("on1", latch(F.when(F.col("dd") < -0.10, 1).when(F.col("dd") > -0.03, 0)) == 1)
    first = lambda cond, n: F.min(F.when(cond, F.col("ts"))).alias(n)
    b = blocks(s, F.col("on1"), aggs=[first(F.col("z") > 1.2, "c"), first(F.col("iz") > 2.0, "i"), first(F.col("vz") > 1.5, "v")])
    best = F.least("c", "i", "v")
    name = F.when(best.isNull(), "none").when(F.col("c") == best, "credit").when(F.col("i") == best, "ratio").otherwise("vol")
    return b.select("symbol", day("start_ts").alias("start_ts"), name.alias("first_layer"))


@query(
    "K9 exit and entry efficiency against the local top and bottom",
    SIGX + TRIP + """ SELECT rt.symbol, strftime(rt.ts,'%Y-%m-%d') AS ts, round(rt.close/(SELECT max(close) FROM sig s WHERE s.symbol=rt.symbol AND s.pos BETWEEN rt.pos-20 AND rt.pos),6) AS exit_eff, round((SELECT min(close) FROM sig s WHERE s.symbol=rt.symbol AND s.pos BETWEEN rt.pos AND rt.epos)/ec,6) AS entry_eff FROM rt WHERE ec IS NOT NULL""",
)
def trade_efficiency(spark, sf):
    s = signal_frame(spark, sf).withColumn("top", F.max("close").over(W.trailing(21)))
    # the out block (exit row to entry row) is labelled so that its bottom is one aggregate
    s = s.withColumn("chg", (F.coalesce(F.lag("master").over(W.over()), F.lit(1)) != F.col("master")).cast("int")).withColumn("blk", F.sum("chg").over(W.upto()))
    o = s.where("master = 0").groupBy("symbol", "blk").agg(F.min("ts").alias("ts"), F.min_by(F.struct("close", "top"), "ts").alias("x"), F.min("close").alias("lo"))
    first = s.where("master = 1").groupBy("symbol", "blk").agg(F.min_by("close", "ts").alias("ec")).withColumn("blk", F.col("blk") - 1)
    j = o.join(first, ["symbol", "blk"])
    return j.select("symbol", day().alias("ts"), r6(F.col("x.close") / F.col("x.top"), "exit_eff"), r6(F.least("lo", "ec") / F.col("ec"), "entry_eff"))


@query(
    "K14 in-state and out-of-state performance",
    SIGX + " SELECT symbol, CAST(master AS INT) AS master, count(*) AS n, round(avg(r)*252,6) AS ann, round(avg(r)/stddev_pop(r)*sqrt(252),5) AS sharpe, round(avg(CAST(r>0 AS INT)),6) AS win, round(product(1+r)-1,6) AS total FROM sig WHERE r IS NOT NULL GROUP BY 1,2",
)
def state_performance(spark, sf):
    s = signal_frame(spark, sf).where("r is not null")
    return s.groupBy("symbol", F.col("master").cast("int")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("r") * 252, "ann"), F.round(S.sharpe("r", population=True), 5).alias("sharpe"), r6(S.share(F.col("r") > 0), "win"), r6(S.compounded("r"), "total")
    )


@query(
    "K18 K19 bad re-entries and exit correctness on machine transitions",
    RSIGX + cond_sql("z>1.0 AND iz>0", "vz<0.5") + HOLD.format(hold=42) + f""", m AS ({fwd_mdd_sql(1, 22, 10, 'mdd')}), t AS (SELECT symbol, pos, close, state, lag(state,1,1) {SY} AS p FROM hs)
    SELECT t.symbol, count(CASE WHEN state=1 THEN 1 END) AS entries, round(avg(CASE WHEN state=1 THEN CAST(mdd< -0.03 AS INT) END),6) AS bad_entry, count(CASE WHEN state=0 THEN 1 END) AS exits, round(avg(CASE WHEN state=0 THEN CAST(f.close/t.close-1<0 AS INT) END),6) AS right_exit FROM t LEFT JOIN m ON m.symbol=t.symbol AND m.pos=t.pos LEFT JOIN sig f ON f.symbol=t.symbol AND f.pos=t.pos+63 WHERE state<>p GROUP BY 1""",
)
def transition_quality(spark, sf):
    s = signal_frame(spark, sf).withColumn("mdd", W.forward_drawdown("close", 1, 22, min_count=10)).withColumn("f63", W.forward_return("close", 63))
    sw = M.hold_machine(s, (F.col("z") > 1.0) & (F.col("iz") > 0), F.col("vz") < 0.5, 42)
    t = sw.join(s.select("symbol", "ts", "mdd", "f63"), ["symbol", "ts"])
    e, x = F.col("state") == 1, F.col("state") == 0
    return t.groupBy("symbol").agg(
        F.count_if(e).alias("entries"), r6(S.prob(F.round("mdd", 6) < -0.03, e), "bad_entry"), F.count_if(x).alias("exits"), r6(S.prob(F.col("f63") < 0, x), "right_exit")
    )


@query(
    "K20 W20 agreement of two signals and disagreement blocks with who was right",
    SIGX + f""" a AS (SELECT symbol, ts, pos, close, CAST(master AS INT) AS m, CAST(NOT coalesce(z>0.5,FALSE) AS INT) AS o FROM sig), b0 AS (SELECT *, m<>o AS d, lead(close) {SY} AS nx FROM a), b1 AS (SELECT *, sum(CASE WHEN d<>coalesce(pd,NOT d) OR (d AND m<>pm) THEN 1 ELSE 0 END) {SY} AS b FROM (SELECT *, lag(d) {SY} AS pd, lag(m) {SY} AS pm FROM b0)),
    k AS (SELECT symbol, min(ts) AS st, count(*) AS n, arg_min(m,ts) AS m, arg_max(coalesce(nx,close),ts)/arg_min(close,ts)-1 AS ret FROM b1 WHERE d GROUP BY symbol, b)
    SELECT symbol, strftime(st,'%Y-%m-%d') AS start_ts, n, round(ret,6) AS ret, CASE WHEN (ret>0)=(m=1) THEN 'first' ELSE 'second' END AS who FROM k""",
)
def signal_disagreement(spark, sf):
    s = signal_frame(spark, sf).withColumn("m", F.col("master").cast("int")).withColumn("o", (~F.coalesce(F.col("z") > 0.5, F.lit(False))).cast("int"))
    s = s.withColumn("nx", F.coalesce(F.lead("close").over(W.over()), F.col("close")))
    parts = [blocks(s, (F.col("m") != F.col("o")) & (F.col("m") == v), aggs=[F.max_by("nx", "ts").alias("c1"), F.min_by("close", "ts").alias("c0"), F.first("m").alias("m")]) for v in (0, 1)]
    b = parts[0].unionByName(parts[1]).withColumn("ret", F.col("c1") / F.col("c0") - 1)
    who = F.when((F.col("ret") > 0) == (F.col("m") == 1), "first").otherwise("second")
    return b.select("symbol", day("start_ts").alias("start_ts"), "n_rows", r6("ret"), who.alias("who")).withColumnRenamed("n_rows", "n")


RULES = [("z", 1.0), ("z", 1.5), ("vz", 1.0), ("vz", 1.5), ("iz", 1.0), ("iz", 2.0)]


FAMILIES = {"level": (1.0, 1.5), "velocity": (0.8, 1.2), "volatility": (1.5, 2.0), "ratio": (1.0, 2.0), "below_trend": (0.02, 0.05), "off_high": (0.05, 0.1), "momentum": (0.03, 0.06), "spike": (1.3, 1.6)}
_mean_sql = lambda x, k: f"CASE WHEN count({x}) OVER (PARTITION BY symbol ORDER BY pos ROWS {k - 1} PRECEDING)={k} THEN avg({x}) OVER (PARTITION BY symbol ORDER BY pos ROWS {k - 1} PRECEDING) END"
FAMILY_SQL = {
    "level": "z", "velocity": f"z-lag(z,5) {SY}", "volatility": "vz", "ratio": "iz", "below_trend": f"1-close/({_mean_sql('close', 200)})", "off_high": f"1-close/max(close) OVER (PARTITION BY symbol ORDER BY pos ROWS 251 PRECEDING)",
    "momentum": f"1-close/lag(close,21) {SY}", "spike": f"({B.std('r', 20)})/nullif({B.std('r', 60)},0)",
}
_CELLS = [(n, t) for n, ts in FAMILIES.items() for t in ts]


@query(
    "V15 O4 X3 eight families of exit rules at two levels: hits, delay, false exits, moves after, ranked by coverage, false exits and delay",
    SIGX + DDE + ", rl(rule,level) AS (VALUES " + ",".join(f"('{c}',{t}::DOUBLE)" for c, t in _CELLS) + "), sx AS (SELECT symbol, ts, pos, close, " + ", ".join(f"round({e},6) AS v_{n}" for n, e in FAMILY_SQL.items()) + f""", lead(close,42) {SY}/close-1 AS f42 FROM sig),
    rs AS (SELECT rule, level, symbol, pos, f42, CASE rule {" ".join(f"WHEN '{n}' THEN v_{n}" for n in FAMILIES)} END>level AS f FROM sx JOIN rl ON TRUE),
    rx AS (SELECT * FROM (SELECT rule, level, symbol, pos, f42, coalesce(f,FALSE) AS f, coalesce(lag(f) OVER (PARTITION BY rule,level,symbol ORDER BY pos),FALSE) AS g FROM rs) WHERE f AND NOT g), be AS (SELECT de.symbol, s.pos FROM de JOIN sig s ON s.symbol=de.symbol AND s.ts=de.start_ts),
    h AS (SELECT rl.rule, rl.level, be.symbol, be.pos, arg_min(rx.pos-be.pos, abs(rx.pos-be.pos)*100000+rx.pos) AS d FROM be JOIN rl ON TRUE LEFT JOIN rx ON rx.rule=rl.rule AND rx.level=rl.level AND rx.symbol=be.symbol AND rx.pos BETWEEN be.pos-30 AND be.pos+30 GROUP BY 1,2,3,4),
    fx AS (SELECT rx.rule, rx.level, count(*) AS exits, count(CASE WHEN NOT EXISTS (SELECT 1 FROM be WHERE be.symbol=rx.symbol AND rx.pos BETWEEN be.pos-30 AND be.pos+30) THEN 1 END) AS false_exits, round(avg(f42),6) AS after42 FROM rx GROUP BY 1,2),
    a AS (SELECT h.rule, h.level, count(d) AS hits, count(*) AS starts, round(avg(d),5) AS mean_delay, any_value(exits) AS exits, any_value(false_exits) AS false_exits, any_value(after42) AS after42 FROM h LEFT JOIN fx ON fx.rule=h.rule AND fx.level=h.level GROUP BY 1,2)
    SELECT rule, level, hits, starts, mean_delay, coalesce(exits,0) AS exits, coalesce(false_exits,0) AS false_exits, after42, CAST(row_number() OVER (ORDER BY hits DESC, coalesce(false_exits,0), mean_delay NULLS LAST, rule, level) AS INT) AS place FROM a""",
)
def exit_rule_families(spark, sf):
    s = signal_frame(spark, sf)
    s = W.with_rolling(s, {"t": ("close", 200), "a": ("r", 20), "b": ("r", 60)})
    high = F.max("close").over(W.trailing(252))
    values = {
        "level": F.col("z"), "velocity": F.col("z") - F.lag("z", 5).over(W.over()), "volatility": F.col("vz"), "ratio": F.col("iz"), "below_trend": 1 - F.col("close") / F.col("t_mean"), "off_high": 1 - F.col("close") / high,
        "momentum": 1 - F.col("close") / F.lag("close", 21).over(W.over()), "spike": F.col("a_std") / F.nullif(F.col("b_std"), F.lit(0.0)),
    }
    s = s.withColumns({f"v_{n}": F.round(e, 6) for n, e in values.items()}).withColumn("f42", W.forward_return("close", 42))
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(t).alias("level"), (F.col(f"v_{n}") > t).alias("f")) for n, t in _CELLS])
    by = ("rule", "level", "symbol")
    x = s.select("symbol", "ts", "pos", "f42", F.explode(cells).alias("r")).select("symbol", "ts", "pos", "f42", "r.*")
    x = x.withColumn("e", W.rising("f", by)).where("e").select(*by, "pos", "f42")
    e = drawdown_episodes(s, "close", -0.10, -0.03).select("symbol", F.col("start_ts").alias("ts")).join(s.select("symbol", "ts", "pos"), ["symbol", "ts"])
    bench = e.select("symbol", "pos", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(t).alias("level")) for n, t in _CELLS])).alias("r")).select("symbol", "pos", "r.*")
    h = nearest_event(bench, x, 30, 30, by=by).groupBy("rule", "level").agg(F.count("delay").alias("hits"), F.count(F.lit(1)).alias("starts"), F.round(F.avg("delay"), 5).alias("mean_delay"))
    f = nearest_event(x, bench, 30, 30, by=by).groupBy("rule", "level").agg(F.count(F.lit(1)).alias("exits"), F.count_if(F.col("delay").isNull()).alias("false_exits"), r6(F.avg("f42"), "after42"))
    a = h.join(f, ["rule", "level"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("exits", "false_exits")})
    # sixteen rows
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("hits"), "false_exits", F.asc_nulls_last("mean_delay"), "rule", "level"))
    return a.withColumn("place", place)


@query(
    "V15 O4 X3 exit-rule library scored by hits, delay and false exits against drawdown starts",
    SIGX + DDE + ", rl(rule,level) AS (VALUES " + ",".join(f"('{c}',{t}::DOUBLE)" for c, t in RULES) + """), rs AS (SELECT rule, level, symbol, pos, CASE rule WHEN 'z' THEN z WHEN 'vz' THEN vz ELSE iz END>level AS f FROM sig JOIN rl ON TRUE),
    rx AS (SELECT * FROM (SELECT rule, level, symbol, pos, coalesce(f,FALSE) AS f, coalesce(lag(f) OVER (PARTITION BY rule,level,symbol ORDER BY pos),FALSE) AS g FROM rs) WHERE f AND NOT g), be AS (SELECT de.symbol, s.pos FROM de JOIN sig s ON s.symbol=de.symbol AND s.ts=de.start_ts),
    h AS (SELECT rl.rule, rl.level, be.symbol, be.pos, min(abs(rx.pos-be.pos)) AS d FROM be JOIN rl ON TRUE LEFT JOIN rx ON rx.rule=rl.rule AND rx.level=rl.level AND rx.symbol=be.symbol AND rx.pos BETWEEN be.pos-30 AND be.pos+30 GROUP BY 1,2,3,4),
    fx AS (SELECT rx.rule, rx.level, count(*) AS exits, count(CASE WHEN NOT EXISTS (SELECT 1 FROM be WHERE be.symbol=rx.symbol AND rx.pos BETWEEN be.pos-30 AND be.pos+30) THEN 1 END) AS false_exits FROM rx GROUP BY 1,2)
    SELECT h.rule, h.level, count(d) AS hits, count(*)-count(d) AS missed, round(avg(d),5) AS mean_delay, any_value(exits) AS exits, any_value(false_exits) AS false_exits FROM h JOIN fx ON fx.rule=h.rule AND fx.level=h.level GROUP BY 1,2""",
)
def exit_rule_library(spark, sf):
    s = signal_frame(spark, sf)
    rules = F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.lit(t).alias("level"), (F.col(c) > t).alias("f")) for c, t in RULES]))
    by = ("rule", "level", "symbol")
    x = s.select("symbol", "ts", "pos", rules.alias("r")).select("symbol", "ts", "pos", "r.*")
    x = x.withColumn("e", W.rising("f", by)).where("e").select(*by, "pos")
    e = drawdown_episodes(s, "close", -0.10, -0.03).select("symbol", F.col("start_ts").alias("ts")).join(s.select("symbol", "ts", "pos"), ["symbol", "ts"])
    bench = e.select("symbol", "pos", F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.lit(t).alias("level")) for c, t in RULES])).alias("r")).select("symbol", "pos", "r.*")
    h = nearest_event(bench, x, 30, 30, by=by).groupBy("rule", "level").agg(F.count("delay").alias("hits"), F.count_if(F.col("delay").isNull()).alias("missed"), F.round(F.avg(F.abs("delay")), 5).alias("mean_delay"))
    f = nearest_event(x, bench, 30, 30, by=by).groupBy("rule", "level").agg(F.count(F.lit(1)).alias("exits"), F.count_if(F.col("delay").isNull()).alias("false_exits"))
    return h.join(f, ["rule", "level"])


