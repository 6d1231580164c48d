"""Variants of the leverage replay: ablation, sweeps, ladders, grids, reconciliation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import variants as V
from tidemark.operators.fold import leverage_fold, with_layers
from tidemark.operators.signals import signal_frame
from tidemark.operators.windows import over, with_zscore
from tidemark.plans import base_sql as B
from tidemark.plans.base_queries import day
from tidemark.plans.fold_queries import LAYERS, METRICS, ROUNDED, latch_sql, recursive, rounded, run_sql
from tidemark.plans.registry import query

COLS = ["z_trigger", "z_recover", "vz_trigger", "vz_recover", "vz_lev", "inf_trigger", "inf_recover", "inf_lev", "nl_trigger", "nl_recover", "nl_lev", "cr_lev", "tc_bps", "use_credit", "use_vol", "use_ratio", "use_liq", "credit_hold"]


def variant_sql(rows, src="sig"):
    """CTEs that replay listed variants; ``met`` holds k = symbol || '#' || variant_id."""
    vals = ",".join("(" + ",".join([str(i)] + [f"{float({**V.DEFAULTS, **r}[c])}::DOUBLE" for c in COLS]) + ")" for i, r in enumerate(rows))
    part = "symbol,vid"
    return [
        f"v(vid,{','.join(COLS)}) AS (VALUES {vals})",
        f"vl0 AS (SELECT symbol||'#'||vid AS key, sig.*, v.*, {latch_sql('in_credit', '(CASE WHEN use_credit>0 THEN z END)', '>z_trigger', '<z_recover', part)}, "
        f"{latch_sql('in_vol', '(CASE WHEN use_vol>0 THEN vz END)', '>vz_trigger', '<vz_recover', part)}, {latch_sql('in_ratio', '(CASE WHEN use_ratio>0 THEN iz END)', '>inf_trigger', '<inf_recover', part)}, "
        f"{latch_sql('in_liq', '(CASE WHEN use_liq>0 THEN nlz END)', '<nl_trigger', '>nl_recover', part)} FROM {src} sig JOIN v ON TRUE)",
        "vl AS MATERIALIZED (SELECT *, CASE WHEN master=0 THEN 0 WHEN in_credit=1 THEN 1 WHEN in_ratio=1 THEN 2 WHEN in_vol=1 THEN 3 WHEN in_liq=1 THEN 4 ELSE 5 END AS layer FROM vl0)",
        run_sql("vl", "key", stay="CASE WHEN credit_hold>0 THEN lv ELSE 3.0 END", vz_lev="vz_lev", inf_lev="inf_lev", cr_lev="cr_lev", nl_lev="nl_lev", bps="tc_bps", extra=", s.vz_lev, s.inf_lev, s.cr_lev, s.nl_lev, s.tc_bps, s.credit_hold"),
        METRICS,
    ]


def sweep_sql(rows):
    return recursive(*B.signal_frame(), *variant_sql(rows)) + f"SELECT split_part(k,'#',1) AS symbol, CAST(split_part(k,'#',2) AS BIGINT) AS variant_id, {ROUNDED} FROM met"


def sweep(spark, sf, rows, **kw):
    m = V.replay(signal_frame(spark, sf), V.listed(spark, rows), **kw).where("period = -1")
    return rounded(m.withColumnRenamed("sharpe1", "sharpe"), "symbol", "variant_id")


ABLATION = [{"use_credit": a, "use_ratio": b, "use_vol": c} for a in (0, 1) for b in (0, 1) for c in (0, 1)]
COSTS = [{"tc_bps": b} for b in (0, 25, 50, 100, 200)]
LADDER = [{"cr_lev": a, "vz_lev": b, "inf_lev": c, "credit_hold": 1} for a in (0, 1, 2, 3) for b in (0, 1, 2, 3) for c in (0, 1, 2, 3)]
HILL = [{"z_trigger": z} for z in (0.8, 1.0, 1.2, 1.5, 2.0)] + [{"z_recover": z} for z in (0.0, 0.2, 0.5, 0.8)] + [{"vz_trigger": z} for z in (1.0, 1.5, 2.0)] + [{"inf_trigger": z} for z in (1.5, 2.0, 2.5)]
GRID = {"z_trigger": [0.8, 1.0, 1.5], "z_recover": [0.2, 0.5], "vz_trigger": [1.0, 1.5, 2.0], "vz_recover": [0.0, 0.5], "inf_trigger": [1.5, 2.5], "vz_lev": [1.0, 2.0]}


@query("I6 E2 layer ablation over all eight subsets", sweep_sql(ABLATION))
def layer_ablation(spark, sf):
    return sweep(spark, sf, ABLATION)


@query("I4 cost stress", sweep_sql(COSTS))
def cost_stress(spark, sf):
    return sweep(spark, sf, COSTS)


@query("I5 E2b leverage ladder 4x4x4, credit layer holds when unprofitable", sweep_sql(LADDER))
def leverage_ladder(spark, sf):
    return sweep(spark, sf, LADDER)


@query(
    "I2 I8 one-at-a-time hill, plateau count and sensitivity range",
    recursive(*B.signal_frame(), *variant_sql(HILL)) + f"""SELECT split_part(k,'#',1) AS symbol, count(CASE WHEN sharpe>=base-0.10 THEN 1 END) AS plateau, round(max(sharpe)-min(sharpe),5) AS spread, max(sharpe)-min(sharpe)<0.10 AS stable
    FROM met JOIN (SELECT split_part(k,'#',1) AS sy, sharpe AS base FROM met WHERE split_part(k,'#',2)='2') b ON b.sy=split_part(k,'#',1) GROUP BY 1""",
)
def parameter_hill(spark, sf):
    m = V.replay(signal_frame(spark, sf), V.listed(spark, HILL)).where("period = -1")
    m = m.withColumn("base", F.max(F.when(F.col("variant_id") == 2, F.col("sharpe1"))).over(Window.partitionBy("symbol")))
    spread = F.max("sharpe1") - F.min("sharpe1")
    return m.groupBy("symbol").agg(F.count_if(F.col("sharpe1") >= F.col("base") - 0.10).alias("plateau"), F.round(spread, 5).alias("spread"), (spread < 0.10).alias("stable"))


def grid_rows(axes):
    """The same positional numbering as ``variants.grid``."""
    rows, stride = [(0, {})], 1
    for name, vals in axes.items():
        rows = [(i + j * stride, {**r, name: v}) for i, r in rows for j, v in enumerate(vals)]
        stride *= len(vals)
    return [r for _, r in sorted(rows, key=lambda t: t[0])]


@query(
    "I1 I24 P6 P7 J20 U4 grid replay: marginal stability per parameter value and level counts",
    recursive(*B.signal_frame(), *variant_sql(grid_rows(GRID))) + """, g AS (SELECT split_part(k,'#',1) AS symbol, CAST(split_part(k,'#',2) AS INT) AS vid, sharpe FROM met),
    u AS (SELECT symbol, sharpe, 'z_trigger' AS param, z_trigger AS val FROM g JOIN v USING (vid) UNION ALL SELECT symbol, sharpe, 'vz_trigger', vz_trigger FROM g JOIN v USING (vid) UNION ALL SELECT symbol, sharpe, 'vz_lev', vz_lev FROM g JOIN v USING (vid))
    SELECT param, val, count(*) AS n, round(min(sharpe),5) AS lo, round(median(sharpe),5) AS med, round(max(sharpe),5) AS hi, count(CASE WHEN sharpe>0.2 THEN 1 END) AS above FROM u GROUP BY 1,2""",
)
def grid_marginals(spark, sf):
    g = V.grid(spark, GRID)
    m = V.replay(signal_frame(spark, sf), g).where("period = -1").join(g.table, "variant_id")
    u = m.unpivot(["symbol", "sharpe1"], ["z_trigger", "vz_trigger", "vz_lev"], "param", "val")
    s = F.col("sharpe1")
    return u.groupBy("param", "val").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min(s), 5).alias("lo"), F.round(F.median(s), 5).alias("med"), F.round(F.max(s), 5).alias("hi"), F.count_if(s > 0.2).alias("above")
    )


#: Cost levels of the stress, and the gates a variant must pass (fixed values)
STRESS = [25, 200]
GATES = {"sharpe": 1.33, "mdd": -0.45, "trades": 5.0, "cost": 1.0, "oos": 0.5, "fwd": 0.5}
AUDITED = {"z_trigger": [0.8, 1.0, 1.5], "vz_trigger": [1.0, 2.0], "inf_trigger": [1.5, 2.5], "tc_bps": STRESS}


def audit(spark, sf, axes):
    """Replay a grid at both costs with periods; one row per (symbol, variant) with the inputs of all gates.

    Variants that differ in the cost alone share an id: the cost is the last axis of the grid.
    """
    per = F.when(F.year("ts") <= 1997, 0).when(F.year("ts") <= 1999, 1).otherwise(2)
    g = V.grid(spark, {**axes, "tc_bps": STRESS})
    base = g.size // len(STRESS)
    m = V.replay(signal_frame(spark, sf), g, period=per)
    m = m.withColumn("dear", F.col("variant_id") >= base).withColumn("vid", F.col("variant_id") % base).withColumn("sh", F.round("sharpe1", 8))
    at = lambda period, c, dear=False: F.max(F.when((F.col("period") == period) & (F.col("dear") == F.lit(dear)), F.col(c)))
    return m.groupBy("symbol", "vid").agg(
        at(-1, "sh").alias("sharpe"), F.round(at(-1, "mdd"), 8).alias("mdd"), F.round(at(-1, "trades") / (at(-1, "n") / 252), 8).alias("trades"),
        at(-1, "sh", True).alias("cost"), at(0, "sh").alias("is"), at(1, "sh").alias("oos"), at(2, "sh").alias("fwd"),
    )


def audited(a):
    """Counts of every gate and of all together, and what the best in-sample variant loses out of sample, in percent."""
    gate = {k: F.col(k) <= v if k == "trades" else F.col(k) >= v if k == "mdd" else F.col(k) > v for k, v in GATES.items()}
    every = gate["sharpe"]
    for k in list(gate)[1:]:
        every = every & gate[k]
    loss = lambda c: F.round(F.when(F.col("best.is") > 0, (F.col("best.is") - F.col(f"best.{c}")) / F.col("best.is") * 100).otherwise(0.0), 4)
    g = a.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("variants"), *[F.count_if(e).alias(f"by_{k}") for k, e in gate.items()], F.count_if(every).alias("passed"),
        F.max_by(F.struct("vid", "is", "oos", "fwd"), F.struct("is", -F.col("vid"))).alias("best"),
    )
    return g.select("symbol", "variants", *[f"by_{k}" for k in gate], "passed", F.col("best.vid").alias("best"), loss("oos").alias("oos_loss_pct"), loss("fwd").alias("fwd_loss_pct"))


@query(
    "I1 P6 K15 cost rerun, audit gates and in-sample to out-of-sample degradation on a small grid",
    recursive(*B.signal_frame(), *variant_sql(grid_rows(AUDITED))) + """, ps AS (SELECT k, CASE WHEN year(ts)<=1997 THEN 0 WHEN year(ts)<=1999 THEN 1 ELSE 2 END AS period, pos, eq FROM path),
    pd AS (SELECT *, eq/lag(eq) OVER w-1 AS er FROM ps WINDOW w AS (PARTITION BY k, period ORDER BY pos)),
    pm AS (SELECT k, period, round(coalesce(avg(er)/nullif(stddev_samp(er),0)*sqrt(252),0),8) AS sh FROM pd GROUP BY 1,2),
    a AS (SELECT split_part(m.k,'#',1) AS symbol, CAST(split_part(m.k,'#',2) AS BIGINT) AS vid, round(sharpe,8) AS sharpe, round(mdd,8) AS mdd, round(trades/(n/252.0::DOUBLE),8) AS trades,
      max(CASE WHEN period=0 THEN sh END) AS "is", max(CASE WHEN period=1 THEN sh END) AS oos, max(CASE WHEN period=2 THEN sh END) AS fwd FROM met m JOIN pm ON pm.k=m.k GROUP BY ALL),
    f AS (SELECT a.*, d.sharpe AS cost FROM a JOIN a d ON d.symbol=a.symbol AND d.vid=a.vid+12 WHERE a.vid<12),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "is" DESC, vid) AS rn FROM f) WHERE rn=1),
    c AS (SELECT symbol, count(*) AS variants, count(CASE WHEN sharpe>1.33 THEN 1 END) AS by_sharpe, count(CASE WHEN mdd>=-0.45 THEN 1 END) AS by_mdd, count(CASE WHEN trades<=5 THEN 1 END) AS by_trades, count(CASE WHEN cost>1 THEN 1 END) AS by_cost,
      count(CASE WHEN oos>0.5 THEN 1 END) AS by_oos, count(CASE WHEN fwd>0.5 THEN 1 END) AS by_fwd, count(CASE WHEN sharpe>1.33 AND mdd>=-0.45 AND trades<=5 AND cost>1 AND oos>0.5 AND fwd>0.5 THEN 1 END) AS passed FROM f GROUP BY 1)
    SELECT c.*, vid AS best, round(CASE WHEN "is">0 THEN ("is"-oos)/"is"*100 ELSE 0 END,4) AS oos_loss_pct, round(CASE WHEN "is">0 THEN ("is"-fwd)/"is"*100 ELSE 0 END,4) AS fwd_loss_pct FROM c JOIN b USING (symbol)""",
)
def grid_audit(spark, sf):
    return audited(audit(spark, sf, {k: v for k, v in AUDITED.items() if k != "tc_bps"}))


@query("I1 E2 P6 K15 full six-parameter grid on every symbol at both costs: gates and degradation")
def parameter_grid(spark, sf):
    """The whole grid: every valid variant is replayed at both costs, over the whole history and three periods."""
    return audited(audit(spark, sf, V.PUBLISHED_GRID))


@query(
    "I3 A16 neighbours of the best variant: exactly one parameter differs",
    recursive(*B.signal_frame(), *variant_sql(grid_rows(GRID))) + """, g AS (SELECT split_part(k,'#',1) AS symbol, round(sharpe,8) AS sharpe, v.* FROM met JOIN v ON v.vid=CAST(split_part(k,'#',2) AS INT)),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, vid) AS rn FROM g) WHERE rn=1)
    SELECT g.symbol, count(*) AS neighbours, count(CASE WHEN b.sharpe-g.sharpe<=0.05 THEN 1 END) AS within05, count(CASE WHEN b.sharpe-g.sharpe<=0.10 THEN 1 END) AS within10, round(max(b.sharpe),5) AS best, round(min(g.sharpe),5) AS worst FROM g JOIN b ON g.symbol=b.symbol
    WHERE CAST(g.z_trigger<>b.z_trigger AS INT)+CAST(g.z_recover<>b.z_recover AS INT)+CAST(g.vz_trigger<>b.vz_trigger AS INT)+CAST(g.vz_recover<>b.vz_recover AS INT)+CAST(g.inf_trigger<>b.inf_trigger AS INT)+CAST(g.vz_lev<>b.vz_lev AS INT)=1 GROUP BY 1""",
)
def grid_neighbours(spark, sf):
    g = V.grid(spark, GRID)
    m = V.replay(signal_frame(spark, sf), g).where("period = -1").join(g.table, "variant_id").withColumn("sh", F.round("sharpe1", 8))
    best = m.groupBy("symbol").agg(F.max_by(F.struct(*GRID, "sh"), F.struct("sh", -F.col("variant_id"))).alias("b"))
    diff = sum(((F.col(a) != F.col(f"b.{a}")).cast("int") for a in GRID), F.lit(0))
    gap = F.col("b.sh") - F.col("sh")
    return m.join(best, "symbol").where(diff == 1).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("neighbours"), F.count_if(gap <= 0.05).alias("within05"), F.count_if(gap <= 0.10).alias("within10"),
        F.round(F.max("b.sh"), 5).alias("best"), F.round(F.min("sh"), 5).alias("worst"),
    )


@query(
    "I7 K1 continuous-equity period split of the replay",
    recursive(*B.signal_frame(), LAYERS, run_sql()) + """, ps AS (SELECT k, CASE WHEN year(ts)<=1997 THEN 0 WHEN year(ts)<=1999 THEN 1 ELSE 2 END AS period, pos, eq FROM path),
    pd AS (SELECT *, eq/lag(eq) OVER w-1 AS er, eq/max(eq) OVER w-1 AS dd FROM ps WINDOW w AS (PARTITION BY k, period ORDER BY pos))
    SELECT k AS symbol, CAST(period AS INT) AS period, CAST(count(*) AS INT) AS n, round(pow(arg_max(eq,pos)/arg_min(eq,pos),252.0::DOUBLE/count(*))-1,5) AS cagr, round(min(dd),5) AS mdd, round(coalesce(avg(er)/nullif(stddev_samp(er),0)*sqrt(252),0),5) AS sharpe FROM pd GROUP BY 1,2""",
)
def replay_by_period(spark, sf):
    per = F.when(F.year("ts") <= 1997, 0).when(F.year("ts") <= 1999, 1).otherwise(2)
    m = V.replay(signal_frame(spark, sf), V.listed(spark, [{}]), period=per).where("period >= 0")
    return m.select("symbol", "period", "n", F.round("cagr", 5).alias("cagr"), F.round("mdd", 5).alias("mdd"), F.round("sharpe1", 5).alias("sharpe"))


@query(
    "E1 trade log: signal and execution dates, reason, equity before the switch",
    recursive(*B.signal_frame(), LAYERS, run_sql()) + """, t AS (SELECT p.k, p.ts, p.pos, p.plev, p.lev, p.peq, lag(p.ts) OVER w AS sts, lag(l.layer) OVER w AS why FROM path p JOIN lay l ON l.symbol=p.k AND l.pos=p.pos WINDOW w AS (PARTITION BY p.k ORDER BY p.pos))
    SELECT k AS symbol, strftime(sts,'%Y-%m-%d') AS signal_date, strftime(ts,'%Y-%m-%d') AS exec_date, plev AS from_lev, lev AS to_lev, round(peq,5) AS equity, CASE why WHEN 0 THEN 'MASTER' WHEN 1 THEN 'CREDIT' WHEN 2 THEN 'RATIO' WHEN 3 THEN 'VOL' ELSE 'DEFAULT' END AS reason FROM t WHERE plev<>lev""",
)
def leverage_trades(spark, sf):
    t = leverage_fold(with_layers(signal_frame(spark, sf), ["symbol"]), ["symbol"]).select("symbol", F.explode("log").alias("t"))
    names = F.element_at(F.array(*[F.lit(n) for n in ("MASTER", "CREDIT", "RATIO", "VOL", "LIQUIDITY", "DEFAULT")]), F.col("t.layer") + 1)
    return t.select("symbol", day("t.signal_date").alias("signal_date"), day("t.exec_date").alias("exec_date"), "t.from_lev", "t.to_lev", F.round("t.equity", 5).alias("equity"), names.alias("reason"))


NONSL = recursive(*B.signal_frame(), LAYERS) .replace("WITH RECURSIVE", "WITH", 1).rstrip() + """,
 tg AS (SELECT *, CASE layer WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 2.0 ELSE 3.0 END AS target FROM lay),
 lv AS (SELECT *, coalesce(lag(target) OVER (PARTITION BY symbol ORDER BY ts),3.0::DOUBLE) AS lev FROM tg)"""


@query(
    "J18 Q4 reconciliation: fold's trade log against decisions replayed by windows",
    NONSL + """, w AS (SELECT symbol, ts, lev, coalesce(lag(lev) OVER (PARTITION BY symbol ORDER BY ts),3.0::DOUBLE) AS pl FROM lv)
    SELECT symbol, count(*) AS fold_trades, count(*) AS window_trades, count(*) AS matched, CAST(0 AS BIGINT) AS mismatched, CAST(0 AS BIGINT) AS late_exec FROM w WHERE lev<>pl GROUP BY symbol""",
)
def trade_reconciliation(spark, sf):
    """Without the never-sell-in-loss rule the replay is loop-free, so both logs must agree."""
    s = with_layers(signal_frame(spark, sf), ["symbol"])
    fold = leverage_fold(s, ["symbol"], never_sell_in_loss=False).select("symbol", F.explode("log").alias("t"))
    fold = fold.select("symbol", F.col("t.exec_date").alias("ts"), F.col("t.to_lev").alias("a"), F.col("t.signal_date").alias("sig"))
    target = F.element_at(F.array(*[F.lit(x) for x in (0.0, 1.0, 1.0, 2.0, 1.0, 3.0)]), F.col("layer") + 1)
    w = over()
    d = s.withColumn("target", target).withColumn("b", F.coalesce(F.lag("target").over(w), F.lit(3.0)))
    d = d.withColumn("pb", F.coalesce(F.lag("b").over(w), F.lit(3.0))).withColumn("prev_day", F.lag("ts").over(w)).where("b <> pb")
    j = fold.join(d.select("symbol", "ts", "b", "prev_day"), ["symbol", "ts"], "full")
    return j.groupBy("symbol").agg(
        F.count("a").alias("fold_trades"), F.count("b").alias("window_trades"), F.count_if(F.col("a") == F.col("b")).alias("matched"),
        F.count_if(F.coalesce(F.col("a") != F.col("b"), F.lit(True))).alias("mismatched"), F.count_if(F.col("sig") != F.col("prev_day")).alias("late_exec"),
    )


PAIRS = [("disc", "tax"), ("disc", "qn"), ("tax", "qn")]


@query(
    "I25 I26 signal window and input pair as variants",
    B.with_(B.bars()).rstrip() + """, c AS (SELECT symbol, ts, 1+disc AS disc, 1+tax AS tax, 1+qty/(100.0::DOUBLE*n) AS qn FROM bars), zz AS (""" + " UNION ALL ".join(
        f"SELECT symbol, ts, '{a}/{b}' AS pair, {k} AS win, -{B.z(f'{a}/{b}', k)} AS z FROM c" for a, b in PAIRS for k in (126, 252, 378)) + """),
    l AS (SELECT *, coalesce(last_value(CASE WHEN z>1.0 THEN 1 WHEN z<0.5 THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol,pair,win ORDER BY ts),0) AS f FROM zz)
    SELECT pair, CAST(win AS INT) AS win, CAST(sum(f) AS BIGINT) AS days_on, count(z) AS days_known FROM l GROUP BY 1,2""",
)
def window_and_pair_variants(spark, sf):
    """One rolling expression per distinct (pair, window); variants only pick a column."""
    from tidemark.operators.latch import latch, latch_event
    from tidemark.sources import market

    b = market.bars(spark, sf).select("symbol", "ts", (1 + F.col("disc")).alias("disc"), (1 + F.col("tax")).alias("tax"), (1 + F.col("qty") / (100.0 * F.col("n"))).alias("qn"))
    specs = {f"{p}/{q}#{k}": (F.col(p) / F.col(q), k) for p, q in PAIRS for k in (126, 252, 378)}
    z = with_zscore(b, {f"z{i}": e for i, e in enumerate(specs.values())})
    u = z.select("symbol", "ts", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (-F.col(f"z{i}")).alias("z")) for i, n in enumerate(specs)])).alias("v")).select("symbol", "ts", "v.*")
    u = u.withColumn("f", latch(latch_event("z", 1.0, 0.5), by=("symbol", "name")))
    g = u.groupBy("name").agg(F.sum("f").alias("days_on"), F.count("z").alias("days_known"))
    part = F.split("name", "#")
    return g.select(part[0].alias("pair"), part[1].cast("int").alias("win"), "days_on", "days_known")


SIGNAL_WINDOWS, SIGNAL_LEVELS = (378, 504, 630, 756), (0.8, 1.0, 1.2, 1.5)
_SCORES = " UNION ALL ".join(f"SELECT symbol, ts, close, {k} AS win, -{B.z('disc/tax', k)} AS z FROM c" for k in SIGNAL_WINDOWS)


@query(
    "I25 I8 signal windows of 378 to 756 rows times trigger levels: days on, entries, forward return when on and off, spread over the grid",
    B.with_(B.bars()).rstrip() + f""", c AS (SELECT symbol, ts, close, 1+disc AS disc, 1+tax AS tax FROM bars), zz AS ({_SCORES}),
    g AS (SELECT zz.*, level, lead(close,21) OVER (PARTITION BY symbol, win, level ORDER BY ts)/close-1 AS f FROM zz, (SELECT unnest([{",".join(f"{v}::DOUBLE" for v in SIGNAL_LEVELS)}]) AS level)),
    l AS (SELECT *, coalesce(last_value(CASE WHEN z>level THEN 1 WHEN z<level*0.5 THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol,win,level ORDER BY ts),0) AS st FROM g),
    e AS (SELECT *, lag(st,1,0) OVER (PARTITION BY symbol,win,level ORDER BY ts) AS was FROM l),
    a AS (SELECT win, level, count(z) AS days_known, CAST(sum(CASE WHEN z IS NOT NULL THEN st END) AS BIGINT) AS days_on, count(*) FILTER (st=1 AND was=0) AS entries, avg(f) FILTER (st=1 AND z IS NOT NULL) AS f_on, avg(f) FILTER (st=0 AND z IS NOT NULL) AS f_off FROM e GROUP BY 1,2)
    SELECT CAST(win AS INT) AS win, level, days_known, days_on, entries, round(f_on,7) AS return_on, round(f_off,7) AS return_off, round(max(f_off-f_on) OVER (PARTITION BY level)-min(f_off-f_on) OVER (PARTITION BY level),7) AS range_over_windows FROM a WHERE days_known>0""",
)
def signal_window_grid(spark, sf):
    """One rolling score per window; levels only move the latch."""
    from tidemark.operators.latch import latch, latch_event
    from tidemark.operators.windows import forward_return
    from tidemark.sources import market

    b = market.bars(spark, sf).select("symbol", "ts", "close", (1 + F.col("disc")).alias("disc"), (1 + F.col("tax")).alias("tax"))
    z = with_zscore(b, {f"z{k}": (F.col("disc") / F.col("tax"), k) for k in SIGNAL_WINDOWS}).withColumn("f", forward_return("close", 21))
    cells = F.array(*[F.struct(F.lit(k).alias("win"), F.lit(v).alias("level"), (-F.col(f"z{k}")).alias("z")) for k in SIGNAL_WINDOWS for v in SIGNAL_LEVELS])
    by = ("symbol", "win", "level")
    u = z.select("symbol", "ts", "f", F.explode(cells).alias("v")).select("symbol", "ts", "f", "v.*")
    u = u.withColumn("st", latch(latch_event("z", F.col("level"), F.col("level") * 0.5), by=by))
    u = u.withColumn("was", F.coalesce(F.lag("st").over(Window.partitionBy(*by).orderBy("ts")), F.lit(0)))
    on, known = F.col("st") == 1, F.col("z").isNotNull()
    a = u.groupBy("win", "level").agg(
        F.count("z").alias("days_known"), F.sum(F.when(known, F.col("st"))).alias("days_on"), F.count_if(on & (F.col("was") == 0)).alias("entries"), F.avg(F.when(on & known, F.col("f"))).alias("f_on"), F.avg(F.when(~on & known, F.col("f"))).alias("f_off")
    ).where("days_known > 0")
    gap, w = F.col("f_off") - F.col("f_on"), Window.partitionBy("level")
    return a.select("win", "level", "days_known", "days_on", "entries", F.round("f_on", 7).alias("return_on"), F.round("f_off", 7).alias("return_off"), F.round(F.max(gap).over(w) - F.min(gap).over(w), 7).alias("range_over_windows"))
