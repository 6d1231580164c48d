"""Sources, sinks, data quality and portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.expr import third_wednesday
from tidemark.operators import asof as A
from tidemark.operators import quality as Q
from tidemark.operators import windows as W
from tidemark.operators.fold import leverage_fold, with_layers
from tidemark.operators.signals import signal_frame
from tidemark.plans import base_sql as B
from tidemark.plans.base_queries import day
from tidemark.plans.fold_queries import LAYERS, METRICS, recursive, run_sql
from tidemark.plans.registry import query
from tidemark.session import calendar_sized
from tidemark.sources import files, market

SIG = B.with_(*B.signal_frame())
SIGX = SIG.rstrip() + ","
OB = B.with_(B.OBS)
BO = B.with_(B.bars(), B.OBS, B.CAL)
r6 = lambda c, n=None: F.round(c, 6).alias(n or c)


def cents_obs(spark, sf):
    """Observations with an integer value that prints the same everywhere."""
    return market.observations(spark, sf).withColumn("value", F.round(F.col("value") * 1e6).cast("long"))


CENTS = OB.rstrip() + ", oc AS (SELECT series_id, ts, CAST(round(value*1e6) AS BIGINT) AS v FROM obs)"
PER_SERIES = " SELECT series_id, count(*) AS n, CAST(sum(CAST(v AS DOUBLE)) AS BIGINT) AS total, strftime(min(ts),'%Y-%m-%d') AS first_ts, strftime(max(ts),'%Y-%m-%d') AS last_ts FROM oc GROUP BY 1"


def per_series(o):
    return o.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("long").alias("total"), day(F.min("ts")).alias("first_ts"), day(F.max("ts")).alias("last_ts"))


@query("S1 S16 CSV sink and single-series CSV scan named after the file", CENTS + PER_SERIES)
def csv_round_trip(spark, sf):
    out = files.scratch(spark, "series-csv")
    cents_obs(spark, sf).select("series_id", day().alias("ts"), "value").write.partitionBy("series_id").option("header", True).csv(out)
    raw = spark.read.schema("ts STRING, v STRING, series_id STRING").option("header", True).csv(out)
    return per_series(raw.select("series_id", F.col("ts").try_cast("date").alias("ts"), files.parse_number("v").alias("value")))


@query(
    "S6 polymorphic JSON: list of pairs or an object with values",
    CENTS + PER_SERIES.replace("FROM oc", "FROM oc WHERE v IS NOT NULL"),
)
def polymorphic_json(spark, sf):
    """One JSON text per (series, month), half of them wrapped in an object."""
    o = cents_obs(spark, sf)
    pair = F.array(day(), F.col("value").cast("string"))
    t = o.groupBy("series_id", F.trunc("ts", "month").alias("m")).agg(F.to_json(F.collect_list(pair)).alias("a"))
    t = t.select("series_id", F.when(F.month("m") % 2 == 0, F.concat(F.lit('{"values":'), F.col("a"), F.lit("}"))).otherwise(F.col("a")).alias("j"))
    return per_series(files.parse_values_json(t))


@query(
    "S8 observations JSON with a '.' sentinel",
    CENTS + " SELECT series_id, count(*) AS n, count(CASE WHEN v%7<>0 THEN 1 END) AS known, CAST(sum(CASE WHEN v%7<>0 THEN CAST(v AS DOUBLE) END) AS BIGINT) AS total FROM oc GROUP BY 1",
)
def observations_json(spark, sf):
    o = cents_obs(spark, sf)
    v = F.when(F.col("value") % 7 == 0, ".").otherwise(F.col("value").cast("string"))
    t = o.groupBy("series_id", F.trunc("ts", "month")).agg(F.to_json(F.struct(F.collect_list(F.struct(day().alias("date"), v.alias("value"))).alias("observations"))).alias("j"))
    p = files.parse_observations_json(t.select("series_id", "j"))
    return p.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"), F.sum("value").cast("long").alias("total"))


@query("S7 CSV with a preamble before the header", CENTS + PER_SERIES)
def preamble_csv(spark, sf):
    o = cents_obs(spark, sf)
    row = F.concat_ws(",", day(), F.col("value").cast("string"))
    t = o.groupBy("series_id", F.trunc("ts", "month")).agg(F.concat_ws("\n", F.lit("Curve data"), F.lit("see notes, not data"), F.lit("Date,VALUE"), F.concat_ws("\n", F.collect_list(row)), F.lit("footer")).alias("j"))
    return per_series(files.parse_preamble_csv(t.select("series_id", "j"), "Date,", ["value"]))


@query(
    "S2 S3 U1 incremental cache merge: newest version per key over an overlap",
    CENTS + " SELECT series_id, strftime(ts,'%Y-%m-%d') AS ts, CASE WHEN month(ts)%3=0 THEN v+1 ELSE v END AS value FROM oc",
)
def cache_merge(spark, sf):
    o = cents_obs(spark, sf)
    cached = o.withColumn("version", F.lit(1))
    new = o.where(F.month("ts") % 3 == 0).withColumn("value", F.col("value") + 1).withColumn("version", F.lit(2))
    return files.upsert(cached, new, ["series_id", "ts"], "version").select("series_id", day().alias("ts"), "value")


@query("S4 snapshot freeze and replay by partition", CENTS + PER_SERIES)
def snapshot_replay(spark, sf):
    path = files.scratch(spark, "snapshots")
    o = cents_obs(spark, sf)
    files.freeze(o, path, "first")
    files.freeze(o.withColumn("value", F.col("value") + 5), path, "second")
    return per_series(files.replay_snapshot(spark, path, "first", "series_id STRING, ts DATE, value BIGINT"))


@query(
    "S5 order-insensitive content checksum per series",
    CENTS + " SELECT series_id, printf('%08x', bit_xor(CAST('0x'||substr(md5(strftime(ts,'%Y-%m-%d')||'|'||v),1,8) AS BIGINT))) AS checksum, count(*) AS n FROM oc GROUP BY 1",
)
def series_checksums(spark, sf):
    return files.checksum(cents_obs(spark, sf), ["series_id"], [day(), F.col("value").cast("string")])


@query(
    "S9 wide to long, per-symbol profile",
    B.with_(B.bars()).rstrip() + " SELECT name, count(*) AS n, round(avg(v),6) AS mean FROM (SELECT 'open' AS name, open AS v FROM bars UNION ALL SELECT 'close', close FROM bars UNION ALL SELECT 'adj_close', adj_close FROM bars) GROUP BY 1",
)
def wide_profile(spark, sf):
    u = files.wide_to_long(market.bars(spark, sf), ["symbol", "ts"], ["open", "close", "adj_close"], "name")
    return u.groupBy("name").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean"))


LAB, SKIP = "(?i)the|de|en", "(?i)projection"
S10SQL = f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), h AS (SELECT doc_id, ls, list_filter(list_transform(range(1,len(ls)+1), lambda i: CASE WHEN regexp_matches(ls[i],'{LAB}') AND NOT regexp_matches(ls[i],'{SKIP}') THEN
  CASE WHEN len(regexp_extract_all(ls[i],'(\\d+\\.\\d+)',1))>0 THEN regexp_extract_all(ls[i],'(\\d+\\.\\d+)',1)
  WHEN len(regexp_extract_all(coalesce(ls[i+1],''),'(\\d+\\.\\d+)',1))>0 THEN regexp_extract_all(ls[i+1],'(\\d+\\.\\d+)',1) WHEN len(regexp_extract_all(coalesce(ls[i+2],''),'(\\d+\\.\\d+)',1))>0 THEN regexp_extract_all(ls[i+2],'(\\d+\\.\\d+)',1) ELSE regexp_extract_all(coalesce(ls[i+3],''),'(\\d+\\.\\d+)',1) END
  ELSE CAST([] AS VARCHAR[]) END), lambda a: len(a)>0) AS hits FROM l)
SELECT doc_id, CAST(least(len(hits[1]),4) AS INT) AS n, CAST(hits[1][1] AS DOUBLE) AS v0, CAST(hits[1][2] AS DOUBLE) AS v1, CAST(hits[1][3] AS DOUBLE) AS v2, CAST(hits[1][4] AS DOUBLE) AS v3 FROM h WHERE len(hits)>0"""


@query("S10 D1 labelled-number extraction from text lines with look-ahead", S10SQL)
def labelled_numbers(spark, sf):
    d = files.labelled_numbers(market.table(spark, sf, "documents").select("doc_id", "text"), LAB, SKIP, lookahead=3)
    return d.select("doc_id", F.size("numbers").alias("n"), *[F.try_element_at("by_offset", F.lit(i)).alias(f"v{i}") for i in range(4)])


OVERRIDES = [("1996-12-15", 1997, 2.5), ("1998-12-15", 1999, 2.9), ("2000-12-15", 2001, 3.1)]


@query(
    "S11 override table for missing rates, tagged source",
    B.with_(B.PROJ).rstrip() + ", o(d,ty,ov) AS (VALUES " + ",".join(f"(DATE '{d}',{y},{v}::DOUBLE)" for d, y, v in OVERRIDES) + """), p AS (SELECT md, ty, CASE WHEN month(md)=12 THEN NULL ELSE rate END AS rate FROM sigrow) SELECT strftime(md,'%Y-%m-%d') AS meeting_date, p.ty AS target_year, coalesce(rate,ov) AS rate, CASE WHEN rate IS NULL AND ov IS NOT NULL THEN 'override' ELSE 'parsed' END AS source FROM p LEFT JOIN o ON o.d=md AND o.ty=p.ty""",
)
def rate_overrides(spark, sf):
    p = market.projections(spark, sf)
    rate = F.when(F.month("meeting_date") != 12, F.try_element_at("rate", F.col("target_year")))
    x = files.apply_overrides(p.select("meeting_date", "target_year", rate.alias("rate")), OVERRIDES)
    return x.select(day("meeting_date").alias("meeting_date"), "target_year", "rate", "source")


@query(
    "S12 Q6 availability profile and freshness per series",
    OB + """, p AS (SELECT series_id, count(*) AS n, min(ts) AS a, max(ts) AS b, arg_max(value,ts) AS last_value FROM obs GROUP BY 1), m AS (SELECT max(ts) AS mx FROM obs)
    SELECT series_id, n, strftime(a,'%Y-%m-%d') AS first_ts, strftime(b,'%Y-%m-%d') AS last_ts, last_value, round(CAST(b-a AS DOUBLE)/(n-1),6) AS gap, CASE WHEN CAST(b-a AS DOUBLE)/(n-1)<3 THEN 'D' WHEN CAST(b-a AS DOUBLE)/(n-1)<10 THEN 'W' WHEN CAST(b-a AS DOUBLE)/(n-1)<60 THEN 'M' ELSE 'Q' END AS freq, CAST(mx-b AS INT) AS age_days FROM p JOIN m ON TRUE""".replace("\nobs", "obs"),
)
def availability_profile(spark, sf):
    p = files.frequency_profile(market.observations(spark, sf))
    newest = F.broadcast(p.agg(F.max("last_ts").alias("newest")).withColumn("k", F.lit(1)))  # one row
    p = p.withColumn("k", F.lit(1)).join(newest, "k")
    return p.select("series_id", "n", day("first_ts").alias("first_ts"), day("last_ts").alias("last_ts"), "last_value", r6("gap"), "freq", F.datediff("newest", "last_ts").alias("age_days"))


@query(
    "S13 S15 D8 Q5 expected against present days of every series: missing dates and next due date",
    BO + """, ex AS (SELECT CAST(unnest(generate_series(date_trunc('month',a), date_trunc('month',b), INTERVAL 1 MONTH)) AS DATE) AS m FROM (SELECT min(ts) AS a, max(ts) AS b FROM obs)), d AS (SELECT series_id, m+CAST(14+(3-isodow(m+14)+7)%7 AS INT) AS due FROM ex, (SELECT DISTINCT series_id FROM obs)), pr AS (SELECT DISTINCT series_id, ts FROM obs)
    SELECT d.series_id, CAST(year(due) AS INT) AS yr, count(*) AS expected, count(CASE WHEN ts IS NULL THEN 1 END) AS missing, strftime(min(CASE WHEN ts IS NULL THEN due END),'%Y-%m-%d') AS first_missing FROM d LEFT JOIN pr ON ts=due AND pr.series_id=d.series_id GROUP BY 1,2""",
)
def expected_documents(spark, sf):
    obs = market.observations(spark, sf)
    # one row: first and last month over all series, and the series
    span = obs.agg(F.trunc(F.min("ts"), "month").alias("a"), F.trunc(F.max("ts"), "month").alias("b"), F.collect_set("series_id").alias("ids"))
    months = span.select("ids", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("m"))
    due = months.select(F.explode("ids").alias("series_id"), third_wednesday("m").alias("ts"))
    present = obs.select("series_id", "ts").distinct().withColumn("here", F.lit(1))
    x = due.join(present, ["series_id", "ts"], "left")
    gone = F.col("here").isNull()
    return x.groupBy("series_id", F.year("ts").alias("yr")).agg(F.count(F.lit(1)).alias("expected"), F.count_if(gone).alias("missing"), day(F.min(F.when(gone, F.col("ts")))).alias("first_missing"))


@query(
    "S17 B3 nested JSON summary per symbol: weekly series and latest state",
    SIGX + """ w AS (SELECT symbol, CAST(ts+CAST((5-isodow(ts)+7)%7 AS INT) AS DATE) AS wts, arg_max(close,ts) AS c FROM sig GROUP BY 1,2), s AS (SELECT symbol, count(*) AS weeks, max(wts) AS lw, arg_max(c,wts) AS lc FROM w GROUP BY 1), l AS (SELECT symbol, arg_max(CAST(master AS INT),ts) AS m, max(ts) AS lt FROM sig GROUP BY 1)
    SELECT s.symbol, weeks, strftime(lw,'%Y-%m-%d') AS last_week, strftime(lt,'%Y-%m-%d') AS last_day, CAST(m AS INT) AS master, round(lc,4) AS last_close FROM s JOIN l USING (symbol)""",
)
def summary_payload(spark, sf):
    """Builds the payload as JSON and reads its headline fields back."""
    from tidemark.functions.expr import week_ending

    s = signal_frame(spark, sf)
    w = s.groupBy("symbol", week_ending("ts", "FR").alias("w")).agg(F.max_by("close", "ts").alias("c"))
    wk = w.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(day("w").alias("date"), F.round("c", 4).alias("value")))).alias("weekly"))
    latest = s.groupBy("symbol").agg(F.max_by(F.struct(day().alias("date"), F.col("master").cast("int").alias("master")), "ts").alias("latest"))
    j = wk.join(latest, "symbol").select("symbol", F.to_json(F.struct("weekly", "latest")).alias("payload"))
    p = j.withColumn("p", F.from_json("payload", "weekly array<struct<date:string,value:double>>, latest struct<date:string,master:int>"))
    last = F.element_at("p.weekly", -1)
    return p.select("symbol", F.size("p.weekly").cast("long").alias("weeks"), last["date"].alias("last_week"), F.col("p.latest.date").alias("last_day"), F.col("p.latest.master").alias("master"), last["value"].alias("last_close"))


@query(
    "Q1 Q2 null counts against a limit and a hard fail on missing input",
    SIGX + " n AS (SELECT symbol, count(CASE WHEN z IS NULL THEN 1 END) AS null_z, count(CASE WHEN r IS NULL THEN 1 END) AS null_r, count(CASE WHEN rate IS NULL THEN 1 END) AS null_rate, count(CASE WHEN z>1.2 THEN 1 END)>0 AS fires FROM sig GROUP BY 1) SELECT symbol, null_z, null_r, null_rate, null_r<=1 AS r_ok, fires FROM n",
)
def null_gates(spark, sf):
    s = Q.fail_if(signal_frame(spark, sf), F.col("close").isNull() | F.col("rate").isNull(), "close and rate must be present")
    g = s.groupBy("symbol").agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("z", "r", "rate")], (F.count_if(F.col("z") > 1.2) > 0).alias("fires"))
    return g.select("symbol", "null_z", "null_r", "null_rate", (F.col("null_r") <= 1).alias("r_ok"), "fires")


@query(
    "I23 Q3 structural checklist of the replay",
    recursive(*B.signal_frame(), LAYERS, run_sql(), METRICS).rstrip() + """, c AS (SELECT symbol, max(abs((1+gap)*(1+intra)-1-r))<0.0001 AS gap_ok, count(*)>252 AS long_enough FROM sig GROUP BY 1), j AS (SELECT k AS symbol, gap_ok, long_enough, trades>=1 AS has_trades, trades*252.0::DOUBLE/n<60 AS turnover_ok, mdd> -0.95 AS drawdown_ok, final>0.001 AS alive, in_market BETWEEN 0.2 AND 1 AS exposure_ok FROM met JOIN c ON c.symbol=met.k)
    SELECT symbol, "check", ok FROM j UNPIVOT (ok FOR "check" IN (gap_ok, long_enough, has_trades, turnover_ok, drawdown_ok, alive, exposure_ok))""",
)
def structural_checklist(spark, sf):
    s = signal_frame(spark, sf)
    data = s.groupBy("symbol").agg((F.max(F.abs((1 + F.col("gap")) * (1 + F.col("intra")) - 1 - F.col("r"))) < 0.0001).alias("gap_ok"), (F.count(F.lit(1)) > 252).alias("long_enough"))
    m = leverage_fold(with_layers(s, ["symbol"]), ["symbol"]).join(data, "symbol")
    checks = {
        "gap_ok": F.first("gap_ok"), "long_enough": F.first("long_enough"), "has_trades": F.max("trades") >= 1, "turnover_ok": F.max(F.col("trades") * 252.0 / F.col("n")) < 60,
        "drawdown_ok": F.min("mdd") > -0.95, "alive": F.max("final") > 0.001, "exposure_ok": F.max("in_market").between(0.2, 1),
    }
    return Q.checklist(m, ["symbol"], checks)


TRADES = """ px AS (SELECT ts, close FROM bars WHERE symbol='NO'), od AS (SELECT o_custkey AS holder, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus='F' THEN 'sell' ELSE 'buy' END AS side, o_totalprice/1e5::DOUBLE AS units FROM orders), tr AS (SELECT od.*, px.close AS price FROM od ASOF JOIN px ON od.d>=px.ts),
 po AS (SELECT holder, sum(CASE WHEN side='buy' THEN units ELSE 0 END) AS bought, sum(CASE WHEN side='sell' THEN units ELSE 0 END) AS sold, sum(CASE WHEN side='buy' THEN units*price ELSE 0 END) AS paid, sum(CASE WHEN side='sell' THEN units*price ELSE 0 END) AS received FROM tr GROUP BY 1), lp AS (SELECT arg_max(close,ts) AS px FROM px), fx AS (SELECT arg_max(value,ts)+1 AS fx FROM obs WHERE series_id='P5')"""


@query(
    "B1 holdings in two currencies, realised and unrealised profit per holder",
    BO.rstrip() + "," + TRADES + " SELECT holder, round(bought-sold,8) AS units, round(paid/nullif(bought,0),6) AS basis, round(received-sold*(paid/nullif(bought,0)),4) AS realised, round((bought-sold)*(px-paid/nullif(bought,0)),4) AS unrealised, round((bought-sold)*px,4) AS value_local, round((bought-sold)*px*fx,4) AS value_home FROM po JOIN lp ON TRUE JOIN fx ON TRUE",
)
def holdings_valuation(spark, sf):
    px = market.bars(spark, sf).where("symbol = 'NO'").select("symbol", "ts", F.col("close").alias("price"))
    o = market.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("holder"), F.col("o_orderdate").cast("date").alias("ts"), F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("side"), (F.col("o_totalprice") / 1e5).alias("units")
    )
    # prices are resolved once per day and met by key, so orders are never windowed on one symbol
    days = A.asof(o.select("ts").distinct().withColumn("symbol", F.lit("NO")), px, ["symbol"], "ts", ["price"]).where("price is not null")
    p = Q.positions(o.join(calendar_sized(days.select("ts", "price")), "ts"), ["holder"])
    last = px.agg(F.max_by("price", "ts").alias("px"))
    fx = market.observations(spark, sf).where("series_id = 'P5'").agg((F.max_by("value", "ts") + 1).alias("fx"))
    quote = F.broadcast(last.withColumn("k", F.lit(1)).join(fx.withColumn("k", F.lit(1)), "k"))  # exactly one row
    p = p.withColumn("k", F.lit(1)).join(quote, "k")
    value = F.col("units") * F.col("px")
    r4 = lambda c, n: F.round(c, 4).alias(n)
    return p.select("holder", F.round("units", 8).alias("units"), r6("basis"), r4(F.col("realised"), "realised"), r4(F.col("units") * (F.col("px") - F.col("basis")), "unrealised"), r4(value, "value_local"), r4(value * F.col("fx"), "value_home"))


HORIZONS = {"1D": 1, "1W": 5, "1M": 21, "1Q": 63, "1Y": 252}


@query(
    "B1 P14 change over 1D/1W/1M/1Q/1Y by row offset with fallback to the first row",
    SIGX + " l AS (SELECT symbol, pos, close, " + ", ".join(f"coalesce(lag(close,{n}) OVER w, first_value(close) OVER w) AS c{k}" for k, n in HORIZONS.items()) + " FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY pos)) SELECT symbol, " + ", ".join(f"round((arg_max(close,pos)/arg_max(c{k},pos)-1)*100,5) AS chg_{k.lower()}" for k in HORIZONS) + " FROM l GROUP BY 1",
)
def horizon_changes(spark, sf):
    w = W.over()
    s = signal_frame(spark, sf).withColumns({f"c{k}": F.coalesce(F.lag("close", n).over(w), F.first("close").over(W.upto())) for k, n in HORIZONS.items()})
    last = s.groupBy("symbol").agg(F.max_by(F.struct("close", *[f"c{k}" for k in HORIZONS]), "pos").alias("x"))
    return last.select("symbol", *[F.round((F.col("x.close") / F.col(f"x.c{k}") - 1) * 100, 5).alias(f"chg_{k.lower()}") for k in HORIZONS])


@query(
    "B2 implied price from a proxy move: the larger deviation wins",
    SIGX + " j AS (SELECT s.symbol, s.ts, lag(s.close) OVER (PARTITION BY s.symbol ORDER BY s.pos) AS base, s.close AS post, b.r AS br FROM sig s JOIN sig b ON b.ts=s.ts AND b.symbol='NO') SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, round(CASE WHEN abs(base*(1+3*br)-base)>abs(post-base) THEN base*(1+3*br) ELSE post END,6) AS implied FROM j WHERE base IS NOT NULL AND br IS NOT NULL",
)
def implied_price(spark, sf):
    s = signal_frame(spark, sf)
    b = s.where("symbol = 'NO'").select("ts", F.col("r").alias("br"))
    j = s.join(calendar_sized(b), "ts").withColumn("base", F.lag("close").over(W.over())).where("base is not null and br is not null")
    sim = F.col("base") * (1 + 3 * F.col("br"))
    pick = F.when(F.abs(sim - F.col("base")) > F.abs(F.col("close") - F.col("base")), sim).otherwise(F.col("close"))
    return j.select("symbol", day().alias("ts"), r6(pick, "implied"))
