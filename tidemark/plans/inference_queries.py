"""Bootstraps, permutations, tests and break scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.expr import draw
from tidemark.operators import inference as N
from tidemark.operators import variants as V
from tidemark.operators import windows as W
from tidemark.operators.episodes import cooled_episodes
from tidemark.operators.signals import shared, signal_frame
from tidemark.plans import base_sql as B
from tidemark.plans.base_queries import day
from tidemark.plans.fold_queries import recursive
from tidemark.plans.machine_queries import COOL
from tidemark.plans.registry import query
from tidemark.plans.variant_queries import variant_sql
from tidemark.session import calendar_sized, fan_join

SIG = B.with_(*B.signal_frame())
SIGX = SIG.rstrip() + ","
RSIGX = SIGX.replace("WITH ", "WITH RECURSIVE ", 1)
P = 2147483647


def draw_cols(keys, n, name):
    """Lateral-alias form of the counter-based draw."""
    out, h = [], "0"
    for i, k in enumerate(keys):
        out += [f"({h}+CAST({k} AS BIGINT)*1000003+{7919 * (i + 1)})%{P} AS x{i}_", f"(x{i}_*x{i}_)%{P} AS y{i}_", f"(((y{i}_*y{i}_)%{P})*x{i}_)%{P} AS h{i}_"]
        h = f"h{i}_"
    return ", ".join(out) + f", {h}%({n}) AS {name}"


LAYER_SETS = [{}, {"use_credit": 0}, {"use_ratio": 0}, {"use_vol": 0}]
NAMES = ["full", "credit", "ratio", "vol"]
REPS = 10000
BOOT_BLOCKS = [21, 63, 126]


def wide_returns(spark, sf):
    """Daily equity returns of the full rule set and of each reduced one, side by side."""
    return shared(spark, "ablation-returns", sf, lambda: build_wide_returns(spark, sf))


def build_wide_returns(spark, sf):
    p = V.equity_paths(signal_frame(spark, sf), V.listed(spark, LAYER_SETS))
    e = p.withColumn("er", F.col("eq") / F.lag("eq").over(Window.partitionBy("symbol", "variant_id").orderBy("pos")) - 1)
    e = e.where("er is not null")
    return e.groupBy("symbol", "pos").agg(*[F.max(F.when(F.col("variant_id") == i, F.col("er"))).alias(n) for i, n in enumerate(NAMES)])


BOOT = """,
er AS (SELECT k, pos, eq/lag(eq) OVER (PARTITION BY k ORDER BY pos)-1 AS er FROM path),
wr AS MATERIALIZED (SELECT split_part(k,'#',1) AS symbol, pos-2 AS p, """ + ", ".join(f"max(CASE WHEN split_part(k,'#',2)='{i}' THEN er END) AS r{i}" for i in range(4)) + """ FROM er WHERE er IS NOT NULL GROUP BY 1,2),
cs AS MATERIALIZED (SELECT symbol, p, """ + ", ".join(f"sum(r{i}) OVER w AS s{i}, sum(r{i}*r{i}) OVER w AS q{i}" for i in range(4)) + """ FROM wr WINDOW w AS (PARTITION BY symbol ORDER BY p)),
sz AS (SELECT symbol, count(*) AS n FROM wr GROUP BY 1),
dr AS (SELECT *, """ + "{draw}" + """ FROM (SELECT symbol, n, b, rep, unnest(generate_series(0, n//b)) AS k FROM (SELECT symbol, n, b, unnest(generate_series(0,{reps}-1)) AS rep FROM sz JOIN (VALUES (21),(63),(126)) t(b) ON n>=b))),
bs AS (SELECT d.symbol, d.b, d.rep, any_value(d.n) AS n, """ + ", ".join(f"sum(coalesce(e.s{i},0)-coalesce(a.s{i},0)) AS s{i}, sum(coalesce(e.q{i},0)-coalesce(a.q{i},0)) AS q{i}" for i in range(4)) + """
  FROM dr d LEFT JOIN cs a ON a.symbol=d.symbol AND a.p=d.start-1 LEFT JOIN cs e ON e.symbol=d.symbol AND e.p=d.start-1+CASE WHEN d.k=d.n//d.b THEN d.n%d.b ELSE d.b END GROUP BY 1,2,3),
sh AS (SELECT symbol, b, """ + ", ".join(f"(s{i}/n)/sqrt(q{i}/n-(s{i}/n)*(s{i}/n))*sqrt(252) AS h{i}" for i in range(4)) + """ FROM bs)
"""


@query(
    "I9 paired moving-block bootstrap of the Sharpe difference, three block sizes, three layers",
    recursive(*B.signal_frame(), *variant_sql(LAYER_SETS)).rstrip() + BOOT.replace("{draw}", draw_cols(["42", "rep", "k"], "n-b+1", "start")).replace("{reps}", str(REPS))
    + " UNION ALL ".join(f"SELECT symbol, CAST(b AS INT) AS b, '{n}' AS layer, round(avg(CAST(round(h0-h{i},9)>0 AS INT)),6) AS p_better, round(quantile_cont(round(h0-h{i},9),0.025),6) AS lo, round(quantile_cont(round(h0-h{i},9),0.975),6) AS hi FROM sh GROUP BY 1,2" for i, n in enumerate(NAMES) if i),
)
def bootstrap_sharpe_difference(spark, sf):
    w = wide_returns(spark, sf)
    vals = {f"s_{n}": F.col(n) for n in NAMES} | {f"q_{n}": F.col(n) * F.col(n) for n in NAMES}
    b = N.block_bootstrap(w, ["symbol"], BOOT_BLOCKS, vals, REPS)
    sh = {n: N.sharpe_from_sums(f"s_{n}", f"q_{n}") for n in NAMES}
    diffs = F.array(*[F.struct(F.lit(n).alias("layer"), F.round(sh["full"] - sh[n], 9).alias("d")) for n in NAMES[1:]])
    d = b.select("symbol", "b", F.explode(diffs).alias("v")).select("symbol", "b", "v.*")
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    g = d.groupBy("symbol", "b", "layer").agg(F.avg((F.col("d") > 0).cast("int")).alias("p"), q.alias("q"))
    return g.select("symbol", "b", "layer", F.round("p", 6).alias("p_better"), F.round(F.col("q")[0], 6).alias("lo"), F.round(F.col("q")[1], 6).alias("hi"))


CRASH = """ v0 AS (SELECT symbol, pos, master, z>1.0 AS dg, (SELECT 1) AS one, lead(pos,63) OVER (PARTITION BY symbol ORDER BY pos) AS ok FROM sig),
fm AS (SELECT a.symbol, a.pos, min(c/pk-1) AS mdd FROM (SELECT a.symbol, a.pos, b.close AS c, max(b.close) OVER (PARTITION BY a.symbol,a.pos ORDER BY b.pos) AS pk FROM sig a JOIN sig b ON a.symbol=b.symbol AND b.pos BETWEEN a.pos AND a.pos+62 WHERE (a.pos-1)%5=0) a GROUP BY 1,2),
ws AS (SELECT v0.symbol, row_number() OVER (PARTITION BY v0.symbol ORDER BY v0.pos)-1 AS p, CAST(master=1 AS INT) AS inn, CAST(master=1 AND mdd<=-0.08 AS INT) AS inh, CAST(master=1 AND coalesce(dg,FALSE) AS INT) AS fl, CAST(master=1 AND coalesce(dg,FALSE) AND mdd<=-0.08 AS INT) AS fh FROM v0 JOIN fm ON fm.symbol=v0.symbol AND fm.pos=v0.pos WHERE ok IS NOT NULL),
cs AS MATERIALIZED (SELECT symbol, p, sum(inn) OVER w AS s0, sum(inh) OVER w AS s1, sum(fl) OVER w AS s2, sum(fh) OVER w AS s3 FROM ws WINDOW w AS (PARTITION BY symbol ORDER BY p)), sz AS (SELECT symbol, count(*) AS n FROM ws GROUP BY 1),
dr AS (SELECT *, {draw} FROM (SELECT symbol, n, b, rep, unnest(generate_series(0, n//b)) AS k FROM (SELECT symbol, n, b, unnest(generate_series(0,{reps}-1)) AS rep FROM sz JOIN (VALUES (13),(26)) t(b) ON n>=b))),
bs AS (SELECT d.symbol, d.b, d.rep, """ + ", ".join(f"CAST(sum(coalesce(e.s{i},0)-coalesce(a.s{i},0)) AS DOUBLE) AS s{i}" for i in range(4)) + """ FROM dr d LEFT JOIN cs a ON a.symbol=d.symbol AND a.p=d.start-1 LEFT JOIN cs e ON e.symbol=d.symbol AND e.p=d.start-1+CASE WHEN d.k=d.n//d.b THEN d.n%d.b ELSE d.b END GROUP BY 1,2,3),
li AS (SELECT symbol, b, CASE WHEN s2>0 THEN s3/s2 ELSE 0 END - s1/s0 AS lift FROM bs WHERE s0>0)
SELECT symbol, CAST(b AS INT) AS b, round(avg(CAST(lift>0 AS INT)),6) AS p_pos, round(quantile_cont(lift,0.025),5) AS lo, round(quantile_cont(lift,0.975),5) AS hi FROM li GROUP BY 1,2"""


@query("I10 P12 W15 block bootstrap of the conditional crash lift on five-day samples", SIGX + CRASH.replace("{draw}", draw_cols(["42", "rep", "k"], "n-b+1", "start")).replace("{reps}", str(REPS)))
def bootstrap_crash_lift(spark, sf):
    s = signal_frame(spark, sf).withColumn("ok", F.lead("pos", 63).over(W.over())).withColumn("mdd", W.forward_drawdown("close", 0, 62))
    s = s.where("(pos - 1) % 5 = 0 and ok is not null")
    inside, flag, hit = F.col("master") == 1, F.coalesce(F.col("z") > 1.0, F.lit(False)), F.col("mdd") <= -0.08
    num = lambda c: c.cast("double")
    vals = {"n_in": num(inside), "n_hit": num(inside & hit), "n_flag": num(inside & flag), "n_fhit": num(inside & flag & hit)}
    b = N.block_bootstrap(s, ["symbol"], [13, 26], vals, REPS).where("n_in > 0.5")
    flagged = F.when(F.col("n_flag") > 0.5, F.round(F.col("n_fhit")) / F.round("n_flag")).otherwise(0.0)
    b = b.withColumn("lift", flagged - F.round("n_hit") / F.round("n_in"))
    g = b.groupBy("symbol", "b").agg(F.avg((F.col("lift") > 0).cast("int")).alias("p"), F.percentile("lift", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return g.select("symbol", "b", F.round("p", 6).alias("p_pos"), F.round(F.col("q")[0], 5).alias("lo"), F.round(F.col("q")[1], 5).alias("hi"))


@query(
    "I11 I15 iid bootstrap of a mean difference, pooled under the null",
    SIGX + f""" x AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY pos)-1 AS p, CAST(ts>=DATE '1999-01-01' AS INT) AS g FROM sig WHERE r IS NOT NULL),
    a AS (SELECT symbol, count(*) AS n, count(CASE WHEN g=0 THEN 1 END) AS n0, avg(CASE WHEN g=1 THEN r END)-avg(CASE WHEN g=0 THEN r END) AS d FROM x GROUP BY 1),
    dr AS (SELECT *, {draw_cols(["7", "rep", "k"], "n", "p")} FROM (SELECT symbol, n, n0, d, rep, unnest(generate_series(0,n-1)) AS k FROM (SELECT a.*, unnest(generate_series(0,199)) AS rep FROM a))),
    b AS (SELECT dr.symbol, rep, any_value(d) AS d, avg(CASE WHEN k>=n0 THEN r END)-avg(CASE WHEN k<n0 THEN r END) AS bd FROM dr JOIN x ON x.symbol=dr.symbol AND x.p=dr.p GROUP BY 1,2)
    SELECT symbol, round(any_value(d),8) AS diff, round(avg(CAST(abs(bd)>=abs(d) AS INT)),6) AS p_value, round(avg(bd),8) AS null_mean, round(stddev_samp(bd),8) AS null_sd FROM b GROUP BY 1""",
)
def bootstrap_mean_difference(spark, sf):
    return mean_difference_test(spark, sf, 200)


def mean_difference_test(spark, sf, reps, by="flag"):
    s = signal_frame(spark, sf, by, reused=by == "flag").where("r is not null").select("symbol", "pos", "r", (F.col("ts") >= F.to_date(F.lit("1999-01-01"))).cast("int").alias("late"))
    real = F.avg(F.when(F.col("late") == 1, F.col("r"))) - F.avg(F.when(F.col("late") == 0, F.col("r")))
    b = N.per_replicate(s, ["symbol"], {"r": F.col("r"), "late": F.col("late")}, reps, N.mean_difference(7), ["bd"], totals={"d": real})
    b = b.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("d", "bd")})
    return b.groupBy("symbol").agg(
        F.round(F.first("d"), 8).alias("diff"), F.round(F.avg((F.abs("bd") >= F.abs("d")).cast("int")), 6).alias("p_value"),
        F.round(F.avg("bd"), 8).alias("null_mean"), F.round(F.stddev_samp("bd"), 8).alias("null_sd"),
    )


@query("I11 I15 the same bootstrap with 10,000 replicates")
def bootstrap_mean_difference_full(spark, sf):
    return mean_difference_test(spark, sf, 10_000)


SPACED = f""" fw AS (SELECT symbol, pos, lead(close,21) OVER (PARTITION BY symbol ORDER BY pos)/close-1 AS f FROM sig),
 ev AS (SELECT ep.symbol, count(*) AS m, avg(f) AS real FROM ep JOIN fw ON fw.symbol=ep.symbol AND fw.pos=ep.pos WHERE f IS NOT NULL GROUP BY 1), mx AS (SELECT symbol, max(pos)-21 AS n FROM sig GROUP BY 1),
 sp(symbol,rep,m,real,n,k,acc) AS (SELECT symbol, rep, m, real, n, 0, CAST([] AS BIGINT[]) FROM (SELECT ev.*, mx.n, unnest(generate_series(0,199)) AS rep FROM ev JOIN mx USING (symbol))
  UNION ALL SELECT symbol, rep, m, real, n, k+1, CASE WHEN len(acc)<m AND len(list_filter(acc, lambda a: abs(a-c)<42))=0 THEN list_append(acc,c) ELSE acc END FROM (SELECT *, {draw_cols(["11", "rep", "k"], "n", "c")} FROM sp WHERE k<500 AND len(acc)<m)),
 fin AS (SELECT symbol, rep, real, unnest(acc) AS c FROM sp WHERE len(acc)=m), pm AS (SELECT fin.symbol, rep, any_value(real) AS real, avg(f) AS v FROM fin JOIN fw ON fw.symbol=fin.symbol AND fw.pos=fin.c+1 GROUP BY 1,2)
 SELECT symbol, count(*) AS reps, round(any_value(real),6) AS real, round(avg(v),6) AS null_mean, round(avg(CAST(v<=real AS INT)),6) AS p_value FROM pm GROUP BY 1"""


@query("I12 spaced random-date permutation: greedy acceptance of at most 500 draws", RSIGX + COOL.format(g=60) + "," + SPACED)
def spaced_permutation(spark, sf):
    return episode_permutation(spark, sf, 200, N.spaced_dates(11, 42, 500, 21), ["v", "full"])


def episode_permutation(spark, sf, reps, kernel, out):
    """Mean forward return of the episodes against replicates of their dates."""
    s = signal_frame(spark, sf).withColumn("f", W.forward_return("close", 21))
    e = cooled_episodes(s, F.col("z") > 1.0, 60).where("f is not null").select("symbol", "pos", F.lit(1).alias("event"))
    x = s.select("symbol", "pos", "f").join(e, ["symbol", "pos"], "left")
    real = x.where("event = 1").groupBy("symbol").agg(F.avg("f").alias("real"))
    columns = {"f": F.col("f"), "event": F.coalesce("event", F.lit(0))}
    p = N.per_replicate(x, ["symbol"], columns, reps, kernel, out)
    p = (p.where("full = 1") if "full" in out else p).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    return real.join(p, "symbol").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("reps"), F.round(F.first("real"), 6).alias("real"), F.round(F.avg("v"), 6).alias("null_mean"),
        F.round(F.avg((F.col("v") <= F.col("real")).cast("int")), 6).alias("p_value"),
    )


@query("I12 the same permutation with 100,000 replicates")
def spaced_permutation_full(spark, sf):
    return episode_permutation(spark, sf, 100_000, N.spaced_dates(11, 42, 500, 21), ["v", "full"])


@query(
    "I13 shift permutation that keeps the gaps between episodes",
    SIGX + COOL.format(g=60) + f""", fw AS (SELECT symbol, pos, lead(close,21) OVER (PARTITION BY symbol ORDER BY pos)/close-1 AS f FROM sig), e2 AS (SELECT ep.symbol, ep.pos, f FROM ep JOIN fw ON fw.symbol=ep.symbol AND fw.pos=ep.pos WHERE f IS NOT NULL),
    a AS (SELECT e2.symbol, min(pos) AS p0, max(pos)-min(pos) AS span, avg(f) AS real, (SELECT max(pos) FROM sig s WHERE s.symbol=e2.symbol) AS n FROM e2 GROUP BY 1), dr AS (SELECT *, {draw_cols(["13", "rep"], "n-span-22", "start")} FROM (SELECT *, unnest(generate_series(0,999)) AS rep FROM a WHERE n-span-22>0)),
    v AS (SELECT dr.symbol, rep, any_value(real) AS real, avg(fw.f) AS v FROM dr JOIN e2 ON e2.symbol=dr.symbol JOIN fw ON fw.symbol=dr.symbol AND fw.pos=dr.start+1+e2.pos-p0 GROUP BY 1,2)
    SELECT symbol, count(*) AS reps, round(any_value(real),6) AS real, round(avg(v),6) AS null_mean, round(avg(CAST(v<=real AS INT)),6) AS p_value FROM v GROUP BY 1""",
)
def shift_permutation(spark, sf):
    return episode_permutation(spark, sf, 1000, N.shifted_events(13, 22), ["v"])


@query("I13 the same permutation with 100,000 replicates")
def shift_permutation_full(spark, sf):
    return episode_permutation(spark, sf, 100_000, N.shifted_events(13, 22), ["v"])


@query(
    "I14 A10 circular-shift permutation of a one-feature fit",
    SIGX + f""" x AS (SELECT symbol, z, f, row_number() OVER (PARTITION BY symbol ORDER BY pos)-1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT symbol, pos, z, lead(close,5) OVER (PARTITION BY symbol ORDER BY pos)/close-1 AS f FROM sig) WHERE z IS NOT NULL AND f IS NOT NULL),
    a AS (SELECT symbol, any_value(n) AS n, regr_r2(f,z) AS real FROM x GROUP BY 1), dr AS (SELECT *, 26+{draw_cols(["17", "rep"], "n-52", "sh0").replace(" AS sh0", "")} AS sh FROM (SELECT *, unnest(generate_series(0,199)) AS rep FROM a)),
    v AS (SELECT dr.symbol, rep, any_value(real) AS real, regr_r2(y.f,x.z) AS v FROM dr JOIN x ON x.symbol=dr.symbol JOIN x y ON y.symbol=x.symbol AND y.p=(x.p+dr.sh)%dr.n GROUP BY 1,2)
    SELECT symbol, round(any_value(real),6) AS real, round(avg(v),6) AS null_mean, round(quantile_cont(v,0.95),6) AS null_p95, round(avg(CAST(v>=real AS INT)),6) AS p_value FROM v GROUP BY 1""".replace("26+(0+", "(0+").replace("h1_%(n-52) AS sh", "26+h1_%(n-52) AS sh"),
)
def circular_shift_permutation(spark, sf):
    s = signal_frame(spark, sf).withColumn("f", W.forward_return("close", 5)).where("z is not null and f is not null")
    a = s.groupBy("symbol").agg(F.regr_r2("f", "z").alias("real"))
    v = N.per_replicate(s, ["symbol"], {"z": F.col("z"), "f": F.col("f")}, 200, N.shifted_fit(17, 26), ["v"])
    return a.join(v, "symbol").groupBy("symbol").agg(
        F.round(F.first("real"), 6).alias("real"), F.round(F.avg("v"), 6).alias("null_mean"), F.round(F.percentile("v", 0.95), 6).alias("null_p95"),
        F.round(F.avg((F.col("v") >= F.col("real")).cast("int")), 6).alias("p_value"),
    )


WALK_SQL = f""" x AS (SELECT symbol, z, f, row_number() OVER (PARTITION BY symbol ORDER BY pos)-1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT symbol, pos, z, lead(close,5) OVER (PARTITION BY symbol ORDER BY pos)/close-1 AS f FROM sig) WHERE z IS NOT NULL AND f IS NOT NULL),
    a AS (SELECT symbol, any_value(n) AS n FROM x GROUP BY 1), dr AS (SELECT symbol, n, rep, 26+sh0 AS sh FROM (SELECT *, {draw_cols(["19", "rep"], "n-52", "sh0")} FROM (SELECT *, unnest(generate_series(0,199)) AS rep FROM a)) UNION ALL SELECT symbol, n, -1, 0 FROM a),
    y AS (SELECT dr.symbol, rep, x.p, x.z, s.f FROM dr JOIN x ON x.symbol=dr.symbol JOIN x s ON s.symbol=x.symbol AND s.p=(x.p+dr.sh)%dr.n),
    u AS (SELECT *, count(*) OVER w AS k, sum(z) OVER w AS sz, sum(z*z) OVER w AS szz, sum(f) OVER w AS sf, sum(f*z) OVER w AS sfz FROM y WINDOW w AS (PARTITION BY symbol, rep ORDER BY p)),
    l AS (SELECT symbol, rep, p, z, f, lag(k,6) OVER w AS k, lag(sz,6) OVER w AS sz, lag(szz,6) OVER w AS szz, lag(sf,6) OVER w AS sf, lag(sfz,6) OVER w AS sfz FROM u WINDOW w AS (PARTITION BY symbol, rep ORDER BY p)),
    c AS (SELECT symbol, rep, p, z, f, (sfz-sz*sf/k)/(szz-sz*sz/k) AS b, sf/k AS m, sf/k-(sfz-sz*sf/k)/(szz-sz*sz/k)*sz/k AS a FROM l),
    v AS (SELECT symbol, rep, 1-sum((f-a-b*z)*(f-a-b*z))/sum((f-m)*(f-m)) AS v FROM c WHERE p>=252 GROUP BY 1,2)
    SELECT v.symbol, round(any_value(r.v),6) AS real, round(avg(v.v),6) AS null_mean, round(quantile_cont(v.v,0.95),6) AS null_p95, round(avg(CAST(v.v>=r.v AS INT)),6) AS p_value FROM v JOIN v r ON r.symbol=v.symbol AND r.rep=-1 WHERE v.rep>=0 GROUP BY 1"""


@query("I14 M2 circular-shift permutation with the whole expanding walk-forward refitted per shift", SIGX + WALK_SQL)
def circular_shift_walk_forward(spark, sf):
    s = signal_frame(spark, sf).withColumn("f", W.forward_return("close", 5)).where("z is not null and f is not null")
    v = N.per_replicate(s, ["symbol"], {"z": F.col("z"), "f": F.col("f")}, 200, N.shifted_walk_forward(19, 26, 252, 6), ["v", "real"])
    return v.groupBy("symbol").agg(
        F.round(F.first("real"), 6).alias("real"), F.round(F.avg("v"), 6).alias("null_mean"), F.round(F.percentile("v", 0.95), 6).alias("null_p95"),
        F.round(F.avg((F.col("v") >= F.col("real")).cast("int")), 6).alias("p_value"),
    )


def feistel_sql(seed: int) -> str:
    """One pass of the keyed bijection over column v with half, rep and n, as nested selects."""
    mix = lambda v, i: (f"(({v})*1000003+7919)%{P} AS x{i}, (x{i}*x{i})%{P} AS y{i}", f"(((y{i}*y{i})%{P})*x{i})%{P}")
    cols, left, right = ["v>>half AS l0, v&((1<<half)-1) AS r0"], "l0", "r0"
    for k in range(4):
        key = seed * 4 + k
        x = (key * 1000003 + 7919) % P
        first = ((((x * x) % P) ** 2 % P) * x) % P
        a, key_k = mix(f"{first}+rep", f"k{k}")
        b, out = mix(f"{right}+kk{k}", f"v{k}")
        cols.append(f"{a}, {key_k} AS kk{k}, {b}, xor({left}, ({out})&((1<<half)-1)) AS r{k + 1}")
        left, right = right, f"r{k + 1}"
    return ", ".join(cols) + f", ({left}<<half)|{right} AS nv"


SHUFFLE_SQL = WALK_SQL[: WALK_SQL.index("dr AS (")] + f"""st AS (SELECT symbol, n, rep, (strlen(ltrim(bin(n-1),'0'))+1)//2 AS half, unnest(generate_series(0,n-1)) AS p FROM (SELECT symbol, n, unnest(generate_series(0,199)) AS rep FROM a)),
    fe(symbol, n, rep, half, p, v) AS (SELECT symbol, n, rep, half, p, nv FROM (SELECT *, {feistel_sql(23)} FROM (SELECT *, p AS v FROM st))
      UNION ALL SELECT symbol, n, rep, half, p, nv FROM (SELECT *, {feistel_sql(23)} FROM (SELECT * FROM fe WHERE v>=n))),
    y AS (SELECT fe.symbol, rep, x.p, x.z, s.f FROM fe JOIN x ON x.symbol=fe.symbol AND x.p=fe.p JOIN x s ON s.symbol=fe.symbol AND s.p=fe.v WHERE fe.v<fe.n UNION ALL SELECT symbol, -1, p, z, f FROM x),
    u AS (""" + WALK_SQL.split("    u AS (", 1)[1]


@query("I14 M2 label shuffle with the whole expanding walk-forward refitted per replicate, by a keyed bijection", RSIGX + SHUFFLE_SQL)
def label_shuffle_walk_forward(spark, sf):
    s = signal_frame(spark, sf).withColumn("f", W.forward_return("close", 5)).where("z is not null and f is not null")
    v = N.per_replicate(s, ["symbol"], {"z": F.col("z"), "f": F.col("f")}, 200, N.shuffled_walk_forward(23, 252, 6), ["v", "real"])
    return v.groupBy("symbol").agg(
        F.round(F.first("real"), 6).alias("real"), F.round(F.avg("v"), 6).alias("null_mean"), F.round(F.percentile("v", 0.95), 6).alias("null_p95"),
        F.round(F.avg((F.col("v") >= F.col("real")).cast("int")), 6).alias("p_value"),
    )


GRP = "CAST(ts>=DATE '1999-01-01' AS INT)"


def group(d="1999-01-01"):
    return (F.col("ts") >= F.to_date(F.lit(d))).cast("int")


@query(
    "I16 I17 V7 two-sample t, Welch t and variance ratio before and after a break",
    SIGX + f""" a AS (SELECT symbol, count(CASE WHEN g=0 THEN r END) AS n0, count(CASE WHEN g=1 THEN r END) AS n1, avg(CASE WHEN g=0 THEN r END) AS m0, avg(CASE WHEN g=1 THEN r END) AS m1, var_samp(CASE WHEN g=0 THEN r END) AS v0, var_samp(CASE WHEN g=1 THEN r END) AS v1 FROM (SELECT symbol, r, {GRP} AS g FROM sig) GROUP BY 1)
    SELECT symbol, n0, n1, round((m1-m0)/sqrt(((n0-1)*v0+(n1-1)*v1)/(n0+n1-2)*(1.0::DOUBLE/n0+1.0::DOUBLE/n1)),6) AS t, round((m1-m0)/sqrt(v0/n0+v1/n1),6) AS welch_t, round(pow(v0/n0+v1/n1,2)/(pow(v0/n0,2)/(n0-1)+pow(v1/n1,2)/(n1-1)),4) AS welch_df, round(v1/v0,6) AS f_ratio FROM a""",
)
def two_sample_tests(spark, sf):
    t = N.two_sample(signal_frame(spark, sf), ["symbol"], "r", group())
    return t.select("symbol", "n0", "n1", F.round("t", 6).alias("t"), F.round("welch_t", 6).alias("welch_t"), F.round("welch_df", 4).alias("welch_df"), F.round("f_ratio", 6).alias("f_ratio"))


@query(
    "I17 I18 I19 Levene, Kolmogorov-Smirnov and Mann-Whitney statistics",
    SIGX + f""" g AS (SELECT symbol, r, {GRP} AS g FROM sig WHERE r IS NOT NULL), md AS (SELECT symbol, g, median(r) AS m FROM g GROUP BY 1,2), d AS (SELECT g.symbol, g.g, abs(r-m) AS d FROM g JOIN md ON md.symbol=g.symbol AND md.g=g.g),
    pe AS (SELECT symbol, g, count(*) AS k, avg(d) AS mu, var_pop(d) AS vp FROM d GROUP BY 1,2), lv AS (SELECT symbol, (sum(k)-2)*(sum(k*mu*mu)-sum(k*mu)*sum(k*mu)/sum(k))/sum(k*vp) AS w FROM pe GROUP BY 1),
    ks AS (SELECT symbol, max(abs(a/na-b/nb)) AS ks FROM (SELECT symbol, sum(1-g) OVER w AS a, sum(g) OVER w AS b, sum(1-g) OVER p AS na, sum(g) OVER p AS nb FROM g WINDOW w AS (PARTITION BY symbol ORDER BY r), p AS (PARTITION BY symbol)) GROUP BY 1),
    rk AS (SELECT symbol, g, rank() OVER (PARTITION BY symbol ORDER BY r)+(count(*) OVER (PARTITION BY symbol,r)-1)/2.0::DOUBLE AS rk FROM g), mw AS (SELECT symbol, sum(CASE WHEN g=1 THEN rk END)-sum(g)*(sum(g)+1)/2.0::DOUBLE AS u FROM rk GROUP BY 1)
    SELECT lv.symbol, round(w,6) AS levene, round(ks,6) AS ks, CAST(u AS DOUBLE) AS u FROM lv JOIN ks USING (symbol) JOIN mw USING (symbol)""",
)
def distribution_tests(spark, sf):
    s = signal_frame(spark, sf)
    a, b, c = N.levene(s, ["symbol"], "r", group()), N.kolmogorov_smirnov(s, ["symbol"], "r", group()), N.mann_whitney(s, ["symbol"], "r", group())
    x = a.join(b, "symbol").join(c, "symbol")
    return x.select("symbol", F.round("levene", 6).alias("levene"), F.round("ks", 6).alias("ks"), "u")


@query("I16 I17 I18 I19 p-values of the tests")
def two_sample_p_values(spark, sf):
    s = signal_frame(spark, sf)
    t = N.two_sample(s, ["symbol"], "r", group())
    x = t.join(N.levene(s, ["symbol"], "r", group()), "symbol").join(N.kolmogorov_smirnov(s, ["symbol"], "r", group()).select("symbol", "ks"), "symbol")
    x = x.join(N.mann_whitney(s, ["symbol"], "r", group()), "symbol")
    return x.select(
        "symbol", F.round(N.t_p_value("t", "df"), 6).alias("p_t"), F.round(N.t_p_value("welch_t", "welch_df"), 6).alias("p_welch"),
        F.round(N.f_p_value("levene", F.lit(1.0), (F.col("n") - 2).cast("double")), 6).alias("p_levene"),
        F.round(N.ks_p_value(F.col("ks"), F.col("n0"), F.col("n1")), 6).alias("p_ks"), F.round(N.normal_p_value("score"), 6).alias("p_mw"),
    )


@query(
    "I20 sliding break-point scan at every split: strongest five and the rank of a given date",
    SIGX + """ c AS (SELECT symbol, ts, pos, r, count(*) OVER w AS k, avg(r) OVER w AS m0, var_pop(r) OVER w AS v0, count(*) OVER x AS n1, avg(r) OVER x AS m1, var_pop(r) OVER x AS v1 FROM sig WHERE r IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    t AS (SELECT symbol, ts, round((m1-m0)/sqrt((k*v0+n1*v1)/(k+n1-2)*(1.0::DOUBLE/k+1.0::DOUBLE/n1)),6) AS t FROM c WHERE k>=252 AND n1>=252)
    SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, t, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(t) DESC, ts) AS rn FROM t) WHERE rn<=5 OR ts=DATE '1999-01-04'""",
)
def break_point_scan(spark, sf):
    t = N.break_scan(signal_frame(spark, sf), ["symbol"], "r", 252).withColumn("t", F.round("t", 6))
    t = t.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(F.abs("t")), "ts")))
    return t.where("rn <= 5 or ts = date'1999-01-04'").select("symbol", day().alias("ts"), "t", "rn")


SPLITS_SQL = SIGX + """ n AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY pos)-1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM sig WHERE r IS NOT NULL),
    sp AS (SELECT DISTINCT symbol, n, k FROM (SELECT symbol, n, unnest(range(0, n, 200)) AS k FROM (SELECT DISTINCT symbol, n FROM n)) WHERE k>=252 AND n-k>=252),
    g AS (SELECT n.symbol, k, r, CAST(p>=k AS INT) AS g FROM n JOIN sp ON sp.symbol=n.symbol),
    ks AS (SELECT symbol, k, max(abs(a/na-b/nb)) AS ks FROM (SELECT symbol, k, sum(1-g) OVER w AS a, sum(g) OVER w AS b, sum(1-g) OVER p AS na, sum(g) OVER p AS nb FROM g WINDOW w AS (PARTITION BY symbol,k ORDER BY r), p AS (PARTITION BY symbol,k)) GROUP BY 1,2),
    md AS (SELECT symbol, k, g, median(r) AS m FROM g GROUP BY 1,2,3), dv AS (SELECT g.symbol, g.k, g.g, abs(r-m) AS d FROM g JOIN md ON md.symbol=g.symbol AND md.k=g.k AND md.g=g.g),
    pe AS (SELECT symbol, k, g, count(*) AS c, avg(d) AS mu, var_pop(d) AS vp FROM dv GROUP BY 1,2,3), lv AS (SELECT symbol, k, (sum(c)-2)*(sum(c*mu*mu)-sum(c*mu)*sum(c*mu)/sum(c))/sum(c*vp) AS w FROM pe GROUP BY 1,2)
    SELECT ks.symbol, ks.k AS split, round(w,6) AS levene, round(ks,6) AS ks FROM ks JOIN lv ON lv.symbol=ks.symbol AND lv.k=ks.k"""


def splits(spark, sf, every):
    s = signal_frame(spark, sf).where("r is not null")
    t = N.per_replicate(s, ["symbol"], {"x": F.col("r")}, None, N.split_tests(252, every), ["split", "levene", "ks"])
    return t.where("split is not null and not isnan(split)").select("symbol", F.col("split").cast("long").alias("split"), F.round("levene", 6).alias("levene"), F.round("ks", 6).alias("ks"))


@query("I20 Levene and Kolmogorov-Smirnov at every 200th split", SPLITS_SQL)
def split_statistics(spark, sf):
    return splits(spark, sf, 200)


@query("I20 strongest Levene and Kolmogorov-Smirnov split over all splits")
def strongest_splits(spark, sf):
    t = splits(spark, sf, 1)
    best = lambda c: F.max_by("split", F.struct(c, -F.col("split")))
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("splits"), best("levene").alias("levene_split"), F.max("levene").alias("levene"), best("ks").alias("ks_split"), F.max("ks").alias("ks"))


BREAKS = ["1997-01-01", "1998-01-01", "1999-01-01", "2000-01-01"]


@query(
    "I21 A17 list of candidate breaks tested with Levene, KS and variance ratio",
    SIGX + " br(bd) AS (VALUES " + ",".join(f"(DATE '{d}')" for d in BREAKS) + """), g AS (SELECT symbol, bd, r, CAST(ts>=bd AS INT) AS g FROM sig JOIN br ON TRUE WHERE r IS NOT NULL), vr AS (SELECT symbol, bd, var_samp(CASE WHEN g=1 THEN r END)/var_samp(CASE WHEN g=0 THEN r END) AS f FROM g GROUP BY 1,2),
    ks AS (SELECT symbol, bd, max(abs(a/na-b/nb)) AS ks FROM (SELECT symbol, bd, sum(1-g) OVER w AS a, sum(g) OVER w AS b, sum(1-g) OVER p AS na, sum(g) OVER p AS nb FROM g WINDOW w AS (PARTITION BY symbol,bd ORDER BY r), p AS (PARTITION BY symbol,bd)) GROUP BY 1,2),
    md AS (SELECT symbol, bd, g, median(r) AS m FROM g GROUP BY 1,2,3), dv AS (SELECT g.symbol, g.bd, g.g, abs(r-m) AS d FROM g JOIN md ON md.symbol=g.symbol AND md.bd=g.bd AND md.g=g.g),
    pe AS (SELECT symbol, bd, g, count(*) AS k, avg(d) AS mu, var_pop(d) AS vp FROM dv GROUP BY 1,2,3), lv AS (SELECT symbol, bd, (sum(k)-2)*(sum(k*mu*mu)-sum(k*mu)*sum(k*mu)/sum(k))/sum(k*vp) AS w FROM pe GROUP BY 1,2)
    SELECT vr.symbol, strftime(vr.bd,'%Y-%m-%d') AS break_date, round(f,6) AS f_ratio, round(w,6) AS levene, round(ks,6) AS ks FROM vr JOIN ks ON ks.symbol=vr.symbol AND ks.bd=vr.bd JOIN lv ON lv.symbol=vr.symbol AND lv.bd=vr.bd""",
)
def candidate_breaks(spark, sf):
    s = signal_frame(spark, sf).withColumn("bd", F.explode(F.array(*[F.to_date(F.lit(d)) for d in BREAKS])))
    g = (F.col("ts") >= F.col("bd")).cast("int")
    by = ["symbol", "bd"]
    x = N.two_sample(s, by, "r", g).join(N.kolmogorov_smirnov(s, by, "r", g).select(*by, "ks"), by).join(N.levene(s, by, "r", g).select(*by, "levene"), by)
    return x.select("symbol", day("bd").alias("break_date"), F.round("f_ratio", 6).alias("f_ratio"), F.round("levene", 6).alias("levene"), F.round("ks", 6).alias("ks"))


@query(
    "I22 cool-off and execution-lag sensitivity of the episode study",
    SIGX + " " + " , ".join(COOL.format(g=g).replace("g0 AS", f"g0_{g} AS").replace("g1 AS", f"g1_{g} AS").replace("g2 AS", f"g2_{g} AS").replace("ep AS", f"ep_{g} AS").replace("FROM g0)", f"FROM g0_{g})").replace("FROM g1)", f"FROM g1_{g})").replace("FROM g2 ", f"FROM g2_{g} ") for g in (20, 40, 60, 90, 120))
    + ", al AS (" + " UNION ALL ".join(f"SELECT {g} AS gap, symbol, pos FROM ep_{g}" for g in (20, 40, 60, 90, 120)) + """), fw AS (SELECT symbol, pos, lead(close,21) OVER (PARTITION BY symbol ORDER BY pos)/close-1 AS f FROM sig)
    SELECT CAST(gap AS INT) AS gap_days, CAST(lag AS INT) AS lag_rows, count(f) AS n, round(avg(f),6) AS mean_fwd FROM al JOIN (VALUES (0),(1),(2)) l(lag) ON TRUE JOIN fw ON fw.symbol=al.symbol AND fw.pos=al.pos+lag GROUP BY 1,2""",
)
def episode_sensitivity(spark, sf):
    s = signal_frame(spark, sf)
    fwd = W.forward_return("close", 21)
    s = s.withColumn("f0", fwd)
    s = s.withColumn("f1", F.lead("f0", 1).over(W.over())).withColumn("f2", F.lead("f0", 2).over(W.over()))
    gaps = F.array(*[F.lit(g) for g in (20, 40, 60, 90, 120)])
    # episode starts once, then every cool-off as a row: the gap is only a filter on last_off
    e = cooled_episodes(s, F.col("z") > 1.0, 0).withColumn("gap_days", F.explode(gaps))
    e = e.where("last_off is null or datediff(ts, last_off) >= gap_days")
    lagged = F.array(*[F.struct(F.lit(i).alias("lag_rows"), F.col(f"f{i}").alias("f")) for i in range(3)])
    x = e.select("gap_days", F.explode(lagged).alias("v")).select("gap_days", "v.*")
    return x.groupBy("gap_days", "lag_rows").agg(F.count("f").alias("n"), F.round(F.avg("f"), 6).alias("mean_fwd"))
