"""Walk-forward, scoring, threshold selection and MLlib leaderboards."""

from __future__ import annotations

from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import stats as S
from tidemark.operators import linear
from tidemark.operators import machines as M
from tidemark.operators import models as ML
from tidemark.operators import windows as W
from tidemark.operators.lasso import lasso
from tidemark.operators.nearest import nearest_join
from tidemark.operators.signals import shared, signal_frame
from tidemark.plans import base_sql as B
from tidemark.plans.base_queries import day
from tidemark.plans.feature_queries import WFEAT, weekly_features
from tidemark.plans.machine_queries import HOLD
from tidemark.plans.registry import query

SIG = B.with_(*B.signal_frame())
SIGX = SIG.rstrip() + ","
RSIGX = SIGX.replace("WITH ", "WITH RECURSIVE ", 1)
r6 = lambda c, n=None: F.round(c, 6).alias(n or c)
XS = ["z", "vz", "mom4", "mom13", "rv20", "vs_sma40"]


def weekly_frame(spark, sf):
    """Weekly features with the four-week-ahead return, rows numbered per symbol."""

    def build():
        f = weekly_features(spark, sf).withColumn("fwd", W.forward_return("close", 4)).where("z is not null and mom13 is not null")
        return f.withColumn("pos", F.row_number().over(W.over()))

    return shared(spark, "weekly-frame", sf, build)


WF = SIGX + WFEAT + """, fr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM (SELECT *, lead(close,4) OVER (PARTITION BY symbol ORDER BY ts)/close-1 AS fwd FROM wf) WHERE z IS NOT NULL AND mom13 IS NOT NULL)"""
WALK = """, mo AS (SELECT symbol, pos, z AS x1, mom13 AS x2, fwd AS y FROM fr WHERE fwd IS NOT NULL), ru AS (SELECT symbol, pos, covar_pop(x1,y) OVER w AS c1y, covar_pop(x2,y) OVER w AS c2y, covar_pop(x1,x2) OVER w AS c12, var_pop(x1) OVER w AS v1, var_pop(x2) OVER w AS v2, avg(y) OVER w AS ay, avg(x1) OVER w AS a1, avg(x2) OVER w AS a2 FROM mo WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
 be AS (SELECT symbol, (pos-100)//26 AS fold, (c1y*v2-c2y*c12)/(v1*v2-c12*c12) AS b1, (c2y*v1-c1y*c12)/(v1*v2-c12*c12) AS b2, ay, a1, a2 FROM ru WHERE pos>=100 AND (pos-100)%26=0),
 pr AS (SELECT t.symbol, t.ts, t.pos, t.fwd, ay+b1*(z-a1)+b2*(mom13-a2) AS pred FROM fr t JOIN be ON be.symbol=t.symbol AND be.fold=(t.pos-1-5-100)//26 WHERE t.pos>105 AND t.fwd IS NOT NULL)"""


def walk(spark, sf, xs):
    f = weekly_frame(spark, sf).where("fwd is not null")
    return ML.expanding_ols(f, xs, "fwd", 100, 26, 5)


@query("M2 J21 expanding walk-forward with embargo, refit every 26 weeks", WF + WALK + " SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, round(pred,7) AS pred FROM pr")
def walk_forward_predictions(spark, sf):
    return walk(spark, sf, ["z", "mom13"]).select("symbol", day().alias("ts"), F.round("pred", 7).alias("pred"))


@query(
    "M18 A20 out-of-sample R2, error, correlation and direction of the walk-forward",
    WF + WALK + " SELECT symbol, count(*) AS n, round(1-sum(pow(fwd-pred,2))/(var_pop(fwd)*count(*)),5) AS r2, round(avg(abs(fwd-pred)),6) AS mae, round(corr(fwd,pred),6) AS corr, round(avg(CAST((fwd>0)=(pred>0) AS INT)),6) AS direction FROM pr GROUP BY 1",
)
def walk_forward_quality(spark, sf):
    p = walk(spark, sf, ["z", "mom13"])
    err = F.col("fwd") - F.col("pred")
    return p.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.round(1 - F.sum(err * err) / (F.var_pop("fwd") * F.count(F.lit(1))), 5).alias("r2"), r6(F.avg(F.abs(err)), "mae"),
        r6(F.corr("fwd", "pred"), "corr"), r6(S.share((F.col("fwd") > 0) == (F.col("pred") > 0)), "direction"),
    )


@query(
    "M17 economic value of predictions: forward return when flagged and when safe",
    WF + WALK + " SELECT symbol, count(CASE WHEN pred<0 THEN 1 END) AS flagged, round(avg(CASE WHEN pred<0 THEN fwd END),6) AS when_flagged, round(avg(CASE WHEN pred>=0 THEN fwd END),6) AS when_safe, round(avg(CASE WHEN pred>=0 THEN fwd END)-avg(CASE WHEN pred<0 THEN fwd END),6) AS separation FROM pr GROUP BY 1",
)
def prediction_value(spark, sf):
    p = walk(spark, sf, ["z", "mom13"])
    bad, good = F.avg(F.when(F.col("pred") < 0, F.col("fwd"))), F.avg(F.when(F.col("pred") >= 0, F.col("fwd")))
    return p.groupBy("symbol").agg(F.count_if(F.col("pred") < 0).alias("flagged"), r6(bad, "when_flagged"), r6(good, "when_safe"), r6(good - bad, "separation"))


FEATURE_SETS = {"stress": ("z", "vz"), "momentum": ("mom4", "mom13"), "mixed": ("z", "mom13")}


def set_sql(name, x1, x2):
    src = "(SELECT symbol, ts, fwd, z, vz, mom4, mom13, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM fr WHERE fwd IS NOT NULL AND vz IS NOT NULL)"
    w = WALK.replace("z AS x1, mom13 AS x2", f"{x1} AS x1, {x2} AS x2").replace("FROM fr", f"FROM {src} fr").replace("fr t JOIN", "t JOIN").replace("b1*(z-a1)+b2*(mom13-a2)", f"b1*({x1}-a1)+b2*({x2}-a2)")
    for cte in ("mo", "ru", "be", "pr"):
        w = w.replace(f"{cte} AS (", f"{cte}_{name} AS (").replace(f"FROM {cte} ", f"FROM {cte}_{name} ").replace(f"JOIN {cte} ON", f"JOIN {cte}_{name} be ON")
    return w.replace(f"FROM {src} t JOIN", f"FROM {src} t JOIN")


@query(
    "M13 walk-forward with three feature sets",
    WF + "".join(set_sql(n, *xs) for n, xs in FEATURE_SETS.items()) + " UNION ALL ".join(f" SELECT '{n}' AS features, count(*) AS n, round(corr(fwd,pred),6) AS corr, round(avg(CAST((fwd>0)=(pred>0) AS INT)),6) AS direction FROM pr_{n}" for n in FEATURE_SETS),
)
def feature_set_comparison(spark, sf):
    f = weekly_frame(spark, sf).where("fwd is not null and vz is not null").withColumn("pos", F.row_number().over(W.over()))
    out = None
    for name, xs in FEATURE_SETS.items():
        p = ML.expanding_ols(f, list(xs), "fwd", 100, 26, 5).select(F.lit(name).alias("features"), "fwd", "pred")
        out = p if out is None else out.unionByName(p)
    return out.groupBy("features").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("fwd", "pred"), "corr"), r6(S.share((F.col("fwd") > 0) == (F.col("pred") > 0)), "direction"))


@query(
    "M1 standardisation with training statistics only",
    WF + ", t AS (SELECT symbol, avg(z) AS m, stddev_pop(z) AS s, avg(mom13) AS m2, stddev_pop(mom13) AS s2 FROM fr WHERE ts<DATE '1999-01-01' GROUP BY 1) SELECT fr.symbol, strftime(ts,'%Y-%m-%d') AS ts, round((z-m)/s,6) AS z_std, round((mom13-m2)/s2,6) AS mom13_std FROM fr JOIN t USING (symbol) WHERE ts>=DATE '1999-01-01'",
)
def train_standardised(spark, sf):
    f = ML.standardise_by_train(weekly_frame(spark, sf), ["z", "mom13"], F.col("ts") < F.to_date(F.lit("1999-01-01")))
    return f.where("ts >= date'1999-01-01'").select("symbol", day().alias("ts"), r6("z_std"), r6("mom13_std"))


LBL = ", lb AS (SELECT symbol, ts, pos, z, mom13, CAST(fwd>0 AS INT) AS y, ts<DATE '1999-01-01' AS tr FROM fr WHERE fwd IS NOT NULL)"


def labelled(spark, sf):
    f = weekly_frame(spark, sf).where("fwd is not null").withColumn("y", (F.col("fwd") > 0).cast("int"))
    return f, F.col("ts") < F.to_date(F.lit("1999-01-01"))


@query(
    "M9 Gaussian naive Bayes from per-class moments",
    WF + LBL + """, g AS (SELECT symbol, y, count(*) AS n, avg(z) AS m1, var_pop(z) AS v1, avg(mom13) AS m2, var_pop(mom13) AS v2 FROM lb WHERE tr GROUP BY 1,2), s AS (SELECT lb.symbol, lb.ts, g.y, ln(n)-ln(v1)/2-pow(z-m1,2)/(2*v1)-ln(v2)/2-pow(mom13-m2,2)/(2*v2) AS l FROM lb JOIN g ON g.symbol=lb.symbol WHERE NOT tr)
    SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, round(sum(CASE WHEN y=1 THEN l ELSE -l END),5) AS log_odds FROM s GROUP BY 1,2""",
)
def naive_bayes(spark, sf):
    f, train = labelled(spark, sf)
    return ML.gaussian_bayes(f, ["z", "mom13"], "y", train).where(~train).select("symbol", day().alias("ts"), F.round("log_odds", 5).alias("log_odds"))


@query(
    "M9 linear and quadratic discriminant analysis",
    WF + LBL + """, g AS (SELECT symbol, """ + ", ".join(f"CAST(count(CASE WHEN y={v} THEN 1 END) AS DOUBLE) AS n{v}, avg(CASE WHEN y={v} THEN z END) AS a{v}, avg(CASE WHEN y={v} THEN mom13 END) AS b{v}, var_pop(CASE WHEN y={v} THEN z END) AS p{v}, var_pop(CASE WHEN y={v} THEN mom13 END) AS q{v}, covar_pop(CASE WHEN y={v} THEN z END, CASE WHEN y={v} THEN mom13 END) AS c{v}" for v in (0, 1)) + """ FROM lb WHERE tr GROUP BY 1),
    h AS (SELECT *, (n0*p0+n1*p1)/(n0+n1) AS p, (n0*q0+n1*q1)/(n0+n1) AS q, (n0*c0+n1*c1)/(n0+n1) AS c FROM g), s AS (SELECT lb.symbol, lb.ts, """ + ", ".join(f"ln(n{v})-ln(p*q-c*c)/2-(q*pow(z-a{v},2)-2*c*(z-a{v})*(mom13-b{v})+p*pow(mom13-b{v},2))/(2*(p*q-c*c)) AS l{v}, ln(n{v})-ln(p{v}*q{v}-c{v}*c{v})/2-(q{v}*pow(z-a{v},2)-2*c{v}*(z-a{v})*(mom13-b{v})+p{v}*pow(mom13-b{v},2))/(2*(p{v}*q{v}-c{v}*c{v})) AS k{v}" for v in (0, 1)) + """ FROM lb JOIN h USING (symbol) WHERE NOT tr)
    SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, round(l1-l0,5) AS lda, round(k1-k0,5) AS qda FROM s""",
)
def discriminant_analysis(spark, sf):
    f, train = labelled(spark, sf)
    d = ML.discriminant(f, "z", "mom13", "y", train, pooled=True).withColumnRenamed("log_odds", "lda")
    d = ML.discriminant(d, "z", "mom13", "y", train, pooled=False).where(~train)
    return d.select("symbol", day().alias("ts"), F.round("lda", 5).alias("lda"), F.round("log_odds", 5).alias("qda"))


@query(
    "M10 exact k-nearest-neighbour vote on one feature",
    WF + LBL + ", n AS (SELECT t.symbol, t.pos, r.y, row_number() OVER (PARTITION BY t.symbol, t.pos ORDER BY abs(r.z-t.z), r.pos) AS rn FROM lb t JOIN lb r ON r.symbol=t.symbol AND r.tr WHERE NOT t.tr) SELECT symbol, pos, round(avg(y),6) AS vote FROM n WHERE rn<=10 GROUP BY 1,2",
)
def nearest_neighbours(spark, sf):
    f, train = labelled(spark, sf)
    v = ML.nearest_vote(f, "z", "y", train, 10)
    return v.select("symbol", F.col("pos").cast("long"), r6("vote"))


def logistic_sql(src: str, x1: str, x2: str, y: str, first: int, step: int, embargo: int, rounds: int = 14) -> str:
    """CTEs up to lp(symbol, ts, pos, fold, p): Newton for every fold, a 3 by 3 system each time. Must stand behind WITH RECURSIVE."""
    sums = "sum(p*(1-p)) AS a, sum(p*(1-p)*u) AS b, sum(p*(1-p)*v) AS c, sum(p*(1-p)*u*u)+1 AS d, sum(p*(1-p)*u*v) AS e, sum(p*(1-p)*v*v)+1 AS f, sum(p-y) AS g0, sum((p-y)*u)+any_value(w1) AS g1, sum((p-y)*v)+any_value(w2) AS g2"
    det = "(a*(d*f-e*e)-b*(b*f-c*e)+c*(b*e-c*d))"
    return f"""lx AS MATERIALIZED (SELECT symbol, ts, pos, {x1} AS x1, {x2} AS x2, CAST({y} AS DOUBLE) AS y, count(*) OVER (PARTITION BY symbol) AS n FROM {src}),
 lf AS (SELECT symbol, unnest(generate_series(0, CAST((any_value(n)-1-{embargo}-{first})//{step} AS BIGINT))) AS fold FROM lx GROUP BY symbol HAVING any_value(n)>{first + embargo}),
 ls AS (SELECT lf.symbol, fold, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM lf JOIN lx ON lx.symbol=lf.symbol AND pos<={first}+fold*{step} GROUP BY 1,2),
 lt AS MATERIALIZED (SELECT ls.symbol, fold, (x1-m1)/s1 AS u, (x2-m2)/s2 AS v, y FROM ls JOIN lx ON lx.symbol=ls.symbol AND pos<={first}+fold*{step}),
 nw(symbol, fold, it, w0, w1, w2) AS (SELECT symbol, fold, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM ls UNION ALL
  SELECT symbol, fold, it+1, w0-(g0*(d*f-e*e)-b*(g1*f-g2*e)+c*(g1*e-g2*d))/{det}, w1-(a*(g1*f-g2*e)-g0*(b*f-c*e)+c*(b*g2-c*g1))/{det}, w2-(a*(d*g2-e*g1)-b*(b*g2-c*g1)+g0*(b*e-c*d))/{det} FROM
  (SELECT symbol, fold, any_value(it) AS it, any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, {sums} FROM (SELECT nw.*, u, v, y, 1/(1+exp(-(w0+w1*u+w2*v))) AS p FROM nw JOIN lt ON lt.symbol=nw.symbol AND lt.fold=nw.fold WHERE it<{rounds}) GROUP BY symbol, fold)),
 lp AS (SELECT lx.symbol, lx.ts, lx.pos, nw.fold, lx.y, 1/(1+exp(-(w0+w1*(x1-m1)/s1+w2*(x2-m2)/s2))) AS p FROM lx JOIN nw ON nw.symbol=lx.symbol AND it={rounds} AND nw.fold=(lx.pos-1-{embargo}-{first})//{step} AND lx.pos>{first + embargo} JOIN ls ON ls.symbol=nw.symbol AND ls.fold=nw.fold)"""


RWF = WF.replace("WITH ", "WITH RECURSIVE ", 1)
LABELLED_WEEKS = "(SELECT symbol, ts, z, mom13, fwd, CAST(fwd>0 AS INT) AS up, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM fr WHERE fwd IS NOT NULL)"


@query(
    "M2 M6 M1 logistic classifier refitted on an expanding weekly walk-forward: 156 weeks, every 26, embargo 5",
    RWF + ", " + logistic_sql(LABELLED_WEEKS, "z", "mom13", "up", 156, 26, 5) + " SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, fold, round(p,6) AS p FROM lp",
)
def weekly_classifier(spark, sf):
    f = weekly_frame(spark, sf).where("fwd is not null").withColumn("up", (F.col("fwd") > 0).cast("int")).withColumn("pos", F.row_number().over(W.over()))
    return ML.walk_forward_logistic(f, ["z", "mom13"], "up", 156, 26, 5).select("symbol", day().alias("ts"), "fold", r6("p"))


MONTHS = """, mt AS (SELECT symbol, last_day(ts) AS ts, arg_max(close,ts) AS c, arg_max(z,ts) FILTER (z IS NOT NULL) AS z FROM sig GROUP BY 1,2), mu AS (SELECT symbol, ts, z, round(c/lag(c,3) OVER w-1,6) AS mom3, lead(c,1) OVER w/c-1 AS fwd FROM mt WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 mr AS (SELECT *, CAST(fwd>0 AS INT) AS up, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM mu WHERE z IS NOT NULL AND mom3 IS NOT NULL AND fwd IS NOT NULL)"""


def monthly_classified(spark, sf):
    """Month-end signals with the next month's direction."""
    s = signal_frame(spark, sf)
    m = s.groupBy("symbol", F.last_day("ts").alias("m")).agg(F.max_by("close", "ts").alias("c"), F.max_by("z", F.when(F.col("z").isNotNull(), F.col("ts"))).alias("z")).withColumnRenamed("m", "ts")
    m = m.withColumn("mom3", F.round(W.pct_change("c", 3), 6)).withColumn("fwd", W.forward_return("c", 1))
    m = m.where("z is not null and mom3 is not null and fwd is not null").withColumn("up", (F.col("fwd") > 0).cast("int"))
    return m.withColumn("pos", F.row_number().over(W.over()))


@query(
    "M2 M6 M19 logistic classifier on an expanding monthly walk-forward: 60 months, every 12, embargo of the horizon",
    RSIGX.rstrip().rstrip(",") + MONTHS + ", " + logistic_sql("mr", "z", "mom3", "up", 60, 12, 1) + " SELECT symbol, fold, count(*) AS n, round(avg(CAST((p>=0.5)=(y=1) AS INT)),6) AS accuracy, round(avg(pow(p-y,2)),6) AS brier, round(avg(p),6) AS mean_p FROM lp GROUP BY 1,2",
)
def monthly_classifier(spark, sf):
    p = ML.walk_forward_logistic(monthly_classified(spark, sf), ["z", "mom3"], "up", 60, 12, 1)
    hit = (F.col("p") >= 0.5) == (F.col("up") == 1)
    return p.groupBy("symbol", "fold").agg(F.count(F.lit(1)).alias("n"), r6(S.share(hit), "accuracy"), r6(F.avg((F.col("p") - F.col("up")) ** 2), "brier"), r6(F.avg("p"), "mean_p"))


#: Five years train a fold's model; the last of them validates the thresholds, on a model of the four before, which is the fold before
INNER = 4 * 252
CUTS = [round(0.30 + 0.04 * i, 2) for i in range(11)]
DAILY = """, dt AS (SELECT symbol, ts, z, r, round(close/lag(close,21) OVER w-1,6) AS m21, lead(close,5) OVER w/close-1 AS fwd FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 dl AS (SELECT *, CAST(fwd>0 AS INT) AS up, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM dt WHERE z IS NOT NULL AND m21 IS NOT NULL AND fwd IS NOT NULL)"""
SHARPE_SQL = "coalesce(avg(sr)/nullif(stddev_pop(sr),0)*sqrt(252),0)"


@query(
    "M12 M19 M2 thresholds chosen on the fold before, on probabilities fitted over 5 x 252 days and refitted every 252",
    RSIGX.rstrip().rstrip(",") + DAILY + ", " + logistic_sql("dl", "z", "m21", "up", INNER, 252, 0) + f""", th AS (SELECT unnest([{",".join(f"{c}::DOUBLE" for c in CUTS)}]) AS th),
 hs AS (SELECT symbol, ts, pos, fold, round(p,9) AS p FROM lp), sr AS MATERIALIZED (SELECT hs.symbol, fold, th, coalesce(dl.r,0)*lag(CAST(p>=th AS INT),1,0) OVER (PARTITION BY hs.symbol, th ORDER BY hs.pos) AS sr FROM hs JOIN dl ON dl.symbol=hs.symbol AND dl.pos=hs.pos JOIN th ON TRUE),
 sh AS (SELECT symbol, fold, th, count(*) AS n, round({SHARPE_SQL},8) AS s FROM sr GROUP BY 1,2,3), pk AS (SELECT symbol, fold+1 AS fold, arg_max(th, s*1000-th) AS th FROM sh GROUP BY 1,2), bs AS (SELECT symbol, fold, max(s) AS best FROM sh GROUP BY 1,2)
 SELECT sh.symbol, sh.fold, sh.n, pk.th AS threshold, round(s,5) AS nested, round(best,5) AS best_in_hindsight, round(best-s,5) AS bias FROM sh JOIN pk ON pk.symbol=sh.symbol AND pk.fold=sh.fold AND pk.th=sh.th JOIN bs ON bs.symbol=sh.symbol AND bs.fold=sh.fold""",
)
def nested_fitted_thresholds(spark, sf):
    d = signal_frame(spark, sf).withColumn("m21", F.round(W.pct_change("close", 21), 6)).withColumn("fwd", W.forward_return("close", 5))
    d = d.where("z is not null and m21 is not null and fwd is not null").withColumn("up", (F.col("fwd") > 0).cast("int")).withColumn("pos", F.row_number().over(W.over()))
    p = ML.walk_forward_logistic(d, ["z", "m21"], "up", INNER, 252, 0).withColumn("p", F.round("p", 9))
    v = p.withColumn("th", F.explode(F.array(*[F.lit(c) for c in CUTS])))
    held = F.coalesce(F.lag((F.col("p") >= F.col("th")).cast("int")).over(W.over(("symbol", "th"), ("pos",))), F.lit(0))
    sr = v.withColumn("sr", F.coalesce("r", F.lit(0.0)) * held)
    sh = sr.groupBy("symbol", "fold", "th").agg(F.count(F.lit(1)).alias("n"), F.round(S.sharpe("sr", population=True), 8).alias("s"))
    # folds are few rows a symbol: one window finds the fold's best and what the fold before would choose
    by = Window.partitionBy("symbol", "fold")
    sh = sh.withColumn("best", F.max("s").over(by)).withColumn("mine", F.max_by("th", F.col("s") * 1000 - F.col("th")).over(by))
    chosen = sh.select("symbol", (F.col("fold") + 1).alias("fold"), F.col("mine").alias("th")).distinct()
    x = sh.join(chosen, ["symbol", "fold", "th"])
    return x.select("symbol", "fold", "n", F.col("th").alias("threshold"), F.round("s", 5).alias("nested"), F.round("best", 5).alias("best_in_hindsight"), F.round(F.col("best") - F.col("s"), 5).alias("bias"))


LASSO_RATIOS, LASSO_SWEEPS = [0.9, 0.5, 0.2, 0.05], 400
_SOFT = lambda r, d: f"sign({r})*greatest(abs({r})-a,0)/({d})"
LASSO_SQL = f""", la AS MATERIALIZED (SELECT symbol, pos, x1, x2, x3, y, CASE WHEN i<n%5*(n//5+1) THEN i//(n//5+1) ELSE n%5+(i-n%5*(n//5+1))//(n//5) END AS b FROM (SELECT symbol, pos, round((z-avg(z) OVER w)/stddev_pop(z) OVER w,9) AS x1, round((mom4-avg(mom4) OVER w)/stddev_pop(mom4) OVER w,9) AS x2, round((mom13-avg(mom13) OVER w)/stddev_pop(mom13) OVER w,9) AS x3, fwd AS y, count(*) OVER w AS n, row_number() OVER (PARTITION BY symbol ORDER BY pos)-1 AS i FROM fr WHERE fwd IS NOT NULL AND mom4 IS NOT NULL WINDOW w AS (PARTITION BY symbol))),
 lm AS MATERIALIZED (SELECT la.symbol, t.f, count(*) AS n, avg(y) AS my, {", ".join(f"avg(x{i}) AS m{i}, var_pop(x{i}) AS g{i}{i}, covar_pop(x{i},y) AS t{i}" for i in (1, 2, 3))}, covar_pop(x1,x2) AS g12, covar_pop(x1,x3) AS g13, covar_pop(x2,x3) AS g23 FROM la JOIN (SELECT unnest([-1,0,1,2,3,4]) AS f) t ON la.b<>t.f GROUP BY 1,2),
 al AS (SELECT symbol, ratio, ratio*greatest(abs(t1),abs(t2),abs(t3)) AS a FROM lm, (SELECT unnest([{",".join(f"{r}::DOUBLE" for r in LASSO_RATIOS)}]) AS ratio) WHERE f=-1),
 cd(symbol, f, a, it, w1, w2, w3) AS (SELECT lm.symbol, f, a, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM lm JOIN al ON al.symbol=lm.symbol UNION ALL
  SELECT symbol, f, a, it+1, v1, v2, {_SOFT("(t3-g13*v1-g23*v2)", "g33")} FROM (SELECT *, {_SOFT("(t2-g12*v1-g23*w3)", "g22")} AS v2 FROM (SELECT cd.*, lm.* EXCLUDE (symbol, f), {_SOFT("(t1-g12*w2-g13*w3)", "g11")} AS v1 FROM cd JOIN lm ON lm.symbol=cd.symbol AND lm.f=cd.f WHERE it<{LASSO_SWEEPS}))),
 en AS (SELECT cd.*, my-w1*m1-w2*m2-w3*m3 AS c FROM cd JOIN lm ON lm.symbol=cd.symbol AND lm.f=cd.f WHERE it={LASSO_SWEEPS}),
 ce AS (SELECT symbol, a, avg(e) AS cv FROM (SELECT en.symbol, a, f, avg(pow(y-c-w1*x1-w2*x2-w3*x3,2)) AS e FROM en JOIN la ON la.symbol=en.symbol AND la.b=en.f GROUP BY 1,2,3) GROUP BY 1,2)"""


@query(
    "M6 M18 lasso path on co-moments with the penalty chosen by five contiguous cross-validation folds",
    RWF + LASSO_SQL + " SELECT en.symbol, round(en.a,9) AS alpha, round(cv,9) AS cv_error, round(cv,12)=min(round(cv,12)) OVER (PARTITION BY en.symbol) AS chosen, round(c,7) AS intercept, round(w1,7) AS beta_z, round(w2,7) AS beta_mom4, round(w3,7) AS beta_mom13 FROM en JOIN ce ON ce.symbol=en.symbol AND ce.a=en.a WHERE f=-1",
)
def lasso_path(spark, sf):
    xs, w = ["z", "mom4", "mom13"], Window.partitionBy("symbol")
    f = weekly_frame(spark, sf).where("fwd is not null and mom4 is not null")
    f = f.select("symbol", "pos", "fwd", *[F.round((F.col(x) - F.avg(x).over(w)) / F.stddev_pop(x).over(w), 9).alias(x) for x in xs])
    m = lasso(f, xs, "fwd", ["symbol"], LASSO_RATIOS)
    return m.select("symbol", F.round("alpha", 9).alias("alpha"), F.round("cv_error", 9).alias("cv_error"), "chosen", *[F.round(c, 7).alias(c) for c in ("intercept", "beta_z", "beta_mom4", "beta_mom13")])


KNN_XS, KNN_KS = ("z", "mom4", "mom13", "rv20"), (5, 10, 20)
KNN_SQL = LBL.replace("z, mom13,", "z, mom4, mom13, rv20,") + ", fl AS (SELECT * FROM lb WHERE z IS NOT NULL AND mom4 IS NOT NULL AND mom13 IS NOT NULL AND rv20 IS NOT NULL), ms AS (SELECT symbol, " + ", ".join(f"round(avg({x}),9) AS m_{x}, round(stddev_pop({x}),9) AS s_{x}" for x in KNN_XS) + " FROM fl WHERE tr GROUP BY 1), st AS (SELECT fl.symbol, ts, pos, y, tr, " + ", ".join(f"round(({x}-m_{x})/nullif(s_{x},0),7) AS {x}" for x in KNN_XS) + " FROM fl JOIN ms USING (symbol)), d AS (SELECT t.symbol, t.ts, t.pos, r.pos AS p, r.y, " + "+".join(f"(t.{x}-r.{x})*(t.{x}-r.{x})" for x in KNN_XS) + " AS d2 FROM st t JOIN st r ON r.symbol=t.symbol AND r.tr WHERE NOT t.tr), n AS (SELECT *, row_number() OVER (PARTITION BY symbol, pos ORDER BY d2, p) AS rank FROM d)"


@query(
    "M10 M1 exact k-nearest-neighbour votes of 5, 10 and 20 on four standardised features",
    WF + KNN_SQL + " SELECT symbol, strftime(any_value(ts),'%Y-%m-%d') AS ts, pos, " + ", ".join(f"round(avg(y) FILTER (rank<={k}),6) AS vote{k}" for k in KNN_KS) + ", round(max(sqrt(d2)) FILTER (rank<=20),6) AS reach FROM n GROUP BY symbol, pos",
)
def nearest_feature_votes(spark, sf):
    f, train = labelled(spark, sf)
    f = f.na.drop("any", subset=list(KNN_XS))
    m = f.where(train).groupBy("symbol").agg(*[F.round(g(x), 9).alias(f"{p}_{x}") for x in KNN_XS for p, g in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {x: F.round((F.col(x) - F.col(f"m_{x}")) / F.nullif(F.col(f"s_{x}"), F.lit(0.0)), 7) for x in KNN_XS}
    s = f.join(m, "symbol").select("symbol", "ts", F.col("pos").cast("long").alias("pos"), "y", *[e.alias(x) for x, e in scaled.items()])
    n = nearest_join(s.where(~train), s.where(train), list(KNN_XS), max(KNN_KS), ["symbol"], carry=("y",))
    votes = n.groupBy("symbol", "pos").agg(*[r6(F.avg(F.when(F.col("rank") <= k, F.col("y"))), f"vote{k}") for k in KNN_KS], r6(F.sqrt(F.max("d2")), "reach"))
    return votes.join(s.select("symbol", "pos", day().alias("ts")), ["symbol", "pos"])


PARAMS = [(e, x, h) for e in (0.6, 0.65, 0.7, 0.75) for x in (0.4, 0.45, 0.5) for h in (2, 4)]
H2 = HOLD.split("hs AS")[0].rstrip().rstrip(",")
NEST = """ pb AS MATERIALIZED (SELECT symbol, pos, ts, r, coalesce(round(1/(1+exp(-z)),6),0.5::DOUBLE) AS p FROM sig), pv(vid,en,ex,mh) AS (VALUES """ + ",".join(f"({i},{e}::DOUBLE,{x}::DOUBLE,{h})" for i, (e, x, h) in enumerate(PARAMS)) + """),
 cond AS MATERIALIZED (SELECT symbol||'-'||vid AS symbol, pos, p>en AS e, p<ex AS n, mh FROM pb JOIN pv ON TRUE),""" + H2.replace("{hold}", "mh").replace("c.e, c.n FROM", "c.e, c.n, c.mh FROM") + """,
 sr AS MATERIALIZED (SELECT substr(h.k,1,2) AS symbol, CAST(substr(h.k,4) AS INT) AS vid, b.ts, b.pos, CASE WHEN coalesce(lag(h.st) OVER (PARTITION BY h.k ORDER BY h.pos),1)=1 THEN coalesce(b.r,0) ELSE 0 END AS sr FROM hm h JOIN pb b ON b.symbol=substr(h.k,1,2) AND b.pos=h.pos),
 ys AS (SELECT symbol, vid, year(ts) AS yr, round(coalesce(avg(sr)/nullif(stddev_pop(sr),0)*sqrt(252),0),8) AS sh FROM sr GROUP BY 1,2,3), pk AS (SELECT symbol, yr+1 AS yr, vid FROM (SELECT *, row_number() OVER (PARTITION BY symbol, yr ORDER BY sh DESC, vid) AS rn FROM ys) WHERE rn=1),
 cond2 AS MATERIALIZED (SELECT pb.symbol, pb.pos, p>en AS e, p<ex AS n, mh FROM pb JOIN pk ON pk.symbol=pb.symbol AND pk.yr=year(pb.ts) JOIN pv ON pv.vid=pk.vid), lo AS (SELECT symbol, min(pos) AS lo FROM cond2 GROUP BY 1), cond3 AS MATERIALIZED (SELECT c.symbol, c.pos-lo+1 AS pos, e, n, mh FROM cond2 c JOIN lo USING (symbol)),""" + H2.replace("{hold}", "mh").replace("c.e, c.n FROM", "c.e, c.n, c.mh FROM").replace("hm(", "hn(").replace("FROM hm h", "FROM hn h").replace("cond", "cond3") + """,
 ns AS (SELECT h.k AS symbol, CASE WHEN coalesce(lag(h.st) OVER (PARTITION BY h.k ORDER BY h.pos),1)=1 THEN coalesce(b.r,0) ELSE 0 END AS sr FROM hn h JOIN lo ON lo.symbol=h.k JOIN pb b ON b.symbol=h.k AND b.pos=h.pos+lo.lo-1 WHERE h.pos>0),
 gl AS (SELECT symbol, max(sh) AS g FROM (SELECT symbol, vid, coalesce(avg(sr)/nullif(stddev_pop(sr),0)*sqrt(252),0) AS sh FROM sr JOIN lo USING (symbol) WHERE pos>=lo GROUP BY 1,2) GROUP BY 1)
 SELECT ns.symbol, count(*) AS n, round(coalesce(avg(sr)/nullif(stddev_pop(sr),0)*sqrt(252),0),5) AS nested, round(any_value(g),5) AS best_in_hindsight, round(any_value(g)-coalesce(avg(sr)/nullif(stddev_pop(sr),0)*sqrt(252),0),5) AS bias FROM ns JOIN gl USING (symbol) GROUP BY 1"""


@query("M12 M19 E7 A16 nested threshold selection on the previous year, and its selection-bias gap", RSIGX + NEST)
def nested_thresholds(spark, sf):
    s = signal_frame(spark, sf).withColumn("p", F.coalesce(F.round(1 / (1 + F.exp(-F.col("z"))), 6), F.lit(0.5))).select("symbol", "ts", "r", "p")
    params = F.array(*[F.struct(F.lit(i).alias("vid"), F.lit(e).alias("en"), F.lit(x).alias("ex"), F.lit(h).alias("mh")) for i, (e, x, h) in enumerate(PARAMS)])
    v = s.withColumn("v", F.explode(params)).select("symbol", "ts", "r", "p", "v.*")
    by = ("symbol", "vid")
    sw = M.hold_machine(v, F.col("p") > F.col("en"), F.col("p") < F.col("ex"), F.col("mh"), by=by)
    sr = shared(spark, "nested-variant-returns", sf, lambda: M.in_out_returns(M.with_state(v, sw, by=by), "state", by=by).select("symbol", "vid", "ts", "sr"))
    yearly = sr.groupBy("symbol", "vid", F.year("ts").alias("yr")).agg(F.round(S.sharpe("sr", population=True), 8).alias("sh"))
    pick = yearly.groupBy("symbol", (F.col("yr") + 1).alias("yr")).agg(F.max_by("vid", F.struct("sh", -F.col("vid"))).alias("vid"))
    chosen = s.withColumn("yr", F.year("ts")).join(pick, ["symbol", "yr"]).withColumn("v", F.element_at(params, F.col("vid") + 1)).select("symbol", "ts", "r", "p", "v.*")
    sw2 = M.hold_machine(chosen, F.col("p") > F.col("en"), F.col("p") < F.col("ex"), F.col("mh"))
    nested = M.in_out_returns(M.with_state(chosen, sw2), "state").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), S.sharpe("sr", population=True).alias("nested"), F.min("ts").alias("lo"))
    full = sr.join(nested.select("symbol", "lo"), "symbol").where("ts >= lo").groupBy("symbol", "vid").agg(S.sharpe("sr", population=True).alias("sh"))
    best = full.groupBy("symbol").agg(F.max("sh").alias("g"))
    x = nested.join(best, "symbol")
    return x.select("symbol", "n", F.round("nested", 5).alias("nested"), F.round("g", 5).alias("best_in_hindsight"), F.round(F.col("g") - F.col("nested"), 5).alias("bias"))


def classifiers(n_features: int) -> dict:
    """Model factory; tree settings follow the studied configuration."""
    logistic = C.LogisticRegression(labelCol="label", maxIter=20)
    grid = ParamGridBuilder().addGrid(logistic.regParam, [0.01, 0.1]).build()
    return {
        "gbt": C.GBTClassifier(labelCol="label", maxDepth=3, maxIter=20, stepSize=0.05, subsamplingRate=0.8, seed=42),
        "forest": C.RandomForestClassifier(labelCol="label", maxDepth=5, numTrees=30, seed=42),
        "tree": C.DecisionTreeClassifier(labelCol="label", maxDepth=4, seed=42),
        "logistic_cv": CrossValidator(estimator=logistic, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=3, parallelism=4, seed=42),
        "elastic_net": C.LogisticRegression(labelCol="label", regParam=0.05, elasticNetParam=0.5, maxIter=20),
        "ridge": C.LogisticRegression(labelCol="label", regParam=0.5, elasticNetParam=0.0, maxIter=20),
        "svm": C.LinearSVC(labelCol="label", maxIter=15),
        "mlp": C.MultilayerPerceptronClassifier(labelCol="label", layers=[n_features, 8, 2], maxIter=30, seed=42),
        "gaussian_nb": C.NaiveBayes(labelCol="label", modelType="gaussian"),
    }


def prepared(spark, sf):
    f = weekly_frame(spark, sf).where("fwd is not null").withColumn("label", (F.col("fwd") > 0).cast("double"))
    return ML.assemble(f, XS, F.col("ts") < F.to_date(F.lit("1999-06-01")))


@query("M3 M4 M5 M6 M7 M8 M11 X6 model leaderboard by MCC with the always-up baseline")
def model_leaderboard(spark, sf):
    train, test = prepared(spark, sf)
    return ML.leaderboard(train.persist(), test.persist(), classifiers(len(XS)))


@query("M3 M4 A24 M16 importances with and without a training block, averaged and normalised")
def importance_stability(spark, sf):
    train, _ = prepared(spark, sf)
    train = train.persist()
    out = None
    for part, rows in {"all": train, "without_1998": train.where("year(ts) <> 1998")}.items():
        for name, est in {"forest": R.RandomForestRegressor(labelCol="fwd", maxDepth=5, numTrees=30, seed=42), "gbt": R.GBTRegressor(labelCol="fwd", maxDepth=3, maxIter=15, stepSize=0.05, seed=42)}.items():
            imp = ML.importances(est.fit(rows), XS, train).withColumn("part", F.lit(part)).withColumn("model", F.lit(name))
            out = imp if out is None else out.unionByName(imp)
    a = out.groupBy("part", "feature").agg(F.avg("importance").alias("i"))
    share = F.col("i") / F.sum("i").over(Window.partitionBy("part"))
    a = a.withColumn("share", share).groupBy("feature").pivot("part", ["all", "without_1998"]).agg(F.first("share"))
    group = F.when(F.col("feature").isin("z", "vz"), "stress").otherwise("trend")
    return a.select("feature", group.alias("category"), r6("all", "share_all"), r6("without_1998", "share_dropped"), r6(F.abs(F.col("all") - F.col("without_1998")), "shift"))


@query(
    "M18 in-sample and out-of-sample regression with the in-sample betas",
    SIGX + """ f AS (SELECT symbol, ts<DATE '1999-01-01' AS ins, r AS y, gap AS x1, z AS x2 FROM sig WHERE r IS NOT NULL AND gap IS NOT NULL AND z IS NOT NULL), m AS (SELECT symbol, avg(y) AS ay, avg(x1) AS a1, avg(x2) AS a2, covar_pop(x1,y) AS c1y, covar_pop(x2,y) AS c2y, covar_pop(x1,x2) AS c12, var_pop(x1) AS v1, var_pop(x2) AS v2 FROM f WHERE ins GROUP BY 1),
    b AS (SELECT *, (c1y*v2-c2y*c12)/(v1*v2-c12*c12) AS b1, (c2y*v1-c1y*c12)/(v1*v2-c12*c12) AS b2 FROM m), p AS (SELECT f.symbol, ins, y, ay+b1*(x1-a1)+b2*(x2-a2) AS p FROM f JOIN b USING (symbol))
    SELECT symbol, CASE WHEN ins THEN 'in' ELSE 'out' END AS part, count(*) AS n, round(1-sum(pow(y-p,2))/(var_pop(y)*count(*)),6) AS r2, round(corr(y,p),6) AS corr, round(avg(CAST((y>0)=(p>0) AS INT)),6) AS direction FROM p GROUP BY 1,2""",
)
def regression_validation(spark, sf):
    f = signal_frame(spark, sf).na.drop("any", subset=["r", "gap", "z"]).withColumn("ins", F.col("ts") < F.to_date(F.lit("1999-01-01")))
    b = linear.ols(f.where("ins"), ["symbol"], ["gap", "z"], "r").select("symbol", "intercept", "beta_gap", "beta_z")
    p = f.join(b, "symbol").withColumn("p", F.col("intercept") + F.col("beta_gap") * F.col("gap") + F.col("beta_z") * F.col("z"))
    err = F.col("r") - F.col("p")
    return p.groupBy("symbol", F.when(F.col("ins"), "in").otherwise("out").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), r6(1 - F.sum(err * err) / (F.var_pop("r") * F.count(F.lit(1))), "r2"), r6(F.corr("r", "p"), "corr"), r6(S.share((F.col("r") > 0) == (F.col("p") > 0)), "direction")
    )
