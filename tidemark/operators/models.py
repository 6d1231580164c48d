"""Walk-forward fitting and scoring.

Linear and Gaussian models are fitted from (running) moments, so an expanding
walk-forward needs no copy of the training rows per fold. Tree, margin and
neural models are MLlib estimators taken from a factory dictionary.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats as S
from tidemark.functions.expr import nz
from tidemark.operators.linear import _betas, _moments
from tidemark.operators.windows import upto
from tidemark.session import fan_join


def fold_of(pos: Column, first: int, step: int, embargo: int) -> Column:
    """Fold whose test window ``(T + embargo, T + embargo + step]`` holds the row; NULL before the first."""
    k = F.floor((pos - 1 - embargo - first) / step)
    return F.when(pos > first + embargo, k)


def expanding_ols(df: DataFrame, xs: list[str], y: str, first: int, step: int, embargo: int, by=("symbol",), order=("pos",)) -> DataFrame:
    """Out-of-sample predictions of an OLS refitted every ``step`` rows on all rows up to T.

    ``pos`` must number the rows of each key from 1.
    """
    by = list(by)
    full = df.na.drop("any", subset=xs)
    known = F.col(y).isNotNull()
    fit = full.withColumns({f"__{n}": e.over(upto(by, order)) for n, e in _moments(xs, y).items()})
    fit = fit.withColumns({f"__{n}": F.sum(F.when(known, F.lit(1))).over(upto(by, order)) for n in ["n"]})
    fit = fit.where((F.col("pos") >= first) & ((F.col("pos") - first) % step == 0)).withColumn("fold", ((F.col("pos") - first) / step).cast("long"))
    betas = _betas(fit, xs, [*by, "fold"]).select(*by, "fold", "intercept", *[F.col(f"beta_{x}").alias(f"__b_{x}") for x in xs])
    test = full.withColumn("fold", fold_of(F.col("pos"), first, step, embargo)).where("fold is not null")
    p = test.join(betas, [*by, "fold"])
    return p.withColumn("pred", sum((F.col(f"__b_{x}") * F.col(x) for x in xs), F.col("intercept"))).drop("intercept", *[f"__b_{x}" for x in xs])


def fold_newton(first: int, step: int, embargo: int, l2: float, xs: int, rounds: int = 50):
    """Kernel of ``per_replicate``: logistic weights of expanding folds, all folds of a slice advanced by Newton together.

    Fold k trains on the first ``first + k * step`` rows; features are standardised by them, a penalty of l2 / 2
    holds the weights but not the intercept. Weights come back in the features' own units, intercept first. A
    feature that does not vary inside a fold has weight 0.
    """

    def kernel(x: dict, reps: np.ndarray) -> np.ndarray | None:
        names = [f"x{i}" for i in range(xs)]
        n = len(x["y"])
        reps = reps[first + reps * step + embargo < n]
        if not len(reps):
            return None
        raw, y = np.stack([x[c] for c in names], axis=1), x["y"]
        train = (np.arange(n)[None, :] < (first + reps * step)[:, None]).astype(float)
        size = train.sum(axis=1)[:, None]
        mean = train @ raw / size
        sd = np.sqrt(np.einsum("fn,fnj->fj", train, (raw[None] - mean[:, None]) ** 2) / size)
        safe = np.where(sd > 0, sd, 1.0)
        u = np.where(sd[:, None] > 0, (raw[None] - mean[:, None]) / safe[:, None], 0.0)
        u = np.concatenate([np.ones((*u.shape[:2], 1)), u], axis=2)
        hold = np.diag([0.0] + [l2] * xs)
        w = np.zeros((len(reps), xs + 1))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.einsum("fnj,fj->fn", u, w)))
            g = np.einsum("fn,fnj->fj", train * (p - y), u) + w @ hold
            h = np.einsum("fn,fni,fnj->fij", train * p * (1 - p), u, u) + hold + 1e-12 * np.eye(xs + 1)
            move = np.linalg.solve(h, g[:, :, None])[:, :, 0]
            # a step that would leave the range where Newton's model holds is cut
            w = w - move * np.minimum(1, 4 / np.maximum(np.abs(move).max(axis=1, keepdims=True), 1e-300))
            if np.abs(move).max() < 1e-10:
                break
        own = np.where(sd > 0, w[:, 1:] / safe, 0.0)
        return np.column_stack([reps, w[:, 0] - (own * mean).sum(axis=1), own])

    return kernel


def walk_forward_logistic(df: DataFrame, xs: list[str], label: str, first: int, step: int, embargo: int, l2: float = 1.0, by=("symbol",), order: str = "pos") -> DataFrame:
    """Test rows with their fold and the probability of the label, from a logistic fit of every expanding fold.

    ``order`` must number the complete, labelled rows of each key from 1; fold k trains on rows up to ``first + k * step`` and tests
    the ``step`` rows after the embargo. The training rows are not copied for folds: a series travels as arrays, once for
    each slice of folds.
    """
    from tidemark.operators.inference import per_replicate

    columns = {"y": F.col(label).cast("double"), **{f"x{i}": F.col(x) for i, x in enumerate(xs)}}
    names = ["fold", "w", *[f"w{i}" for i in range(len(xs))]]
    folds = per_replicate(df, list(by), columns, None, fold_newton(first, step, embargo, l2, len(xs)), names, order=order, slices=16)
    folds = folds.withColumn("fold", F.col("fold").cast("long")).drop("rep")
    test = df.withColumn("fold", fold_of(F.col(order), first, step, embargo)).where("fold is not null")
    score = sum((F.col(f"w{i}") * F.col(x) for i, x in enumerate(xs)), F.col("w"))
    return test.join(folds, [*by, "fold"]).withColumn("p", 1 / (1 + F.exp(-score))).drop(*names[1:])


def standardise_by_train(df: DataFrame, xs: list[str], train: Column, by=("symbol",)) -> DataFrame:
    """(x - mean) / population deviation, both from the training rows only."""
    w = Window.partitionBy(*by)
    stat = lambda f, x: f(F.when(train, F.col(x))).over(w)
    return df.withColumns({f"{x}_std": (F.col(x) - stat(F.avg, x)) / F.nullif(stat(F.stddev_pop, x), F.lit(0.0)) for x in xs})


def gaussian_bayes(df: DataFrame, xs: list[str], label: str, train: Column, by=("symbol",)) -> DataFrame:
    """Log-odds of a Gaussian naive Bayes from per-class means and variances."""
    by = list(by)
    side = lambda v: train & (F.col(label) == v)
    agg = [F.count_if(side(v)).alias(f"__n{v}") for v in (0, 1)]
    for x in xs:
        for v in (0, 1):
            agg += [F.avg(F.when(side(v), F.col(x))).alias(f"__m_{x}{v}"), F.var_pop(F.when(side(v), F.col(x))).alias(f"__v_{x}{v}")]
    g = df.groupBy(*by).agg(*agg)
    d = df.join(g, by)

    def loglik(v):
        t = F.log(F.col(f"__n{v}").cast("double"))
        for x in xs:
            m, var = F.col(f"__m_{x}{v}"), F.col(f"__v_{x}{v}")
            t = t - F.log(nz(var)) / 2 - (F.col(x) - m) * (F.col(x) - m) / nz(2 * var)
        return t

    return d.withColumn("log_odds", loglik(1) - loglik(0)).select(*df.columns, "log_odds")


def discriminant(df: DataFrame, x1: str, x2: str, label: str, train: Column, pooled: bool, by=("symbol",)) -> DataFrame:
    """Log-odds of linear (pooled covariance) or quadratic discriminant analysis on two features."""
    by = list(by)
    side = lambda v, c: F.when(train & (F.col(label) == v), F.col(c))
    agg = []
    for v in (0, 1):
        agg += [F.count(side(v, x1)).cast("double").alias(f"__n{v}"), F.avg(side(v, x1)).alias(f"__a{v}"), F.avg(side(v, x2)).alias(f"__b{v}")]
        agg += [F.var_pop(side(v, x1)).alias(f"__p{v}"), F.var_pop(side(v, x2)).alias(f"__q{v}"), F.covar_pop(side(v, x1), side(v, x2)).alias(f"__c{v}")]
    d = df.join(df.groupBy(*by).agg(*agg), by)
    n = F.col("__n0") + F.col("__n1")
    share = lambda s, v: (F.col("__n0") * F.col(f"__{s}0") + F.col("__n1") * F.col(f"__{s}1")) / nz(n) if pooled else F.col(f"__{s}{v}")

    def score(v):
        p, q, c = (share(s, v) for s in "pqc")
        det = p * q - c * c
        u, w = F.col(x1) - F.col(f"__a{v}"), F.col(x2) - F.col(f"__b{v}")
        return F.log(F.col(f"__n{v}")) - F.log(nz(det)) / 2 - (q * u * u - 2 * c * u * w + p * w * w) / nz(2 * det)

    return d.withColumn("log_odds", score(1) - score(0)).select(*df.columns, "log_odds")


def nearest_vote(df: DataFrame, x: str, label: str, train: Column, k: int, by=("symbol",)) -> DataFrame:
    """Exact k-nearest-neighbour share of positive labels for one feature, on test rows.

    In the order of the feature the k nearest training rows lie among the k
    before and the k after, so a bounded window replaces all test-train pairs.
    """
    w = Window.partitionBy(*by).orderBy(x, "__train", "pos")
    d = df.withColumn("__train", train)
    # training rows only advance the running index, so look-ups skip test rows
    d = d.withColumn("__i", F.count_if(F.col("__train")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pts = d.where("__train").select(*by, F.col("__i").alias("__j"), F.struct(F.col(x).alias("v"), F.col(label).cast("double").alias("y"), F.col("pos").alias("p")).alias("__pt"))
    q = d.where(~F.col("__train")).withColumn("__j", F.explode(F.sequence(F.col("__i") - k + 1, F.col("__i") + k)))
    c = fan_join(q, pts, [*by, "__j"])
    dist = F.abs(F.col("__pt.v") - F.col(x))
    near = F.slice(F.array_sort(F.collect_list(F.struct(dist.alias("d"), F.col("__pt.p").alias("p"), F.col("__pt.y").alias("y")))), 1, k)
    g = c.groupBy(*by, "pos").agg(near.alias("__near"))
    vote = F.aggregate("__near", F.lit(0.0), lambda s, e: s + e["y"]) / F.size("__near")
    return g.select(*by, "pos", vote.alias("vote"))


def assemble(df: DataFrame, xs: list[str], train: Column) -> tuple[DataFrame, DataFrame]:
    """Feature vectors scaled with training statistics; returns (train, test)."""
    v = VectorAssembler(inputCols=xs, outputCol="raw").transform(df.na.drop("any", subset=xs))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v.where(train))
    s = scaler.transform(v)
    return s.where(train), s.where(~train)


def leaderboard(train: DataFrame, test: DataFrame, models: dict[str, Estimator], label: str = "label") -> DataFrame:
    """Fit every model of the factory and score its test predictions; ranked by MCC."""
    out = None
    for name, est in models.items():
        pred = est.fit(train).transform(test)
        up = F.col("prediction") > 0.5
        c = pred.agg(*S.confusion(up, F.col(label) > 0.5)).withColumn("model", F.lit(name))
        out = c if out is None else out.unionByName(c)
    base = test.agg(*S.confusion(F.lit(True), F.col(label) > 0.5)).withColumn("model", F.lit("always_up"))
    board = S.classification_scores(out.unionByName(base))
    rank = F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mcc")))
    return board.withColumn("rank", rank).withColumn("never_down", (F.col("tn") + F.col("fn")) == 0)


def importances(model, xs: list[str], df: DataFrame) -> DataFrame:
    """Feature importances of a fitted tree ensemble as rows (feature count, not data, sized)."""
    vals = model.featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(list(zip(xs, vals)), "feature string, importance double")


def probability(pred: DataFrame) -> Column:
    return vector_to_array("probability")[1]
