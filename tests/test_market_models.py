"""Nearest joins, fold classifiers, lasso, attribution, virtual trades and gates against plain versions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import events as EV
from tidemark.operators import inference as N
from tidemark.operators import lasso as L
from tidemark.operators import linear
from tidemark.operators import models as ML
from tidemark.operators import quality as Q
from tidemark.operators.nearest import nearest_join


@pytest.mark.parametrize("k", [1, 7])
def test_nearest_join_is_exact(spark, k):
    """Clusters, a crowd of equal points, ties, a hot key and a key with fewer points than k."""
    rng = np.random.default_rng(k)
    n = 1500
    x = np.round(rng.standard_normal((12, 3))[rng.integers(0, 12, n)] * 4 + rng.standard_normal((n, 3)) * 0.5, 2)
    x[:200] = x[0]
    p = pd.DataFrame(x, columns=["a", "b", "c"]).assign(symbol=np.where(np.arange(n) < 1400, "A", "B"), pos=np.arange(n), y=rng.integers(0, 2, n))
    p.loc[n] = [0.0, 0.0, 0.0, "C", n, 1]
    q = p.sample(120, random_state=1)
    q = pd.concat([q, p.tail(1)]).assign(pos=lambda d: d.pos + 10_000)
    got = nearest_join(spark.createDataFrame(q), spark.createDataFrame(p), ["a", "b", "c"], k, ["symbol"], carry=("y",)).toPandas()
    for w in q.itertuples():
        m = p[p.symbol == w.symbol]
        d2 = (m.a - w.a) ** 2 + (m.b - w.b) ** 2 + (m.c - w.c) ** 2
        want = [int(i) for _, i in sorted(zip(d2, m.pos))[:k]]
        mine = got[got.pos == w.pos].sort_values("rank")
        assert mine.neighbour.tolist() == want and mine.y.tolist() == p.set_index("pos").y[want].tolist()


def test_nearest_join_leaves_out_nulls_and_meets_few_rows(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 2)) * 50
    p = pd.DataFrame(centres[np.arange(2000) % 20] + rng.standard_normal((2000, 2)), columns=["a", "b"]).assign(symbol="A", pos=range(2000))
    q = p.head(200).assign(pos=lambda d: d.pos + 5000)
    q.loc[0, "a"] = np.nan
    pts, qs = spark.createDataFrame(p), spark.createDataFrame(q).withColumn("a", F.nanvl("a", F.lit(None).cast("double")))
    r = nearest_join(qs, pts, ["a", "b"], 5, ["symbol"])
    assert r.select("pos").distinct().count() == 199 and r.count() == 995
    # the rows that meet before ranking are far fewer than all pairs
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 1753])
def test_keyed_permutations(n):
    p = N.permuted(23, np.arange(40), n)
    assert (np.sort(p, axis=1) == np.arange(n)).all()
    assert n < 5 or len({tuple(r) for r in p}) > min(30, n)
    assert np.array_equal(N.permuted(23, np.array([7]), n)[0], p[7])


def test_keyed_permutations_are_even():
    p = N.permuted(5, np.arange(20_000), 12)
    counts = np.array([np.bincount(p[:, i], minlength=12) for i in range(12)])
    assert np.abs(counts / 20_000 - 1 / 12).max() < 0.012


def fold_rows(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 2))
    y = (x[:, 0] + 0.5 * rng.standard_normal(n) > 0.2).astype(float)
    return x, y


def test_fold_classifier_has_zero_gradient(spark):
    """Every fold's weights are where its own penalised gradient vanishes, found by steps of another kind."""
    x, y = fold_rows()
    got = ML.fold_newton(100, 40, 3, 1.0, 2)({"x0": x[:, 0], "x1": x[:, 1], "y": y}, np.arange(10))
    assert got[:, 0].tolist() == [0, 1, 2, 3]
    for fold, *w in got:
        t = int(100 + fold * 40)
        mean, sd = x[:t].mean(axis=0), x[:t].std(axis=0)
        u, v = np.column_stack([np.ones(t), (x[:t] - mean) / sd]), np.zeros(3)
        for _ in range(20_000):
            v = v - 0.01 * (u.T @ (1 / (1 + np.exp(-u @ v)) - y[:t]) + np.array([0, v[1], v[2]]))
        own = v[1:] / sd
        assert np.abs(np.array(w) - [v[0] - own @ mean, *own]).max() < 1e-8


def test_fold_classifier_survives_constant_and_separable_data():
    x, y = fold_rows()
    got = ML.fold_newton(100, 40, 0, 1.0, 2)({"x0": np.full(240, 3.0), "x1": y * 2 - 1, "y": y}, np.arange(3))
    assert np.isfinite(got).all() and (got[:, 2] == 0).all() and (got[:, 3] > 0).all()
    assert ML.fold_newton(300, 40, 0, 1.0, 2)({"x0": x[:, 0], "x1": x[:, 1], "y": y}, np.arange(3)) is None


def test_walk_forward_never_sees_the_test_rows(spark):
    x, y = fold_rows()
    rows = lambda lab: spark.createDataFrame(pd.DataFrame({"symbol": "A", "pos": np.arange(1, 241), "a": x[:, 0], "b": x[:, 1], "y": lab}))
    one = ML.walk_forward_logistic(rows(y), ["a", "b"], "y", 100, 40, 5).toPandas().sort_values("pos")
    flipped = np.where(np.arange(240) >= 180, 1 - y, y)
    two = ML.walk_forward_logistic(rows(flipped), ["a", "b"], "y", 100, 40, 5).toPandas().sort_values("pos")
    assert one.pos.min() == 106 and one.fold.tolist() == ((one.pos - 106) // 40).tolist()
    early = one.pos.values <= 185
    assert np.array_equal(one.p.values[early], two.p.values[early]) and not np.allclose(one.p.values[~early], two.p.values[~early])


def test_lasso_meets_its_conditions(spark):
    """At several penalties: gradients of features in are at the penalty, of those out below it; errors equal those on raw rows."""
    rng = np.random.default_rng(4)
    n, k, folds = 203, 4, 5
    x = rng.standard_normal((n, k)) @ np.array([[1, 0.6, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0.3], [0, 0, 0, 1]])
    y = x @ np.array([0.5, 0, -0.2, 0.0]) + 0.3 * rng.standard_normal(n) + 2
    xs = [f"x{i}" for i in range(k)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=xs).assign(symbol="A", pos=np.arange(n), y=y))
    got = L.lasso(df, xs, "y", ["symbol"], [0.9, 0.5, 0.1, 0.01], folds).toPandas().sort_values("alpha", ascending=False)
    assert got.chosen.sum() == 1

    def conditions(xt, yt, w, base, a):
        r = yt - base - xt @ w
        g = (xt - xt.mean(axis=0)).T @ r / len(yt)
        assert abs(r.mean()) < 1e-9
        assert np.abs(g[w != 0] - a * np.sign(w[w != 0])).max(initial=0) < 1e-8 and (np.abs(g[w == 0]) <= a + 1e-9).all()

    sizes = [n // folds + (i < n % folds) for i in range(folds)]
    edges = np.cumsum([0, *sizes])
    for r in got.itertuples():
        w = np.array([getattr(r, f"beta_{c}") for c in xs])
        conditions(x, y, w, r.intercept, r.alpha)
        errors = []
        for a, b in zip(edges, edges[1:]):
            keep = np.r_[0:a, b:n]
            xt, yt = x[keep], y[keep]
            cov = np.cov(np.column_stack([xt, yt]).T, bias=True)
            v = L.descend(cov, np.array([r.alpha]))[0]
            base = yt.mean() - v @ xt.mean(axis=0)
            conditions(xt, yt, v, base, r.alpha)
            errors.append(((y[a:b] - base - x[a:b] @ v) ** 2).mean())
        assert abs(r.cv_error - np.mean(errors)) < 1e-9
    assert (got.cv_error.iloc[0] > got.cv_error.iloc[2]) and [int(abs(got[f"beta_x{i}"].iloc[0]) > 0) for i in range(k)] == [1, 0, 0, 0]


def test_attribution_with_constant_and_repeated_factors(spark):
    rng = np.random.default_rng(6)
    n, k = 90, 20
    a, b = rng.standard_normal(n).round(3), (rng.standard_normal(n) * 100).round(3)
    y = (0.4 * a - 0.002 * b + 0.1 * rng.standard_normal(n)).round(4)
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2020-01-01", periods=n).date, "a": a, "b": b, "flat": 7.25, "twin": 2 * a, "y": y})
    got = linear.rolling_attribution(spark.createDataFrame(pdf), ["a", "b", "flat", "twin"], "y", k).toPandas().sort_values("ts").reset_index(drop=True)
    assert len(got) == n - k and (got.flat_weight == 0).all() and (got.flat_part == 0).all()
    for j, i in enumerate(range(k, n)):
        x = np.column_stack([a, b, np.full(n, 7.25), 2 * a])[i - k : i]
        mean, sd = x.mean(axis=0), x.std(axis=0)
        sd = np.where(sd < 1e-12, 1, sd)
        u = np.column_stack([np.ones(k), (x - mean) / sd])
        w = np.linalg.lstsq(u, y[i - k : i], rcond=None)[0]
        now = (np.array([a[i], b[i], 7.25, 2 * a[i]]) - mean) / sd
        parts = w[1:] * now
        mine = got.loc[j, ["a_part", "b_part", "flat_part", "twin_part"]].to_numpy(dtype=float)
        assert np.abs(mine - parts).max() < 1e-7 and abs(got.base[j] - w[0]) < 1e-9 and abs(got.rest[j] - (y[i] - w[0] - parts.sum())) < 1e-7
        fit = u @ w
        assert abs(got.r2[j] - (1 - ((y[i - k : i] - fit) ** 2).sum() / ((y[i - k : i] - y[i - k : i].mean()) ** 2).sum())) < 1e-7


def scan(rows):
    """The virtual trade of each pulse by scanning ahead."""
    out = []
    for i, (pos, close, danger, calm, pulse) in enumerate(rows):
        if not pulse:
            continue
        late, above, entry, why = danger is True, danger is False, None, "still_out"
        for j in range(i + 1, len(rows)):
            d, c = rows[j][2], rows[j][3]
            if late:
                if d is False:
                    entry, why = j, "recovered"
                    break
                continue
            if above and d is True:
                entry, why = j, "new_danger"
                break
            above = above or d is False
            if c is True:
                entry, why = j, "calm"
                break
        e = len(rows) - 1 if entry is None else entry
        span = [r[1] for r in rows[i : e + 1]]
        out.append((pos, "late" if late else "early", rows[e][0], why, *[round(v / close - 1, 9) for v in (rows[e][1], min(span), max(span))], round(rows[e + 5][1] / rows[e][1] - 1, 9) if e + 5 < len(rows) else None))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_virtual_trades_equal_a_scan(spark, seed):
    rng = random.Random(seed)
    flags = lambda: rng.choice([True, False, False, None])
    rows = [(i + 1, round(rng.uniform(50, 150), 2), flags(), rng.random() < 0.1, rng.random() < 0.2) for i in range(120)]
    df = spark.createDataFrame([("A", *r) for r in rows], "symbol string, pos long, close double, danger boolean, calm boolean, pulse boolean").withColumn("ts", F.col("pos"))
    t = EV.virtual_trades(df, F.col("pulse"), F.col("danger"), F.col("calm"), "close", 255, (5,)).orderBy("pos").collect()
    got = [(r.pos, r.kind, r.entry, r.reason, *[round(v, 9) for v in (r.out, r.avoided, r.missed)], None if r.after5 is None else round(r.after5, 9)) for r in t]
    assert got == scan(rows)


def test_range_extremes(spark):
    rng = random.Random(2)
    v = [round(rng.random(), 4) for _ in range(100)]
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(v)], "symbol string, pos long, v double")
    spans = [(a, rng.randint(a, 99)) for a in range(0, 100, 3)] + [(0, 99), (99, 99)]
    s = spark.createDataFrame([("A", a, b) for a, b in spans] + [("A", 4, None)], "symbol string, a long, b long")
    got = {(r.a, r.b): (r.low, r.high) for r in EV.range_extremes(s, EV.with_blocks(df, "v", 127), "a", "b").collect()}
    assert got == {**{(a, b): (min(v[a : b + 1]), max(v[a : b + 1])) for a, b in spans}, (4, None): (None, None)}


def test_gates_and_sparse_columns(spark):
    models = {n: spark.createDataFrame(r, "symbol string, cagr double") for n, r in {"base": [("A", 0.10), ("B", 0.2)], "other": [("A", 0.14), ("C", 0.1)]}.items()}
    got = {(r.symbol, r.gate): r.ok for r in Q.tolerance_gates(models, ["symbol"], "base", [("wide", "other", "cagr", 0.05), ("tight", "other", "cagr", 0.03)]).collect()}
    assert got == {("A", "wide"): True, ("A", "tight"): False, **{(s, g): False for s in "BC" for g in ("wide", "tight")}}
    d = spark.createDataFrame([(1, 1.0, None, None), (2, None, None, 2.0), (3, 1.0, None, None), (4, 1.0, 1.0, 2.0)], "k int, a double, b double, c double")
    assert Q.drop_sparse(d, ["a", "b", "c"]).columns == ["k", "a"] and Q.drop_sparse(d.where("k > 9"), ["a", "b"]).columns == d.columns
