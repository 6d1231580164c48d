"""Small hand-made inputs and brute force for the toolkit."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.functions import stats as S
from tidemark.operators import asof as A
from tidemark.operators import inference as N
from tidemark.operators import linear
from tidemark.operators import windows as W
from tidemark.operators.episodes import cooled_episodes, drawdown_episodes
from tidemark.operators.events import nearest_event
from tidemark.operators.latch import latch, latch_event
from tidemark.operators.models import nearest_vote
from tidemark.operators.projections import alternating_signals, daily_state, with_previous
from tidemark.plans import scale_queries
from tidemark.sources import files

D = lambda d: dt.date(2020, 1, d)
DAY0 = dt.date(2020, 1, 1)


def series(spark, values, symbol="A"):
    rows = [(symbol, DAY0 + dt.timedelta(days=i), i + 1, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, ts date, pos int, x double")


def col(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_nan_becomes_null_and_sentinel_is_missing(spark):
    d = spark.createDataFrame([(float("nan"), "."), (2.0, " 3.5 "), (1.0, "x")], "v double, t string")
    assert [r[0] for r in d.select(E.nan_to_null("v")).collect()] == [None, 2.0, 1.0]
    assert [r[0] for r in d.select(E.parse_number("t")).collect()] == [None, 3.5, None]
    assert [r[0] for r in d.select(E.clip(E.nan_to_null("v"), 0.0, 1.5)).collect()] == [None, 1.5, 1.0]


def test_rounding_of_doubles(spark):
    rows = [(0.5,), (-0.5,), (2.5,), (1.0049,), (-1.005001,), (1e17,), (float("nan"),), (float("inf"),), (None,)]
    got = spark.createDataFrame(rows, "x double").select(E.rounded("x", 0).alias("a"), E.rounded("x", 2).alias("b")).collect()
    assert [r.a for r in got[:6]] == [1.0, -1.0, 3.0, 1.0, -1.0, 1e17] and [r.b for r in got[:6]] == [0.5, -0.5, 2.5, 1.0, -1.01, 1e17]
    assert all(math.isnan(v) for v in got[6]) and list(got[7]) == [math.inf] * 2 and list(got[8]) == [None] * 2


def test_supplier_frames_are_not_stored_for_one_reading(spark, sf_dir):
    from tidemark.operators.signals import release
    from tidemark.plans import QUERIES

    release()
    for name in ("supplier_stress_latches", "supplier_leverage_backtest", "supplier_forward_outcomes", "supplier_drawdown_episodes", "supplier_mean_difference"):
        assert "InMemoryRelation" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString(), name


def test_fixed_rules_do_not_travel_with_the_days(spark, sf_dir):
    from tidemark.plans import QUERIES

    assert "p_tc_bps" not in QUERIES["supplier_leverage_backtest"](spark, sf_dir)._jdf.queryExecution().toString()


def test_date_rules(spark):
    d = spark.createDataFrame([(D(3),), (D(4),), (D(5),), (D(6),)], "d date")  # Fri..Mon
    assert [r[0] for r in d.select(E.publication_tuesday("d")).collect()] == [D(7), D(14), D(14), D(14)]
    assert [r[0] for r in d.select(E.trading_day("d")).collect()] == [D(3), D(6), D(6), D(6)]
    assert [r[0] for r in d.select(E.week_ending("d", "SU")).collect()] == [D(5), D(5), D(5), D(12)]
    assert [r[0] for r in d.select(E.week_ending("d", "FR")).collect()] == [D(3), D(10), D(10), D(10)]
    assert d.select(E.third_wednesday("d")).first()[0] == D(15)


def test_latch_is_strict_holds_null_and_resets(spark):
    d = series(spark, [1.0, 1.1, None, 0.5, 0.4, 2.0, 2.0]).withColumn("m", (F.col("pos") != 7).cast("int"))
    assert col(d.withColumn("s", latch(latch_event("x", 1.0, 0.5, "m"))), "s") == [0, 1, 1, 1, 0, 1, 0]
    assert col(d.withColumn("s", latch(latch_event("x", 1.0, 0.5, on_null="zero"))), "s") == [0, 1, 0, 0, 0, 1, 1]
    low = d.withColumn("s", latch(latch_event(-F.col("x"), -1.0, -0.5, inverted=True)))
    assert col(low, "s") == [0, 1, 1, 1, 0, 1, 1]


def test_alignment_variants_differ(spark):
    cal = spark.createDataFrame([("A", D(d)) for d in (3, 6, 7, 8)], "k string, ts date")
    obs = spark.createDataFrame([("A", D(1), 1.0), ("A", D(5), 5.0), ("A", D(7), 7.0)], "k string, ts date, v double")
    exact = A.reindex(cal, obs, ("k", "ts"))
    assert col(exact, "v") == [None, None, 7.0, None]
    assert col(exact.withColumn("f", W.filled("v", ("k",))), "f") == [None, None, 7.0, 7.0]
    assert col(A.asof(cal, obs, ["k"], "ts", ["v"]), "v") == [1.0, 5.0, 7.0, 7.0]
    assert col(A.asof(cal, obs, ["k"], "ts", ["v"], strict=True), "v") == [1.0, 5.0, 5.0, 7.0]
    assert col(A.asof(cal, obs, ["k"], "ts", ["v"], "forward"), "v") == [5.0, 7.0, 7.0, None]
    assert col(A.nearest(cal, obs, ["k"], "ts", ["v"], "o"), "v") == [5.0, 7.0, 7.0, 7.0]
    lag = A.available_on_calendar(cal, obs, ["k"], "ts", F.date_add("ts", 1), ["v"])
    assert col(lag, "v") == [1.0, 5.0, 5.0, 7.0]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_bucketed_asof_equals_the_plain_one(spark, direction, strict):
    g = random.Random(5)
    # one key holds most rows, and long stretches have no observation at all
    rows = lambda n: [("hot" if g.random() < 0.8 else g.choice("bc"), DAY0 + dt.timedelta(days=g.randrange(900)), i) for i, _ in enumerate(range(n))]
    cal = spark.createDataFrame(rows(400), "k string, ts date, id int")
    obs = spark.createDataFrame(rows(40), "k string, ts date, v int").groupBy("k", "ts").agg(F.max("v").alias("v"))
    a = A.asof(cal, obs, ["k"], "ts", ["v"], direction, strict, obs_on="o")
    b = A.asof(cal, obs, ["k"], "ts", ["v"], direction, strict, obs_on="o", bucket=F.trunc("ts", "month"))
    rows = lambda d: sorted(((r.id, r.v, r.o) for r in d.collect()), key=repr)
    assert rows(a) == rows(b) and len(rows(a)) == 400


def test_future_data_never_changes_available_values(spark):
    cal = spark.createDataFrame([("A", D(d)) for d in range(1, 21)], "k string, ts date")
    obs = spark.createDataFrame([("A", D(d), float(d)) for d in range(1, 15, 2)], "k string, ts date, v double")
    run = lambda o: col(A.available_on_calendar(cal, o, ["k"], "ts", E.publication_tuesday("ts"), ["v"]), "v")
    changed = obs.withColumn("v", F.when(F.col("ts") >= D(8), 99.0).otherwise(F.col("v")))
    assert run(obs)[:13] == run(changed)[:13]


def test_rolling_matches_pandas_with_gaps_and_constant_windows(spark):
    g = np.random.default_rng(3)
    v = [None if g.random() < 0.1 else 1000 + x for x in g.normal(size=200)] + [7.0] * 30
    d = W.with_zscore(W.with_rolling(series(spark, v), {"a": ("x", 20)}), {"z": ("x", 20)})
    p = pd.Series(v, dtype=float)
    mean, sd = p.rolling(20).mean(), p.rolling(20).std()
    np.testing.assert_allclose(np.array(col(d, "a_mean"), float), mean, rtol=1e-10)
    np.testing.assert_allclose(np.array(col(d, "a_std"), float)[:200], sd[:200], rtol=1e-7)
    assert col(d, "a_std")[-1] == 0.0 and col(d, "z")[-1] is None
    np.testing.assert_allclose(np.array(col(d, "z"), float)[:200], ((p - mean) / sd).round(6)[:200], atol=2e-6)


def test_rolling_pair_and_regression(spark):
    g = np.random.default_rng(4)
    x, n = g.normal(size=120), g.normal(size=120)
    y = 2 * x + n
    rows = [("A", DAY0 + dt.timedelta(days=i), i + 1, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, n, y))]
    d = spark.createDataFrame(rows, "symbol string, ts date, pos int, a double, b double, y double")
    r = W.with_rolling_pair(d, "a", "y", 30).orderBy("ts").toPandas()
    np.testing.assert_allclose(r["corr"].astype(float), pd.Series(x).rolling(30).corr(pd.Series(y)), rtol=1e-9)
    o = linear.rolling_ols(d, ["a", "b"], "y", 60).orderBy("ts").toPandas()
    assert len(o) == 61 and np.allclose(o["beta_a"], 2) and np.allclose(o["beta_b"], 1) and np.allclose(o["r2"], 1)
    m = linear.ols(d.withColumn("flat", F.lit(1.0)), ["symbol"], ["a", "flat"], "y").first()
    assert m.beta_flat == pytest.approx(0, abs=1e-9) and m.beta_a == pytest.approx(np.cov(x, y)[0, 1] / np.var(x, ddof=1))


def test_four_forward_drawdown_frames_differ(spark):
    d = series(spark, [10, 12, 6, 9, 8, 8, 8, 8, 8, 4])
    f = lambda lo, hi, **k: col(d.withColumn("m", W.forward_drawdown("x", lo, hi, **k)), "m")
    assert f(0, 1, require_full=True)[0] == 0.0 and f(0, 1, require_full=True)[-1] is None
    assert f(0, 2, require_full=True)[0] == pytest.approx(-0.5)
    assert f(1, 2, min_count=1)[1] == 0.0  # the peak starts at the first future row
    assert f(1, 3, min_count=3)[8] is None and f(1, 3, min_count=1)[8] == 0.0


def test_forward_drawdown_by_runs_equals_the_frame(spark):
    g = random.Random(3)
    d = series(spark, [None if g.random() < 0.15 else round(g.uniform(50, 150), 6) for _ in range(120)])
    for lo, hi, need in ((1, 22, 10), (0, 0, 1), (0, 2, 1), (1, 1, 1), (2, 9, 3), (1, 63, 40)):
        got = W.with_forward_drawdown(d, "m", "x", lo, hi, need)
        assert got.columns == [*d.columns, "m"]
        assert col(got, "m") == col(d.withColumn("m", W.forward_drawdown("x", lo, hi, need)), "m")


def test_supplier_outcomes_build_no_array_for_each_row(spark, sf_dir):
    plan = scale_queries.supplier_forward_outcomes(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "lambda" not in plan


def test_cooled_episodes_match_a_loop(spark):
    g = random.Random(9)
    v = [g.random() for _ in range(400)]
    for gap in (0, 5, 20):
        want, on, off = [], False, None
        for i, x in enumerate(v):
            if x > 0.6:
                if not on:
                    on = True
                    if off is None or i - off >= gap:
                        want.append(i + 1)
            elif on:
                on, off = False, i
        got = sorted(r.pos for r in cooled_episodes(series(spark, v), F.col("x") > 0.6, gap).collect())
        assert got == want


def test_equal_lows_and_highs_of_a_drawdown(spark):
    e = drawdown_episodes(series(spark, [100, 90, 100, 80, 85, 80, 99, 100]), "x", -0.10, -0.03).collect()
    assert [(r["start_ts"], r["trough_ts"], r["peak_ts"], r["n_rows"]) for r in e] == [(D(4), D(4), D(3), 3)]


def test_nearest_event_matches_brute_force(spark):
    g = random.Random(11)
    b, c = sorted(g.sample(range(1, 600), 40)), sorted(g.sample(range(1, 600), 15))
    mk = lambda ps: spark.createDataFrame([("A", p) for p in ps], "symbol string, pos int")
    got = {r.pos: r.delay for r in nearest_event(mk(b), mk(c), 30, 120).collect()}
    for p in b:
        near = [(abs(q - p), q, q - p) for q in c if -30 <= q - p <= 120]
        assert got[p] == (min(near)[2] if near else None)


def test_nearest_vote_is_exact(spark):
    g = random.Random(2)
    rows = [("A", i, round(g.gauss(0, 1), 1), int(g.random() < 0.5), i < 60) for i in range(90)]
    d = spark.createDataFrame(rows, "symbol string, pos int, x double, y int, tr boolean")
    got = {r.pos: r.vote for r in nearest_vote(d, "x", "y", F.col("tr"), 5).collect()}
    for _, p, x, _, tr in rows:
        if not tr:
            ds = sorted(abs(q[2] - x) for q in rows if q[4])[4]
            sure = [q for q in rows if q[4] and abs(q[2] - x) < ds - 1e-12]
            ties = [q for q in rows if q[4] and abs(abs(q[2] - x) - ds) <= 1e-12]
            lo = (sum(q[3] for q in sure) + max(0, (5 - len(sure)) - sum(1 - q[3] for q in ties))) / 5
            hi = (sum(q[3] for q in sure) + min(5 - len(sure), sum(q[3] for q in ties))) / 5
            assert lo - 1e-9 <= got[p] <= hi + 1e-9


def test_block_bootstrap_equals_concatenated_blocks(spark):
    v = [0.01, -0.02, 0.03, 0.005, -0.01, 0.02, 0.015]
    for b in (3, 7):
        out = N.block_bootstrap(series(spark, v), ["symbol"], [b], {"s": F.col("x"), "q": F.col("x") * F.col("x")}, reps=40, slices=4).collect()
        assert len(out) == 40
        for r in out:
            k = np.arange(len(v) // b + 1)
            start = N._draws(42, np.array([r.rep]), k, len(v) - b + 1)[0]
            x = np.concatenate([v[i : i + b] for i in start])[: len(v)]
            assert r.s == pytest.approx(x.sum()) and r.q == pytest.approx((x * x).sum())


def test_few_replicates_take_a_series_once(spark):
    d = series(spark, [1, 2, None, 4], "A").unionByName(series(spark, [5, 6], "B"))
    counted = lambda x, rep: np.column_stack([np.full(len(rep), len(rep)), np.full(len(rep), np.nansum(x["x"]))])
    got = N.per_replicate(d, ["symbol"], {"x": F.col("x")}, 200, counted, ["at_once", "total"], totals={"top": F.max("x")}).collect()
    assert {(r.symbol, r.top, r.at_once, r.total) for r in got} == {("A", 4.0, 200.0, 7.0), ("B", 6.0, 200.0, 11.0)}
    assert sorted((r.symbol, r.rep) for r in got) == [(s, i) for s in "AB" for i in range(200)]


def test_kept_draws_of_a_mean_difference(spark):
    kernel, rng = N.mean_difference(7), np.random.default_rng(1)
    for n, reps in ((50, range(40)), (90, range(40)), (60, range(40)), (60, range(300, 310))):
        r, late, rep = rng.normal(size=n), (np.arange(n) >= 20).astype(float), np.array(reps)
        v = r[N._draws(7, rep, np.arange(n), n)]
        assert kernel({"r": r, "late": late}, rep)[:, 0] == pytest.approx(v[:, 20:].mean(axis=1) - v[:, :20].mean(axis=1), abs=1e-15)


def test_draws_agree_between_columns_and_arrays(spark):
    d = spark.range(50).select(F.col("id").alias("rep"), (F.col("id") * 3).alias("k"))
    got = [r.d for r in N.with_draw(d, "d", [42, "rep", "k"], F.lit(97).cast("long")).orderBy("rep").collect()]
    same = [r[0] for r in d.orderBy("rep").select(E.draw(42, "rep", "k", n=97)).collect()]
    want = [int(N._draws(42, np.array([i]), np.array([3 * i]), 97)[0][0]) for i in range(50)]
    assert got == want == same and len(set(got)) > 25


def test_p_values_against_tables(spark):
    d = spark.createDataFrame([(2.228, 10.0, 4.965, 1.96)], "t double, df double, f double, z double")
    r = d.select(N.t_p_value("t", "df").alias("t"), N.f_p_value("f", F.lit(1.0), "df").alias("f"), N.normal_p_value("z").alias("z"), N.ks_p_value(F.lit(0.5), F.lit(40.0), F.lit(40.0)).alias("k")).first()
    assert r.t == pytest.approx(0.05, abs=1e-4) and r.f == pytest.approx(0.05, abs=1e-4) and r.z == pytest.approx(0.975, abs=1e-4) and 0 < r.k < 1e-3
    assert N.beta_inc(2, 3, 0.5) == pytest.approx(0.6875)


def test_break_scan_equals_the_direct_statistic(spark):
    g = np.random.default_rng(8)
    x = np.r_[g.normal(0, 1, 40), g.normal(1, 1, 40)]
    r = {q.pos: q.t for q in N.break_scan(series(spark, x), ["symbol"], "x", 10).collect()}
    for k in (10, 40, 70):
        a, b = x[:k], x[k:]
        sp = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(x) - 2)
        assert r[k] == pytest.approx((b.mean() - a.mean()) / math.sqrt(sp * (1 / len(a) + 1 / len(b))))
    assert min(r) == 10 and max(r) == 70


def test_metric_conventions(spark):
    d = series(spark, [0.01, -0.02, 0.03, 0.0, 0.01, -0.01])
    x = np.array([0.01, -0.02, 0.03, 0.0, 0.01, -0.01])
    r = d.agg(S.sharpe("x").alias("a"), S.sharpe("x", population=True).alias("b"), S.sortino("x").alias("c"), S.omega("x").alias("d")).first()
    assert r.a == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(252)) and r.b == pytest.approx(x.mean() / x.std() * math.sqrt(252))
    assert r.c == pytest.approx(x.mean() / math.sqrt((x[x < 0] ** 2).mean()) * math.sqrt(252)) and r.d == pytest.approx(0.05 / 0.03)
    flat = series(spark, [0.01, 0.01]).agg(S.sharpe("x").alias("a")).first()
    assert flat.a == 0.0


def test_projection_signals_use_the_current_target_year(spark):
    mp = lambda y, *v: {y + i: float(x) if x is not None else None for i, x in enumerate(v)}
    rows = [
        (dt.date(2020, 3, 15), 2020, mp(2020, 2.1, 2.0), mp(2020, 1.0, 1.5)),
        (dt.date(2020, 9, 15), 2021, mp(2020, 2.2, 2.3), mp(2020, 1.0, 1.9)),  # 2021: rate and pce up -> EXIT
        (dt.date(2020, 12, 15), 2021, mp(2020, 2.0, None), mp(2020, 1.0, 1.0)),  # no pce: skipped
        (dt.date(2021, 3, 15), 2021, mp(2021, 2.4, 2.4), mp(2021, 2.0, 2.0)),
        (dt.date(2021, 3, 16), 2021, mp(2021, 2.4, 2.4), mp(2021, 1.0, 2.0)),  # rate down -> ENTER
    ]
    p = spark.createDataFrame(rows, "meeting_date date, target_year int, pce map<int,double>, rate map<int,double>")
    s = alternating_signals(with_previous(p))
    assert [(r.signal, r.same_ty) for r in s.orderBy("meeting_date").collect()] == [("EXIT", False), ("", True), ("ENTER", True)]
    cal = spark.createDataFrame([(dt.date(2020, 9, 14),), (dt.date(2020, 9, 16),), (dt.date(2021, 3, 20),)], "ts date")
    assert [r.master for r in daily_state(s, cal).orderBy("ts").collect()] == [1, 0, 1]


def test_labelled_numbers_rules(spark):
    text = "Core rate projection 9.9\nCore rate\nno projection 8.8\nvalues 1.5 2.5\nCore rate 7.7"
    d = spark.createDataFrame([(1, text), (2, "nothing 1.0")], "id int, text string")
    got = files.labelled_numbers(d, "(?i)core rate", "(?i)projection", lookahead=3).collect()
    assert [(r.id, r.numbers) for r in got] == [(1, [1.5, 2.5])]
    assert files.labelled_numbers(d, "(?i)core rate", "(?i)projection").first().numbers == [7.7]


def test_file_readers(spark, tmp_path):
    (tmp_path / "GOLD.csv").write_text("date,value\n2020-01-01,1.5\n2020-01-02,.\nbad,3\n")
    r = files.read_series_csv(spark, str(tmp_path / "GOLD.csv")).collect()
    assert [(q.series_id, q.value) for q in r] == [("GOLD", 1.5), ("GOLD", None), ("GOLD", 3.0)] and r[2].ts is None
    (tmp_path / "a.json").write_text('[["2020-01-01", "1"], ["2020-01-02", "x"]]')
    (tmp_path / "b.json").write_text('{"values": [["2020-01-03", 2.5]]}')
    j = files.read_values_json(spark, str(tmp_path / "*.json")).orderBy("ts").collect()
    assert [(q.series_id, q.value) for q in j] == [("a", 1.0), ("b", 2.5)]


def test_checksum_ignores_order_and_sees_changes(spark):
    d = series(spark, [1, 2, 3])
    c = lambda x: files.checksum(x, ["symbol"], [F.col("ts").cast("string"), F.col("x").cast("string")]).first().checksum
    assert c(d) == c(d.orderBy(F.desc("ts"))) != c(d.withColumn("x", F.col("x") + 1)) and len(c(d)) == 8
