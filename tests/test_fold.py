"""The leverage replay, step by step and against independent replays."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import machines as M
from tidemark.operators import variants as V
from tidemark.operators.fold import FEE, instrument_fold, leverage_fold, with_layers

D0 = dt.date(2020, 1, 1)
SCHEMA = "symbol string, ts date, pos int, r double, gap double, intra double, rate double, z double, vz double, iz double, nlz double, master int"


def frame(spark, rows, symbol="A"):
    base = dict(r=0.0, gap=0.0, intra=0.0, rate=0.0, z=None, vz=None, iz=None, nlz=None, master=1)
    data = [(symbol, D0 + dt.timedelta(days=i), i + 1, *[{**base, **row}[k] for k in base]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def run(spark, rows, **kw):
    return leverage_fold(with_layers(frame(spark, rows), ["symbol"], **kw.pop("layers", {})), ["symbol"], **kw).first()


def test_day_zero_earns_nothing_and_costs_nothing(spark):
    out = run(spark, [{"r": 0.5}])
    assert out.final == 1.0 and out.trades == 0 and out.n == 1


def test_a_series_may_be_of_any_length(spark):
    n = 120_000
    days = spark.range(n).select(
        F.lit("A").alias("symbol"), F.date_add(F.to_date(F.lit("1650-01-01")), F.col("id").cast("int")).alias("ts"),
        *[F.lit(0.0).alias(c) for c in ("r", "gap", "intra", "rate")], F.lit(5).alias("layer"),
    )
    out = leverage_fold(days, ["symbol"]).first()
    assert out.n == n and out.trades == 0


def test_two_rows_of_one_day_are_an_error(spark):
    df = frame(spark, [{}, {}]).withColumn("ts", F.lit(D0))
    with pytest.raises(Exception, match="one row per day"):
        leverage_fold(with_layers(df, ["symbol"]), ["symbol"]).collect()


def test_without_layers_it_is_buy_and_hold_at_three(spark):
    out = run(spark, [{}, {"r": 0.01}, {"r": -0.02}])
    fee = FEE / 252
    assert out.final == pytest.approx((1 + 0.03 - fee) * (1 - 0.06 - fee), rel=1e-12)


def test_switch_waits_one_day_and_splits_gap_and_intraday(spark):
    # day 1 gains, so the credit trigger on day 1 finds a profitable trade on day 2
    rows = [{}, {"r": 0.10}, {"r": 0.0, "z": 2.0}, {"gap": 0.01, "intra": 0.02, "r": 0.0302, "z": 2.0, "rate": 0.0}]
    out = run(spark, rows)
    fee = FEE / 252
    eq = (1 + 0.3 - fee) * (1 - fee)
    eq *= 1 + ((1 + 3 * 0.01) * (1 + 1 * 0.02) - 1) - 2 * 25 / 1e4
    assert out.final == pytest.approx(eq, rel=1e-12)
    assert [(t.from_lev, t.to_lev, t.layer) for t in out.log] == [(3.0, 1.0, 1)]
    assert out.log[0].signal_date == D0 + dt.timedelta(days=2) and out.log[0].exec_date == D0 + dt.timedelta(days=3)


def test_unprofitable_credit_goes_to_three_but_can_be_told_to_hold(spark):
    rows = [{}, {"r": -0.10}, {"z": 2.0}, {"z": 2.0}]
    assert run(spark, rows).trades == 0
    lost = [{"master": 0}, {"r": 0.0}, {"master": 1}, {"r": -0.1, "vz": 2.0}, {"vz": 2.0}]
    assert run(spark, lost).trades == 2


def test_master_out_earns_cash_and_resets_latches(spark):
    rows = [{}, {"master": 0, "z": 2.0}, {"master": 0, "rate": 0.001}, {"rate": 0.001, "z": 0.8}, {"z": 0.8}]
    d = with_layers(frame(spark, rows), ["symbol"])
    assert [r.in_credit for r in d.orderBy("ts").collect()] == [0, 0, 0, 0, 0]
    out = leverage_fold(d, ["symbol"]).first()
    assert [(t.to_lev) for t in out.log] == [0.0, 3.0]


def test_added_exposure_blends_the_basis_and_equity_has_a_floor(spark):
    out = run(spark, [{}, {"r": -0.5}, {"r": -0.5}])
    assert out.final == 0.001


def test_null_rate_is_rejected(spark):
    with pytest.raises(Exception, match="rate must not be NULL"):
        run(spark, [{}, {"rate": None}])


def noise(seed, n=300):
    g = random.Random(seed)
    maybe = lambda v: None if g.random() < 0.1 else v
    out = []
    for _ in range(n):
        gap, intra = g.gauss(0, 0.006), g.gauss(0.0004, 0.006)
        out.append(dict(r=maybe((1 + gap) * (1 + intra) - 1), gap=gap, intra=maybe(intra), rate=0.0001, z=maybe(g.gauss(0, 1.2)), vz=maybe(g.gauss(0, 1.2)), iz=maybe(g.gauss(0, 1.8)), nlz=maybe(g.gauss(0, 1.2)), master=int(g.random() > 0.05)))
    return out


def test_fold_and_vector_replay_agree(spark):
    sig = frame(spark, noise(1), "A").unionByName(frame(spark, noise(2), "B"))
    rows = [{}, {"use_vol": 0}, {"use_liq": 1}, {"credit_hold": 1}, {"tc_bps": 200}, {"z_trigger": 2.0, "vz_lev": 0.0}]
    fast = {(r.symbol, r.variant_id): r for r in V.replay(sig, V.listed(spark, rows), chunk=4).where("period = -1").collect()}
    assert len(fast) == 12
    for i, r in enumerate(rows):
        p = {**V.DEFAULTS, **r}
        layers = with_layers(sig, ["symbol"], p, credit=bool(p["use_credit"]), vol=bool(p["use_vol"]), ratio=bool(p["use_ratio"]), liq=bool(p["use_liq"]))
        slow = leverage_fold(layers, ["symbol"], {k: p[k] for k in V.RULES}, credit_unprofitable="hold" if p["credit_hold"] else "three")
        for s in slow.collect():
            f = fast[(s.symbol, i)]
            for a, b in ((s.final, f.final), (s.mdd, f.mdd), (s.sharpe, f.sharpe1), (s.trades, f.trades), (s.cagr, f.cagr), (s.in_market, f.in_market)):
                assert a == pytest.approx(b, rel=1e-9, abs=1e-12)


def test_replay_does_not_depend_on_row_order_or_other_variants(spark):
    sig = frame(spark, noise(3))
    a = V.replay(sig.orderBy(F.rand(1)), V.listed(spark, [{}, {"tc_bps": 100}])).where("variant_id = 0 and period = -1").first()
    b = V.replay(sig, V.listed(spark, [{}])).where("period = -1").first()
    assert a.final == b.final and a.trades == b.trades


def test_paths_end_where_the_metrics_say(spark):
    sig = frame(spark, noise(4))
    p = V.equity_paths(sig, V.listed(spark, [{}])).orderBy("pos").collect()
    m = V.replay(sig, V.listed(spark, [{}])).where("period = -1").first()
    assert p[-1].eq == m.final and p[0].eq == 1.0 and len(p) == m.n


def test_instruments_equal_scaled_returns_without_switches(spark):
    rows = [{}, {"r": 0.01}, {"r": 0.02}]
    inst = {k: {c: k * F.col(c) for c in ("r", "gap", "intra")} for k in (3, 2, 1)}
    out = instrument_fold(with_layers(frame(spark, rows), ["symbol"]), ["symbol"], inst).first()
    assert out.final == pytest.approx(1.03 * 1.06, rel=1e-12)


def test_grid_keeps_trigger_above_recover_and_numbers_by_position(spark):
    g = V.grid(spark, {"z_trigger": [0.5, 1.0], "z_recover": [0.2, 0.5]})
    assert sorted((r.variant_id, r.z_trigger, r.z_recover) for r in g.table.collect()) == [(0, 0.5, 0.2), (1, 1.0, 0.2), (3, 1.0, 0.5)]
    assert V.grid(spark, V.PUBLISHED_GRID).table.count() == 17250


def states(spark, sw, df):
    return [r.state for r in M.with_state(df, sw).orderBy("ts").collect()]


def test_minimum_hold_counts_from_the_day_after_exit(spark):
    rows = [{"z": 2.0}] + [{"z": 0.0}] * 4
    d = frame(spark, rows)
    assert states(spark, M.hold_machine(d, F.col("z") > 1, F.col("z") < 1, 3), d) == [0, 0, 0, 1, 1]


def test_machines_match_plain_loops(spark):
    rows = noise(7, 200)
    d = frame(spark, rows)
    yes = lambda v: bool(v) if v is not None else False
    gt = lambda x, t: x is not None and x > t
    lt = lambda x, t: x is not None and x < t
    # minimum hold with cool-down
    st, hold, fired, want = 1, 0, None, []
    for i, r in enumerate(rows):
        day = D0 + dt.timedelta(days=i)
        if st == 1:
            if gt(r["z"], 1) and (fired is None or (day - fired).days >= 20):
                st, hold, fired = 0, 0, day
        else:
            hold += 1
            if hold >= 5 and lt(r["vz"], 0):
                st = 1
        want.append(st)
    assert states(spark, M.hold_machine(d, F.col("z") > 1, F.col("vz") < 0, 5, 20), d) == want
    # sticky confirmation
    st, wants, want = 1, True, []
    for r in rows:
        a, b = r["master"], int(not gt(r["z"], 0.5))
        if st == 1:
            if a == 0:
                st, wants = 0, False
        else:
            wants = wants or a == 1
            if wants and b == 1:
                st = 1
        want.append(st)
    b = (~F.coalesce(F.col("z") > 0.5, F.lit(False))).cast("int")
    assert states(spark, M.confirmed_return(d, F.col("master"), b), d) == want
    assert yes(1)
