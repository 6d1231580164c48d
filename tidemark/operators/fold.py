"""Path-dependent folds over one ordered array per series.

A series holds one row per calendar day, so its array is bounded by the
calendar whatever the table size; all parallelism is across (series, variant).
Folds run as the SQL higher-order function ``aggregate`` and stay in the JVM.
Everything that does not depend on the path (latches, priorities, returns) is
computed before by windows; the fold sees one small struct per day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import TRADING_DAYS, nz
from tidemark.operators.latch import latch, latch_event, priority
from tidemark.session import spread

# Fixed values of the published v2 rule set: they must be equal for equal results.
FEE = 0.0086
FLOOR = 0.001
RULES = {
    "z_trigger": 1.2, "z_recover": 0.5,
    "vz_trigger": 1.5, "vz_recover": 0.5, "vz_lev": 2.0,
    "inf_trigger": 2.5, "inf_recover": 0.3, "inf_lev": 1.0,
    "nl_trigger": -1.5, "nl_recover": -0.5, "nl_lev": 2.0,
    "tc_bps": 25.0,
}


def day_arrays(df: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """One row per key with its days as an array sorted by ``ts``.

    The array is bounded by the calendar because a series has one row per day;
    two rows of one day are an input error, whatever their number.
    """
    out = spread(df, *by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ts", *fields))).alias("days"))
    twice = F.size(F.array_distinct("days.ts")) < F.size("days")
    return out.withColumn("days", F.when(twice, F.raise_error(F.lit("a series must hold one row per day"))).otherwise(F.col("days")))


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_layers(sig: DataFrame, by: list[str], p=None, credit=True, vol=True, ratio=True, liq=False, on_null="hold") -> DataFrame:
    """Latches and the winning layer per day.

    ``layer``: 0 master out, 1 credit, 2 ratio, 3 volatility, 4 liquidity, 5 none.
    ``p`` may hold numbers or columns (variant parameters).
    """
    p = {**RULES, **(p or {})}
    order = ("ts",)
    flag = lambda c: c if isinstance(c, Column) else F.lit(c)
    ev = {
        "in_credit": latch_event(F.when(flag(credit), F.col("z")), p["z_trigger"], p["z_recover"], "master", on_null=on_null),
        "in_vol": latch_event(F.when(flag(vol), F.col("vz")), p["vz_trigger"], p["vz_recover"], "master", on_null=on_null),
        "in_ratio": latch_event(F.when(flag(ratio), F.col("iz")), p["inf_trigger"], p["inf_recover"], "master", on_null=on_null),
        "in_liq": latch_event(F.when(flag(liq), F.col("nlz")), p["nl_trigger"], p["nl_recover"], "master", inverted=True, on_null=on_null),
    }
    sig = sig.withColumns({n: latch(e, by, order) for n, e in ev.items()})
    on = lambda n: F.col(n) == 1
    return sig.withColumn(
        "layer",
        priority([(F.col("master") == 0, 0), (on("in_credit"), 1), (on("in_ratio"), 2), (on("in_vol"), 3), (on("in_liq"), 4)], 5),
    )


def leverage_fold(
    df: DataFrame,
    by: list[str],
    p=None,
    credit_unprofitable: str = "three",
    never_sell_in_loss: bool = True,
    next_open: bool = True,
) -> DataFrame:
    """Replay the leverage rule; one row of moments and the trade log per key.

    Input rows: ts, r, gap, intra, rate, layer (see ``with_layers``). A NULL rate
    is rejected rather than allowed to poison the equity.
    """
    p = {**RULES, **(p or {})}
    # only parameters that differ between series travel with the days
    varied = {k: v for k, v in p.items() if isinstance(v, Column)}
    fixed = {k: F.lit(float(v)) for k, v in p.items() if k not in varied}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    prepared = df.select(
        *by, "ts",
        zero(F.col("r")).alias("r"), zero(F.col("gap")).alias("gap"), zero(F.col("intra")).alias("intra"),
        F.when(F.col("rate").isNull(), F.raise_error(F.lit("rate must not be NULL"))).otherwise(F.col("rate")).alias("rate"),
        F.col("layer").cast("int").alias("layer"),
        *[c.alias(f"p_{k}") for k, c in varied.items()],
    )
    arr = day_arrays(prepared, by, ["r", "gap", "intra", "rate", "layer", *[f"p_{k}" for k in varied]])
    d0 = F.lit(0.0)
    trade_type = "array<struct<signal_date:date,exec_date:date,from_lev:double,to_lev:double,equity:double,layer:int>>"
    init = F.struct(
        F.lit(1.0).alias("eq"), F.lit(3.0).alias("lev"), F.lit(-1.0).alias("pend"), F.lit(0).alias("why"),
        F.lit(False).alias("held"), F.lit(1.0).alias("basis"), F.lit(0).alias("trades"), F.lit(0).alias("n"),
        d0.alias("sr"), d0.alias("srr"), F.lit(1.0).alias("peak"), d0.alias("mdd"), F.lit(0).alias("days_in"),
        F.lit(None).cast("date").alias("last"), F.array().cast(trade_type).alias("log"),
    )

    def step(s, x):
        lev = F.when(s["pend"] >= 0, s["pend"]).otherwise(s["lev"])
        return let(lev, lambda lv: settle(s, x, lv))

    def settle(s, x, lev):
        changed = lev != s["lev"]
        P = {**fixed, **{k: x[f"p_{k}"] for k in varied}}
        win = (s["held"] & (s["eq"] > s["basis"])) if never_sell_in_loss else F.lit(True)
        stay = F.lit(3.0) if credit_unprofitable == "three" else lev
        target = (
            F.when(x["layer"] == 0, 0.0)
            .when(x["layer"] == 1, F.when(win, 1.0).otherwise(stay))
            .when(x["layer"] == 2, F.when(win, P["inf_lev"]).otherwise(lev))
            .when(x["layer"] == 3, F.when(win, P["vz_lev"]).otherwise(lev))
            .when(x["layer"] == 4, F.when(win, P["nl_lev"]).otherwise(lev))
            .otherwise(3.0)
        )
        basis = (
            F.when((lev > 0) & ~s["held"], s["eq"])
            .when((s["lev"] > 0) & (lev > s["lev"]), (s["basis"] * s["lev"] + s["eq"] * (lev - s["lev"])) / lev)
            .otherwise(s["basis"])
        )
        split = changed if next_open else F.lit(False)
        gross = F.when(split, (1 + s["lev"] * x["gap"]) * (1 + lev * x["intra"]) - 1).otherwise(lev * x["r"])
        carry = F.when(lev > 1, -(lev - 1) * x["rate"] - F.lit(FEE / TRADING_DAYS) * F.least(lev / 3, F.lit(1.0))).otherwise(0.0)
        cash = F.when(lev == 0, x["rate"]).otherwise(0.0)
        cost = F.abs(lev - s["lev"]) * (P["tc_bps"] / 10000)
        grown = F.greatest(s["eq"] * (1 + gross + carry + cash - cost), F.lit(FLOOR))
        eq = F.when(s["n"] > 0, grown).otherwise(s["eq"])
        log = F.when(
            changed,
            F.concat(
                s["log"],
                F.array(
                    F.struct(
                        s["last"].alias("signal_date"), x["ts"].alias("exec_date"), s["lev"].alias("from_lev"),
                        lev.alias("to_lev"), s["eq"].alias("equity"), s["why"].alias("layer"),
                    )
                ),
            ),
        ).otherwise(s["log"])
        return let(
            F.struct(eq.alias("eq"), target.alias("target")),
            lambda v: F.struct(
                v["eq"].alias("eq"), lev.alias("lev"),
                F.when(v["target"] != lev, v["target"]).otherwise(-1.0).alias("pend"), x["layer"].alias("why"),
                (lev > 0).alias("held"), basis.alias("basis"), (s["trades"] + changed.cast("int")).alias("trades"),
                (s["n"] + 1).alias("n"),
                (s["sr"] + (v["eq"] / s["eq"] - 1)).alias("sr"),
                (s["srr"] + (v["eq"] / s["eq"] - 1) * (v["eq"] / s["eq"] - 1)).alias("srr"),
                F.greatest(s["peak"], v["eq"]).alias("peak"),
                F.least(s["mdd"], v["eq"] / F.greatest(s["peak"], v["eq"]) - 1).alias("mdd"),
                (s["days_in"] + (lev > 0).cast("int")).alias("days_in"),
                x["ts"].alias("last"), log.alias("log"),
            ),
        )

    out = arr.select(*by, F.aggregate("days", init, step).alias("s"))
    m = nz(F.col("s.n") - 1)
    sd = F.sqrt(F.greatest((F.col("s.srr") - F.col("s.sr") * F.col("s.sr") / m) / nz(m - 1), F.lit(0.0)))
    return out.select(
        *by,
        F.col("s.n").alias("n"),
        F.col("s.eq").alias("final"),
        (F.pow(F.col("s.eq"), TRADING_DAYS / F.col("s.n")) - 1).alias("cagr"),
        F.col("s.mdd").alias("mdd"),
        F.when(sd > 0, F.col("s.sr") / m / sd * F.sqrt(F.lit(TRADING_DAYS))).otherwise(0.0).alias("sharpe"),
        F.col("s.trades").alias("trades"),
        (F.col("s.days_in") / F.col("s.n")).alias("in_market"),
        F.when(F.col("s.pend") >= 0, F.col("s.pend")).alias("pending"),
        F.col("s.log").alias("log"),
    )


def instrument_fold(df: DataFrame, by: list[str], instruments: dict[int, dict[str, Column]], p=None) -> DataFrame:
    """Replay on real instruments instead of scaled returns.

    ``instruments[leverage]`` gives the columns ``r``, ``gap``, ``intra`` of the
    instrument held at that leverage. Switch days chain the old one's gap with the
    new one's intraday move and pay the cost multiplicatively; cash earns the rate
    on ordinary days; the cost basis is never blended.
    """
    p = {**RULES, **(p or {})}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    names = [f"{part}{k}" for k in instruments for part in ("r", "gap", "intra")]
    cols = [zero(instruments[k][part]).alias(f"{part}{k}") for k in instruments for part in ("r", "gap", "intra")]
    d = df.select(*by, "ts", "rate", F.col("layer").cast("int").alias("layer"), *cols)
    arr = day_arrays(d, by, ["rate", "layer", *names])

    def held_at(x, part, lev, cash):
        out = F.when(lev == 0, cash)
        for k in instruments:
            out = out.when(lev == k, x[f"{part}{k}"])
        return out.otherwise(0.0)

    init = F.struct(
        F.lit(1.0).alias("eq"), F.lit(3.0).alias("lev"), F.lit(-1.0).alias("pend"), F.lit(False).alias("held"),
        F.lit(1.0).alias("basis"), F.lit(0).alias("n"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("mdd"),
    )

    def step(s, x):
        return let(F.when(s["pend"] >= 0, s["pend"]).otherwise(s["lev"]), lambda lev: settle(s, x, lev))

    def settle(s, x, lev):
        win = s["held"] & (s["eq"] > s["basis"])
        layer = lambda k, on, off: F.when(x["layer"] == k, F.when(win, F.lit(float(on))).otherwise(off))
        target = F.coalesce(
            F.when(x["layer"] == 0, 0.0), layer(1, 1.0, F.lit(3.0)), layer(2, p["inf_lev"], lev), layer(3, p["vz_lev"], lev), layer(4, p["nl_lev"], lev), F.lit(3.0)
        )
        cost = F.abs(lev - s["lev"]) * (p["tc_bps"] / 10000)
        chained = (1 + held_at(x, "gap", s["lev"], F.lit(0.0))) * (1 + held_at(x, "intra", lev, F.lit(0.0))) * (1 - cost)
        growth = F.when(lev != s["lev"], chained).otherwise(1 + held_at(x, "r", lev, x["rate"]))
        eq = F.when(s["n"] > 0, F.greatest(s["eq"] * growth, F.lit(FLOOR))).otherwise(s["eq"])
        return let(
            F.struct(eq.alias("eq"), target.alias("t")),
            lambda v: F.struct(
                v["eq"].alias("eq"), lev.alias("lev"), F.when(v["t"] != lev, v["t"]).otherwise(-1.0).alias("pend"), (lev > 0).alias("held"),
                F.when((lev > 0) & ~s["held"], s["eq"]).otherwise(s["basis"]).alias("basis"), (s["n"] + 1).alias("n"),
                F.greatest(s["peak"], v["eq"]).alias("peak"), F.least(s["mdd"], v["eq"] / F.greatest(s["peak"], v["eq"]) - 1).alias("mdd"),
            ),
        )

    out = arr.select(*by, F.aggregate("days", init, step).alias("s"))
    cagr = F.pow(F.col("s.eq"), TRADING_DAYS / F.col("s.n")) - 1
    return out.select(*by, F.col("s.n").alias("n"), F.col("s.eq").alias("final"), cagr.alias("cagr"), F.col("s.mdd").alias("mdd"))
