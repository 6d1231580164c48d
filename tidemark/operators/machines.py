"""Two-state machines with memory (minimum hold, cool-down, context) and strategy paths.

Conditions are Catalyst columns computed up front. The fold keeps a tiny state
and logs only the switches, so its output is a few rows per series; the daily
state is rebuilt from them with a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fold import day_arrays
from tidemark.operators.windows import over, upto

LOG = "array<struct<ts:date,state:int,reason:string>>"


def _fold(df: DataFrame, by, fields: dict[str, Column], init: dict[str, Column], step) -> DataFrame:
    """Run ``step(state, day) -> dict`` over each ordered series; returns the switch log."""
    d = df.select(*by, "ts", *[c.alias(n) for n, c in fields.items()])
    arr = day_arrays(d, list(by), list(fields))
    start = F.struct(*[v.alias(k) for k, v in init.items()], F.array().cast(LOG).alias("log"))

    def one(s, x):
        new, state, reason = step(s, x)
        entry = F.array(F.struct(x["ts"].alias("ts"), state.alias("state"), reason.alias("reason")))
        log = F.when(state != s["state"], F.concat(s["log"], entry)).otherwise(s["log"])
        return F.struct(*[new.get(k, s[k]).alias(k) for k in init], log.alias("log"))

    log = arr.select(*by, F.explode(F.aggregate("days", start, one, lambda s: s["log"])).alias("e"))
    return log.select(*by, "e.*")


def hold_machine(df: DataFrame, exit_c: Column, enter_c: Column, min_hold=0, cooldown_days: int = 0, by=("symbol",)) -> DataFrame:
    """Switches of an IN/OUT machine.

    OUT on ``exit_c`` (if the last fired exit is ``cooldown_days`` back); IN again
    once OUT for ``min_hold`` rows after the exit row and ``enter_c`` holds.
    """
    hold = min_hold if isinstance(min_hold, Column) else F.lit(min_hold)
    yes = lambda c: F.coalesce(c, F.lit(False))
    init = {"state": F.lit(1), "hold": F.lit(0), "fired": F.lit(None).cast("date")}

    def step(s, x):
        inside = s["state"] == 1
        cool = s["fired"].isNull() | (F.datediff(x["ts"], s["fired"]) >= cooldown_days)
        out = inside & x["exit_c"] & cool
        held = s["hold"] + 1
        back = ~inside & (held >= x["min_hold"]) & x["enter_c"]
        state = F.when(out, 0).when(back, 1).otherwise(s["state"])
        new = {"state": state, "hold": F.when(out, 0).when(inside, s["hold"]).otherwise(held), "fired": F.when(out, x["ts"]).otherwise(s["fired"])}
        return new, state, F.when(out, "exit").otherwise("enter")

    return _fold(df, by, {"exit_c": yes(exit_c), "enter_c": yes(enter_c), "min_hold": hold}, init, step)


def conditional_reentry(df: DataFrame, exit_c: Column, level: Column, threshold: float, normal_c: Column, by=("symbol",)) -> DataFrame:
    """Re-entry depends on the context at exit.

    Late exit (level already at/below the threshold): wait for recovery above it.
    Otherwise: re-enter when the level falls to the threshold after having been
    above it since the exit, or when ``normal_c`` holds.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    fields = {"exit_c": yes(exit_c), "high": yes(level > threshold), "low": yes(level <= threshold), "normal": yes(normal_c)}
    init = {"state": F.lit(1), "late": F.lit(False), "above": F.lit(False)}

    def step(s, x):
        out = (s["state"] == 1) & x["exit_c"]
        above = s["above"] | x["high"]
        fresh = ~s["late"] & above & x["low"]
        back = (s["state"] == 0) & ((s["late"] & x["high"]) | fresh | (~s["late"] & x["normal"]))
        state = F.when(out, 0).when(back, 1).otherwise(s["state"])
        new = {"state": state, "late": F.when(out, x["low"]).otherwise(s["late"]), "above": F.when(out, x["high"]).when(s["state"] == 0, above).otherwise(s["above"])}
        reason = F.when(out, "exit").when(s["late"], "recovery").when(fresh, "new_low").otherwise("normalised")
        return new, state, reason

    return _fold(df, by, fields, init, step)


def confirmed_return(df: DataFrame, a: Column, b: Column, by=("symbol",)) -> DataFrame:
    """OUT when a=0; a=1 while OUT sets a sticky wish to return, granted once b=1."""
    init = {"state": F.lit(1), "wants": F.lit(True)}

    def step(s, x):
        inside = s["state"] == 1
        out = inside & (x["a"] == 0)
        wants = s["wants"] | (x["a"] == 1)
        back = ~inside & wants & (x["b"] == 1)
        state = F.when(out, 0).when(back, 1).otherwise(s["state"])
        return {"state": state, "wants": F.when(out, False).when(inside, s["wants"]).otherwise(wants)}, state, F.lit("")

    return _fold(df, by, {"a": a, "b": b}, init, step)


def with_state(df: DataFrame, switches: DataFrame, name: str = "state", by=("symbol",), initial: int = 1) -> DataFrame:
    """Daily state from the switch log."""
    sw = switches.select(*by, "ts", F.col("state").alias("__sw"))
    d = df.join(sw, [*by, "ts"], "left")
    return d.withColumn(name, F.coalesce(F.last("__sw", True).over(upto(by)), F.lit(initial))).drop("__sw")


def in_out_returns(df: DataFrame, state: str, r: str = "r", cash: Column | None = None, by=("symbol",)) -> DataFrame:
    """Same-day-close execution: the day's return belongs to the state before the day's decision."""
    held = F.coalesce(F.lag(state).over(over(by)), F.lit(1))
    ret = F.coalesce(F.col(r), F.lit(0.0))
    return df.withColumn("sr", F.when(held == 1, ret).otherwise(F.lit(0.0) if cash is None else cash))


def leverage_returns(df: DataFrame, lev: Column, bps: float, r: str = "r", by=("symbol",), shift: int = 1) -> DataFrame:
    """Memoryless leverage: yesterday's leverage times today's return less turnover cost."""
    df = df.withColumn("__lev", lev)
    d = df.withColumn("lev", F.coalesce(F.lag("__lev", shift).over(over(by)), F.lit(1.0)) if shift else F.col("__lev"))
    turn = F.abs(F.col("lev") - F.coalesce(F.lag("lev").over(over(by)), F.col("lev")))
    return d.withColumn("sr", F.col("lev") * F.coalesce(F.col(r), F.lit(0.0)) - turn * (bps / 10000)).drop("__lev")
