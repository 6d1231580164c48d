"""Projection records -> ENTER/EXIT signals -> daily master state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof, latest_per_key
from tidemark.operators.latch import latch


def with_previous(proj: DataFrame, by=()) -> DataFrame:
    """Current and previous meeting, both read for the *current* target year."""
    w = Window.partitionBy(*by, F.lit(0)).orderBy("meeting_date")
    p = proj.withColumn("__prev", F.lag(F.struct("target_year", "pce", "rate")).over(w)).where("__prev is not null")
    ty = F.col("target_year")
    return p.select(
        *by,
        "meeting_date",
        "target_year",
        (F.col("__prev.target_year") == ty).alias("same_ty"),
        F.try_element_at("pce", ty).alias("pce"),
        F.try_element_at("__prev.pce", ty).alias("prev_pce"),
        F.try_element_at("rate", ty).alias("rate"),
        F.try_element_at("__prev.rate", ty).alias("prev_rate"),
    )


def exit_condition(pce_floor=2.0, rate_step=0.0) -> Column:
    """Rate revised up by more than ``rate_step``, inflation above the floor and revised up."""
    floor, step = (x if isinstance(x, Column) else F.lit(x) for x in (pce_floor, rate_step))
    return (F.col("rate") - F.col("prev_rate") > step) & (F.col("pce") > floor) & (F.col("pce") > F.col("prev_pce"))


def enter_condition() -> Column:
    return (F.col("rate") <= F.col("prev_rate")) & F.col("prev_pce").isNotNull()


def alternating_signals(meetings: DataFrame, by=(), exit_c: Column | None = None, enter_c: Column | None = None) -> DataFrame:
    """Emit EXIT/ENTER only when they change the state; meetings without a pce value are skipped."""
    m = meetings.where("pce is not null")
    ev = F.when(exit_condition() if exit_c is None else exit_c, 0).when(enter_condition() if enter_c is None else enter_c, 1)
    part = (*by, F.lit(0))
    m = m.withColumn("state", latch(ev, part, ("meeting_date",), 1))
    before = F.coalesce(F.lag("state").over(Window.partitionBy(*part).orderBy("meeting_date")), F.lit(1))
    return m.withColumn(
        "signal",
        F.when(F.col("state") == before, "").when(F.col("state") == 1, "ENTER").otherwise("EXIT"),
    )


def daily_state(signals: DataFrame, cal: DataFrame, by=()) -> DataFrame:
    """State per calendar day: a signal acts on the first trading day at or after its date."""
    key = "__k"
    c = cal.withColumn(key, F.lit(0))
    keys = [*by, key]
    days = c.select(*keys, "ts").withColumn("use_on", F.col("ts"))
    ev = signals.where("signal <> ''").select(*by, F.lit(0).alias(key), F.col("meeting_date").alias("ts"), "meeting_date", "state")
    hit = asof(ev, days, keys, "ts", ["use_on"], "forward").where("use_on is not null")
    hit = latest_per_key(hit.select(*keys, F.col("use_on").alias("ts"), "meeting_date", "state"), keys + ["ts"], "meeting_date", ["state"])
    out = asof(c, hit, keys, "ts", ["state"])
    return out.withColumn("master", F.coalesce("state", F.lit(1))).drop("state", key)
