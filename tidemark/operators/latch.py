"""Hysteresis latches and priority rules without loops.

A latch is the last ON/OFF event seen so far: ``last(event, ignorenulls)``. It is
exact whenever the trigger is beyond the recover level, which the variant grid
enforces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.expr import col
from tidemark.operators.windows import BY, ORDER, upto


def latch_event(x, trigger, recover, master=None, inverted: bool = False, on_null: str = "hold") -> Column:
    """1 = switch on, 0 = switch off, NULL = hold."""
    x = col(x)
    if on_null == "zero":
        x = F.coalesce(x, F.lit(0.0))
    trigger, recover = (t if isinstance(t, Column) else F.lit(t) for t in (trigger, recover))
    on, off = (x < trigger, x > recover) if inverted else (x > trigger, x < recover)
    ev = F.when(on, 1).when(off, 0)
    return ev if master is None else F.when(col(master) == 0, 0).otherwise(ev)


def latch(event: Column, by=BY, order=ORDER, initial: int = 0) -> Column:
    return F.coalesce(F.last(event, ignorenulls=True).over(upto(by, order)), F.lit(initial))


def priority(pairs: list[tuple[Column, object]], default) -> Column:
    """First matching condition wins."""
    out = None
    for cond, val in pairs:
        val = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))
