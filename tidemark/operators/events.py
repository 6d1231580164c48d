"""Event joins and outcome studies on trading-day positions.

Ranges over positions become bounded explodes (the range length is a parameter)
followed by equi-joins, so hot keys can be split by AQE and no range join or
cross join is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof
from tidemark.operators.windows import over
from tidemark.session import fan_join


def following_rows(events: DataFrame, rows: DataFrame, n: int, values: list[str], by=("symbol",), inclusive: bool = False) -> DataFrame:
    """For each event (with ``pos``) the next n rows of its series; adds ``k`` = rows ahead."""
    lo = 0 if inclusive else 1
    e = events.withColumn("k", F.explode(F.sequence(F.lit(lo), F.lit(lo + n - 1)))).withColumn("__p", F.col("pos") + F.col("k"))
    r = rows.select(*by, F.col("pos").alias("__p"), *values)
    return fan_join(e, r, [*by, "__p"]).drop("__p")


def nearest_event(bench: DataFrame, cand: DataFrame, before: int, after: int, by=("symbol",), cand_values=()) -> DataFrame:
    """Closest candidate within ``-before..+after`` positions of each benchmark event.

    The smallest |delay| wins, the earlier candidate on a tie. Found with two
    as-of passes: the nearest one is always the last at/before or the first after.
    """
    by, vals = list(by), list(cand_values)
    c = lambda tag: cand.select(*by, "pos", F.struct(F.col("pos").alias("p"), *vals).alias(tag))
    b = asof(bench, c("__lo"), by, "pos", ["__lo"], "backward")
    b = asof(b, c("__hi"), by, "pos", ["__hi"], "forward", strict=True)
    lo, hi = F.col("__lo.p") - F.col("pos"), F.col("__hi.p") - F.col("pos")
    lo_ok, hi_ok = lo >= -before, hi <= after
    use_lo = F.coalesce(lo_ok, F.lit(False)) & (~F.coalesce(hi_ok, F.lit(False)) | (-lo <= hi))
    hit = F.when(use_lo, F.col("__lo")).when(hi_ok, F.col("__hi"))
    return b.withColumn("__h", hit).select(
        *bench.columns, (F.col("__h.p") - F.col("pos")).alias("delay"), *[F.col(f"__h.{v}").alias(f"cand_{v}") for v in vals]
    )


def within_periods(ts: str, periods: list[tuple[str, str, str]]) -> Column:
    """Names of the (possibly overlapping) periods that hold the date; explode to join."""
    hits = F.array(*[F.when(F.col(ts).between(F.to_date(F.lit(a)), F.to_date(F.lit(b))), F.lit(n)) for n, a, b in periods])
    return F.filter(hits, lambda p: p.isNotNull())


def transitions(df: DataFrame, state: str, by=("symbol",), order="ts") -> DataFrame:
    """Rows where the 0/1 state changes; ``kind`` is 'exit' (1->0) or 'enter' (0->1)."""
    prev = F.lag(state).over(over(by, (order,)))
    kind = F.when((prev == 1) & (F.col(state) == 0), "exit").when((prev == 0) & (F.col(state) == 1), "enter")
    return df.withColumn("kind", kind).where("kind is not null")


def round_trips(events: DataFrame, values: list[str], by=("symbol",), order="ts") -> DataFrame:
    """Pair each exit with the next re-entry (NULL if the series ends while out)."""
    w = over(by, (order,))
    e = events.withColumn("__n", F.lead(F.struct("kind", order, *values)).over(w)).where("kind = 'exit'")
    ok = F.col("__n.kind") == "enter"
    return e.withColumns({f"entry_{v}": F.when(ok, F.col(f"__n.{v}")) for v in [order, *values]}).drop("__n")


def next_true(df: DataFrame, conditions: dict[str, Column], by=("symbol",), order: str = "pos") -> DataFrame:
    """For each row the position of the first later row at which a condition holds; one backward pass for all conditions."""
    later = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({name: F.min(F.when(c, F.col(order))).over(later) for name, c in conditions.items()})


def with_blocks(df: DataFrame, value: str, longest: int, by=("symbol",), order: str = "pos") -> DataFrame:
    """Adds ``__low`` and ``__high``: smallest and largest value over the 1, 2, 4, ... rows from each row on, up to ``longest`` rows.

    Each level joins two blocks of the level before, so a row costs log(longest) and all levels share one sort. Blocks that reach
    beyond the series hold what there is of it.
    """
    w = Window.partitionBy(*by).orderBy(order)
    levels = max(longest.bit_length(), 1)
    d = df.withColumn("__l0", F.col(value)).withColumn("__h0", F.col(value))
    for k in range(1, levels):
        half = 1 << (k - 1)
        d = d.withColumn(f"__l{k}", F.least(f"__l{k - 1}", F.lead(f"__l{k - 1}", half).over(w))).withColumn(f"__h{k}", F.greatest(f"__h{k - 1}", F.lead(f"__h{k - 1}", half).over(w)))
    arrays = [F.array(*[f"__{p}{k}" for k in range(levels)]).alias(n) for p, n in (("l", "__low"), ("h", "__high"))]
    return d.select(*df.columns, *arrays)


def range_extremes(spans: DataFrame, blocks: DataFrame, start: str, end: str, by=("symbol",), order: str = "pos") -> DataFrame:
    """Adds ``low`` and ``high`` over the rows from ``start`` to ``end``, both included: two overlapping blocks cover any span.

    ``blocks`` comes from ``with_blocks``; spans that are longer than it allows, or have no end, get NULL.
    """
    by = list(by)
    level = F.floor(F.log2((F.col(end) - F.col(start) + 1).cast("double")) + 1e-9).cast("int")
    s = spans.withColumn("__k", level).withColumn("__e", F.col(end) - F.expr("shiftleft(1L, __k)") + 1)
    b = blocks.select(*by, F.col(order).alias("__p"), "__low", "__high")
    s = s.join(b.withColumnsRenamed({"__p": start, "__low": "__la", "__high": "__ha"}), [*by, start], "left")
    s = s.join(b.withColumnsRenamed({"__p": "__e", "__low": "__lb", "__high": "__hb"}), [*by, "__e"], "left")
    at = lambda c: F.get(c, F.col("__k"))
    both = lambda f, a, b: F.when(at(a).isNotNull() & at(b).isNotNull(), f(at(a), at(b)))
    return s.withColumns({"low": both(F.least, "__la", "__lb"), "high": both(F.greatest, "__ha", "__hb")}).select(*spans.columns, "low", "high")


def virtual_trades(frame: DataFrame, pulse: Column, danger: Column, calm: Column, price: str, longest: int, ahead: tuple[int, ...] = (63, 126), by=("symbol",)) -> DataFrame:
    """A trade for every pulse: out at its close, back in by the rule that fits how late it comes.

    A pulse that meets ``danger`` is late and waits for the first later row out of danger. An early one goes in at the first of: new
    danger after a row out of it (its own row counts), or ``calm``; danger wins a tie. NULL conditions are neither. Without such a row
    the trade is open to the last row. Rows are found by backward running minima and equality, never by scanning ahead.
    Adds kind, entry (position), reason, out (return while out), avoided and missed (lowest and highest close while out against the exit), and after{n}.
    """
    by, w = list(by), Window.partitionBy(*by).orderBy("pos")
    d = frame.withColumn("__safe", ~danger)
    d = next_true(d, {"n_safe": F.col("__safe"), "n_danger": danger, "n_calm": calm}, by)
    d = d.withColumn("last", F.max("pos").over(Window.partitionBy(*by)))
    d = d.withColumns({f"after{n}": F.lead(price, n).over(w) / F.col(price) - 1 for n in ahead})
    d = with_blocks(d.withColumn("__danger", danger).withColumn("__pulse", pulse), price, longest, by)
    p = d.where("__pulse").select(*by, "ts", "pos", F.col(price).alias("exit_price"), "__danger", "__safe", "n_safe", "n_danger", "n_calm", "last")
    # a pulse with nothing known starts to watch for danger at the first safe row
    jump = d.select(*by, F.col("pos").alias("n_safe"), F.col("n_danger").alias("__after_safe"))
    p = p.join(jump, [*by, "n_safe"], "left")
    late = F.coalesce("__danger", F.lit(False))
    fresh = F.when(F.coalesce("__safe", F.lit(False)), F.col("n_danger")).otherwise(F.col("__after_safe"))
    entry = F.when(late, F.col("n_safe")).otherwise(F.least(fresh, F.col("n_calm")))
    reason = F.when(entry.isNull(), "still_out").when(late, "recovered").when(fresh.isNotNull() & (fresh <= F.coalesce("n_calm", fresh)), "new_danger").otherwise("calm")
    p = p.withColumn("kind", F.when(late, "late").otherwise("early")).withColumn("reason", reason).withColumn("entry", F.coalesce(entry, "last"))
    p = range_extremes(p, d, "pos", "entry", by)
    e = d.select(*by, F.col("pos").alias("entry"), F.col(price).alias("entry_price"), *[f"after{n}" for n in ahead])
    p = p.join(e, [*by, "entry"])
    of = lambda c: F.col(c) / F.col("exit_price") - 1
    return p.select(*by, "ts", "pos", "kind", "entry", "reason", of("entry_price").alias("out"), of("low").alias("avoided"), of("high").alias("missed"), *[f"after{n}" for n in ahead])
