"""Scalar building blocks shared by the operators (all Catalyst expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRADING_DAYS = 252


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """Missing is NULL, never NaN: ``NaN > x`` is TRUE in Spark and would fire triggers."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def nz(c) -> Column:
    """Denominator guard: zero becomes NULL, so the quotient is missing instead of an error."""
    c = col(c)
    return F.when(c != 0, c)


def parse_number(c, missing: str = ".") -> Column:
    """Text to DOUBLE; the sentinel and unparsable text become NULL."""
    return nan_to_null(F.nullif(F.trim(col(c)), F.lit(missing)).try_cast("double"))


def clip(c, lo: float, hi: float) -> Column:
    """Bound a value; NULL stays NULL (greatest/least would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def rounded(c, digits: int) -> Column:
    """``round`` half away from zero without leaving doubles.

    Spark's own goes through a decimal for every value, which was most of the time of a frame of many series. Beyond 2**52 a scaled
    value has no digits left to round. ``c`` should be a plain column: it is read several times.
    """
    scale = 10.0**digits
    v = col(c) * scale if digits else col(c)
    near = F.when(v < 0, -F.floor(F.lit(0.5) - v)).otherwise(F.floor(v + 0.5)).cast("double")
    return F.when(F.abs(v) < 2.0**52, near / scale if digits else near).otherwise(col(c))


def with_rounded(df: DataFrame, columns: dict[str, tuple]) -> DataFrame:
    """Add ``{name: (expr, digits)}``, every expression computed once."""
    keep = [c for c in df.columns if c not in columns]
    df = df.withColumns({f"__u_{n}": col(e) for n, (e, _) in columns.items()})
    return df.select(*keep, *[rounded(f"__u_{n}", k).alias(n) for n, (_, k) in columns.items()])


def null_if_zero(c) -> Column:
    return F.nullif(col(c), F.lit(0.0))


def one_if_zero(c) -> Column:
    return F.when(col(c) == 0, F.lit(1.0)).otherwise(col(c))


def trading_day(d) -> Column:
    """Roll weekend dates forward to Monday."""
    d = col(d)
    return F.date_add(d, F.greatest(F.lit(0), F.lit(7) - F.weekday(d)) * (F.weekday(d) >= 5).cast("int"))


def publication_tuesday(d) -> Column:
    """Friday of the observation's week plus four days."""
    d = col(d)
    return F.date_add(d, F.pmod(F.lit(4) - F.weekday(d), F.lit(7)) + 4)


def third_wednesday(d) -> Column:
    """First Wednesday on or after the 15th of the date's month."""
    return F.next_day(F.date_add(F.trunc(col(d), "month"), 13), "WE")


def target_year(d) -> Column:
    d = col(d)
    return F.year(d) + (F.month(d) >= 9).cast("int")


def decimal_year_date(x) -> Column:
    """1995.07 -> 1995-07-01; the month is clamped into 1..12."""
    x = col(x)
    y = F.floor(x).cast("int")
    m = F.round((x - y) * 100).cast("int")
    return F.make_date(y, F.greatest(F.lit(1), F.least(F.lit(12), m)), F.lit(1))


def week_ending(d, day: str) -> Column:
    """Label of the week that ends on ``day`` (``SU`` or ``FR``) and holds the date."""
    return F.next_day(F.date_sub(col(d), 1), day)


def month_end(d) -> Column:
    return F.last_day(col(d))


def quarter_end(d) -> Column:
    return F.last_day(F.add_months(F.trunc(col(d), "quarter"), 2))


def daily_rate_trading(pct) -> Column:
    return col(pct) / 100 / TRADING_DAYS


def daily_rate_calendar(pct) -> Column:
    return col(pct) / 36500


def compound_growth(x, base, power: int) -> Column:
    """Annualised growth in percent: three months to the 4th, one month to the 12th."""
    return (F.pow(col(x) / col(base), F.lit(power)) - 1) * 100


def tags(predicates: dict[str, Column]) -> Column:
    """Names of all predicates a row satisfies; a row may carry several."""
    arr = F.array(*[F.when(p, F.lit(n)) for n, p in predicates.items()])
    return F.filter(arr, lambda t: t.isNotNull())


def draw(*keys, n) -> Column:
    """Counter-based uniform draw in ``[0, n)`` from integer keys.

    Chained fifth powers modulo the prime 2**31 - 1 (a permutation of the
    residues, since 5 does not divide p - 1): plain BIGINT arithmetic, so it
    stays in generated code, replays after a lost executor and is the same in
    any SQL engine.
    """
    p = F.lit(2147483647).cast("long")
    h = F.lit(0).cast("long")
    for i, k in enumerate(keys):
        k = F.lit(k) if isinstance(k, int) else col(k)
        x = (h + k.cast("long") * 1000003 + 7919 * (i + 1)) % p
        x2 = (x * x) % p
        h = (((x2 * x2) % p) * x) % p
    return (h % (n if isinstance(n, Column) else F.lit(n))).cast("long")
