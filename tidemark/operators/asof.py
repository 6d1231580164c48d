"""Calendar alignment: exact, as-of backward/forward/nearest and lagged availability.

Spark has no as-of join. Observations and calendar rows are unioned and one
ordered window carries the last (or next) observation. ``bucket`` splits a hot
key: rows are windowed per (key, bucket) and a one-row-per-bucket summary carries
the value across bucket borders, so no task ever holds a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reindex(cal: DataFrame, obs: DataFrame, on=("symbol", "ts")) -> DataFrame:
    """Rows of the calendar; absent observations become NULL, off-calendar ones are lost."""
    return cal.join(obs, list(on), "left")


def latest_per_key(obs: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Keep the newest row per key; aggregates map-side instead of sorting each key."""
    top = F.max_by(F.struct(*values), F.col(order)).alias("__v")
    return obs.groupBy(*keys).agg(top).select(*keys, *[F.col(f"__v.{v}").alias(v) for v in values])


def asof(
    cal: DataFrame,
    obs: DataFrame,
    by: list[str],
    on: str,
    values: list[str],
    direction: str = "backward",
    strict: bool = False,
    obs_on: str | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Attach to each calendar row the closest observation at or before (after) it.

    ``obs_on`` names the output column for the matched observation date.
    ``bucket`` is a monotone function of ``on`` (for instance the month).
    """
    back = direction == "backward"
    rest = [c for c in cal.columns if c not in by + [on]]
    obs_first = back != strict
    payload = F.struct(*values, F.col(on).alias("__on"))
    left = cal.select(*by, on, F.struct(F.lit(1), *rest).alias("__row"), F.lit(None).alias("__obs"))
    right = obs.select(*by, on, F.lit(None).alias("__row"), payload.alias("__obs"))
    u = left.unionByName(right).withColumn("__tie", F.when(F.col("__row").isNull() == obs_first, 0).otherwise(1))
    part = list(by)
    if bucket is not None:
        u = u.withColumn("__b", bucket)
        part += ["__b"]
    w = Window.partitionBy(*part).orderBy(on, "__tie")
    if back:
        seen = F.last("__obs", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    else:
        seen = F.first("__obs", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    u2 = u.withColumn("__hit", seen).where(F.col("__row").isNotNull())
    if bucket is not None:
        pick = F.max_by if back else F.min_by
        edge = u.groupBy(*part).agg(pick("__obs", F.when(F.col("__obs").isNotNull(), F.col(on))).alias("__edge"))
        wb = Window.partitionBy(*by).orderBy("__b")
        if back:
            carry = F.last("__edge", True).over(wb.rowsBetween(Window.unboundedPreceding, -1))
        else:
            carry = F.first("__edge", True).over(wb.rowsBetween(1, Window.unboundedFollowing))
        edge = edge.select(*part, carry.alias("__carry"))
        u2 = u2.join(edge, part, "left").withColumn("__hit", F.coalesce("__hit", "__carry"))
    out = [F.col(f"__hit.{v}").alias(v) for v in values]
    if obs_on:
        out.append(F.col("__hit.__on").alias(obs_on))
    return u2.select(*by, on, *[F.col(f"__row.{c}").alias(c) for c in rest], *out)


def nearest(cal: DataFrame, obs: DataFrame, by: list[str], on: str, values: list[str], obs_on: str) -> DataFrame:
    """Closest observation in either direction; a tie goes to the later date."""
    pre, nxt = [f"__p_{v}" for v in values], [f"__n_{v}" for v in values]
    back = asof(cal, _renamed(obs, values, pre), by, on, pre, "backward", obs_on="__pd")
    both = asof(back, _renamed(obs, values, nxt), by, on, nxt, "forward", obs_on="__nd")
    dp, dn = F.datediff(on, "__pd"), F.datediff("__nd", on)
    use_next = dn.isNotNull() & (dp.isNull() | (dn <= dp))
    return both.select(
        *cal.columns,
        F.when(use_next, F.col("__nd")).otherwise(F.col("__pd")).alias(obs_on),
        *[F.when(use_next, F.col(n)).otherwise(F.col(p)).alias(v) for v, p, n in zip(values, pre, nxt)],
    )


def _renamed(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(old, new)))


def available_on_calendar(
    cal: DataFrame, obs: DataFrame, by: list[str], on: str, published: Column, values: list[str], strict: bool = False
) -> DataFrame:
    """Look-ahead-safe alignment.

    Each observation becomes usable on the first calendar day at or after its
    publication (strictly after if ``strict``); of several landing on one day the
    newest observation wins; the value then holds until the next one.
    """
    pub = obs.select(*by, F.col(on).alias("obs_date"), *values, published.alias(on))
    days = cal.select(*by, on).distinct().withColumn("use_on", F.col(on))
    landed = asof(pub, days, by, on, ["use_on"], "forward", strict).where("use_on is not null")
    newest = latest_per_key(landed.select(*by, F.col("use_on").alias(on), "obs_date", *values), by + [on], "obs_date", ["obs_date"] + values)
    return asof(cal, newest, by, on, ["obs_date"] + values)
