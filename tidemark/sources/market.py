"""Adaptors from the star-schema tables to market-shaped tables.

Every adaptor first reduces raw rows to one row per (series, day) with sums,
minima and maxima - partial aggregates that combine map-side, so a symbol that
owns a third of all rows costs a few thousand rows after the scan. From there
on a series is bounded by the calendar, which is what makes per-series windows
and folds safe at any table size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import trading_day, with_rounded

SYMBOL = {
    "flag": lambda: F.concat("l_returnflag", "l_linestatus"),
    "supplier": lambda: F.concat(F.lit("S"), F.col("l_suppkey").cast("string")),
}


# Explicit schemas: no footer inference when a query is built.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def day_totals(spark: SparkSession, sf_dir: str, by: str = "flag") -> DataFrame:
    """lineitem at (symbol, trading day) grain, order-free exact totals."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    whole = {"cents": "l_extendedprice", "pct_discount": "l_discount", "pct_tax": "l_tax"}
    return (
        with_rounded(table(spark, sf_dir, "lineitem"), {n: (F.col(c) * 100, 0) for n, c in whole.items()})
        .groupBy(SYMBOL[by]().alias("symbol"), trading_day(F.col("l_shipdate").cast("date")).alias("ts"))
        .agg(
            F.sum(F.col("cents").cast("long")).alias("cents"),
            F.sum("l_quantity").alias("qty"),
            F.min(unit).alias("lo"),
            F.max(unit).alias("hi"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("pct_discount").cast("long")).alias("disc"),
            F.sum(F.col("pct_tax").cast("long")).alias("tax"),
        )
    )


def bars(spark: SparkSession, sf_dir: str, by: str = "flag") -> DataFrame:
    """One bar per (symbol, ts): open, close, adj_close plus day totals.

    Unit prices are noise around a level, so they are standardised per symbol
    and compounded into a price path that behaves like an instrument.
    """
    d = (
        day_totals(spark, sf_dir, by)
        .withColumn("px_close", F.col("cents") / 100.0 / F.col("qty"))
        .withColumn("px_open", (F.col("lo") + F.col("hi")) / 2)
    )
    # one ordering for the whole-series and the running frames: a single sort
    w = Window.partitionBy("symbol").orderBy("ts")
    whole, run = (w.rowsBetween(Window.unboundedPreceding, end) for end in (Window.unboundedFollowing, 0))
    moments = {f"{n}_{p}": (f(f"px_{p}").over(whole), 6) for n, f in (("mu", F.avg), ("sd", F.stddev_samp)) for p in ("open", "close")}
    d = with_rounded(d, moments)
    # a series with one bar or one price has no spread: it stays flat
    spread = lambda p: F.nullif(F.col(f"sd_{p}"), F.lit(0.0))
    scaled = lambda p, k: F.coalesce(F.lit(k) * (F.col(f"px_{p}") - F.col(f"mu_{p}")) / spread(p), F.lit(0.0))
    d = with_rounded(d, {"g": (scaled("open", 0.004), 8), "i": (scaled("close", 0.006), 8)})
    d = with_rounded(d, {"step": (F.log((1 + F.col("g")) * (1 + F.col("i"))), 10)}).withColumn("step", F.col("step").cast("decimal(18,10)"))
    d = with_rounded(d, {"close": (F.lit(100.0) * F.exp(F.sum("step").over(run).cast("double")), 6)})
    adjusted = F.col("close") * (1 - 0.001 * (F.col("disc") / (100.0 * F.col("n"))))
    d = with_rounded(d, {"open": (F.col("close") / (1 + F.col("i")), 6), "adj_close": (adjusted, 6)})
    return d.select(
        "symbol",
        "ts",
        F.row_number().over(w).alias("pos"),
        "open",
        "close",
        "adj_close",
        "n",
        "qty",
        (F.col("disc") / (100.0 * F.col("n"))).alias("disc"),
        (F.col("tax") / (100.0 * F.col("n"))).alias("tax"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as dated observations (percent, 0..5) on their own calendar.

    Weekend dates stay: they are off the trading calendar on purpose.
    """
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)).alias("series_id"),
            F.col("o_orderdate").cast("date").alias("ts"),
        )
        .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("c"), F.count(F.lit(1)).alias("k"))
        .select("series_id", "ts", (F.col("c") / (F.col("k") * 1e7)).alias("value"))
    )


RATE_SERIES = ("P1", "P2", "P3")


def series_of_symbol(symbol="symbol") -> Column:
    """Observation series that belongs to a symbol."""
    flag = F.substring(symbol, 1, 1)
    return F.when(flag == "A", "P1").when(flag == "R", "P2").otherwise("P3")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading calendar with positions; one row per day, from a one-column scan."""
    day = trading_day(F.col("l_shipdate").cast("date"))
    one = table(spark, sf_dir, "lineitem").select(day.alias("ts")).distinct().withColumn("cal_id", F.lit("X"))
    return one.withColumn("pos", F.row_number().over(Window.partitionBy("cal_id").orderBy("ts")))


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly projection records (meeting_date, target_year, pce/rate maps) from orders.

    Horizon ``j`` years ahead is read from order priority ``j + 1``; the middle
    of the quarter's last month plays the meeting date.
    """
    o = table(spark, sf_dir, "orders").select(
        F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("q"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("p"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("c"),
        (F.col("o_orderstatus") == "F").cast("long").alias("f"),
    )
    level = lambda p, top, den, scale: F.when(
        F.sum(F.when(F.col("p") == p, den)) > 0,
        F.round(F.sum(F.when(F.col("p") == p, top)) / F.sum(F.when(F.col("p") == p, den)) / scale, 4),
    )
    one = F.lit(1).cast("long")
    g = o.groupBy("q").agg(
        *[level(j + 1, F.col("c"), one, 1.25e7).alias(f"pce{j}") for j in range(4)],
        *[level(j + 1, F.col("f"), one, 0.1).alias(f"rate{j}") for j in range(4)],
    )
    m = F.date_add(F.add_months("q", 2), 14)
    g = g.withColumn("meeting_date", m).withColumn("y", F.year(m))
    years = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.col("y") + j)
    return g.select(
        "meeting_date",
        (F.col("y") + (F.month("meeting_date") >= 9).cast("int")).alias("target_year"),
        F.map_from_arrays(years, F.array(*[f"pce{j}" for j in range(4)])).alias("pce"),
        F.map_from_arrays(years, F.array(*[f"rate{j}" for j in range(4)])).alias("rate"),
    )
