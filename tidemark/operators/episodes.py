"""Blocks (gaps and islands) and episodes with cool-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.latch import latch
from tidemark.operators.windows import over, upto


def with_block_id(df: DataFrame, flag: Column, by=("symbol",), order="ts") -> DataFrame:
    f = F.coalesce(flag, F.lit(False))
    df = df.withColumn("flag", f)
    change = F.coalesce(F.col("flag") != F.lag("flag").over(over(by, (order,))), F.lit(True))
    df = df.withColumn("__chg", change.cast("int"))
    return df.withColumn("block_id", F.sum("__chg").over(upto(by, (order,)))).drop("__chg")


def blocks(df: DataFrame, flag: Column, by=("symbol",), order="ts", min_rows: int = 1, aggs=()) -> DataFrame:
    """Maximal TRUE runs: start, end, rows, the first row after (``off_ts``) and whether still open."""
    b = with_block_id(df, flag, by, order).withColumn("__next", F.lead(order).over(over(by, (order,))))
    out = b.where("flag").groupBy(*by, "block_id").agg(
        F.min(order).alias("start_ts"), F.max(order).alias("end_ts"), F.count(F.lit(1)).alias("n_rows"),
        F.max_by("__next", order).alias("off_ts"), *aggs,
    )
    return out.withColumn("open_ended", F.col("off_ts").isNull()).where(F.col("n_rows") >= min_rows)


def cooled_episodes(df: DataFrame, flag: Column, gap_days: int, by=("symbol",), order="ts") -> DataFrame:
    """Blocks that start at least ``gap_days`` calendar days after the last OFF row.

    Suppressed blocks still move the last OFF row; a flag set on the first row
    starts an episode.
    """
    w = over(by, (order,))
    d = df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__was", F.coalesce(F.lag("__f").over(w), F.lit(False)))
    d = d.withColumn("__off", F.when(~F.col("__f") & F.col("__was"), F.col(order)))
    d = d.withColumn("last_off", F.last("__off", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.col("last_off").isNull() | (F.datediff(order, "last_off") >= gap_days)
    # the row that ends a kept episode: next OFF row after its start, or none while still on
    d = d.withColumn("off_ts", F.first("__off", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return d.where("__f and not __was").where(fresh).drop("__f", "__was", "__off")


def drawdown_episodes(df: DataFrame, price: str, enter: float, leave: float, by=("symbol",), order="ts") -> DataFrame:
    """Episodes from dd < enter until dd > leave with peak, trough and depth.

    Of equal lows the first is the trough, of equal highs the last is the peak: the order in which rows arrive decides neither.
    """
    run = upto(by, (order,))
    d = df.withColumn("__peak", F.max(price).over(run)).withColumn("dd", F.col(price) / F.col("__peak") - 1)
    d = d.withColumn("__pk_ts", F.max(F.when(F.col(price) == F.col("__peak"), F.col(order))).over(run))
    ev = F.when(F.col("dd") < enter, 1).when(F.col("dd") > leave, 0)
    d = d.withColumn("__on", latch(ev, by, (order,)) == 1)
    return blocks(
        d, F.col("__on"), by, order,
        aggs=[
            F.min("dd").alias("depth"), F.min(F.struct("dd", order))[order].alias("trough_ts"), F.min_by("__pk_ts", order).alias("peak_ts"),
        ],
    )
