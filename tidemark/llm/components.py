"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable


def _large_star(e: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the smallest one."""
    both = e.union(e.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the smallest one."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.toDF("a", "b")).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) longs -> (id, component): the smallest id that each linked id reaches.

    Alternating stars; every round is checkpointed, so lineage stays short and
    a lost executor costs one round. Sums per node combine before they are
    shuffled, and a hub with many neighbours is split by the skew join. Ids
    without a link to another id are not returned.
    """
    e = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = durable(e)
    state = _state(e)
    while state[0]:
        e = durable(_small_star(_large_star(e)))
        now = _state(e)
        if now == state:
            break
        state = now
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
