"""Shards that all have the mixture of the whole: proportional stratified interleaving.

Rows of each source are ranked in a seeded shuffle; a row's fractional rank
in its source is its place in the whole, so any stretch of the resulting order
holds every source in proportion. The order is cut into shards of equal row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SEED, durable, ordered_hash, running, slice_of_hash

#: Rows that are sorted together in one task
SLICE_ROWS = 8192
PLACES = 1 << 40


def interleaved(rows: DataFrame, source: str, keys: list[str], seed: int = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds ``position`` (0 to n - 1) of every row in the interleaved order.

    ``keys`` name columns that tell rows apart; equal rows take neighbouring
    places in any order. No source and no stretch of the order is sorted in
    one task: both rankings go by slices of a hash, whose counts are added up first.
    """
    d = rows.withColumn("_h", ordered_hash(F.lit(seed), *keys))
    n = d.count()
    slices = max(1, -(-n // slice_rows))
    one = F.lit(1).cast("long")
    d = running(d, [source], [F.col("_h"), *map(F.col, keys)], one, slice_of_hash(F.col("_h"), slices), "_rank")
    # each source starts at its own phase, else all sources with one row would fall on one place
    phase = ordered_hash(F.lit(seed + 1), source) % PLACES
    place = F.floor((F.col("_rank").cast("decimal(30,0)") * PLACES + phase) / F.col("_rank_total").cast("decimal(20,0)")).cast("long")
    d = durable(d.withColumn("_place", place).drop("_rank", "_rank_total"))
    d = d.withColumn("_all", F.lit(0))
    d = running(d, ["_all"], [F.col("_place"), F.col("_h"), *map(F.col, keys)], one, F.floor(F.col("_place") / PLACES * slices), "position")
    return d.drop("_h", "_place", "_all", "position_total").withColumn("_n", F.lit(n).cast("long"))


def shard(rows: DataFrame, shards: int, source: str = "source", keys: tuple[str, ...] = ("doc_id",), seed: int = SEED) -> DataFrame:
    """Adds ``position``, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Row counts of shards differ by one at most, and so does each source's
    count from its share of a shard, up to the rounding of both ends of the cut. A null source is a
    source of its own; null keys sort first; repeated rows take places next to each other;
    with fewer rows than shards some shards are empty; an empty table gives an empty result.
    Columns of these names are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = rows.drop("position", "shard", "slot")
    d = interleaved(rows, source, list(keys), seed)
    d = d.withColumn("shard", F.expr(f"cast(position * {shards} div _n as int)"))
    return d.withColumn("slot", F.expr(f"position - (shard * _n + {shards - 1}) div {shards}")).drop("_n")
