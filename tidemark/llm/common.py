"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where none is set, a session on one machine gets a private one (tests); a cluster gets an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tidemark-llm-")
        sc.setCheckpointDir(folder)
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder once and survive a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict[str, tuple[int, object]] = {}


def forget_other_stages() -> int:
    """In a task: drop what the worker process kept for other stages, so a long session's workers stay small."""
    context = TaskContext.get()
    stage = context.stageId() if context else -1
    for name in [n for n, (of, _) in _KEPT.items() if of != stage]:
        del _KEPT[name]
    return stage


def kept_in_worker(name: str, build):
    """In a task: what ``build`` gave the first task of this stage in this worker process."""
    stage = forget_other_stages()
    if name not in _KEPT:
        _KEPT[name] = (stage, build())
    return _KEPT[name][1]


def partitions(spark: SparkSession, rows: float = 0, per: float = 1) -> int:
    """Partition count: what the session sets, or more where ``rows`` at ``per`` each need it."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per)))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null. Every word start is a non-space that follows a space or the start."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


HASH_BITS = 60


def text_hash(text: Column) -> Column:
    """Uniform long in [0, 2**60) of a text, by the first hex digits of its MD5; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def ordered_hash(*cols) -> Column:
    """``text_hash`` of the values, joined by bars; null counts as ~."""
    return text_hash(F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("~")) for c in cols]))


def slice_of_hash(h: Column, slices: int) -> Column:
    """Which of equal ranges of hashes a hash lies in."""
    return F.floor(F.shiftright(h, 30) * slices / (1 << (HASH_BITS - 30)))


def running(df: DataFrame, group: list[str], order: list[Column], value: Column, slice_of: Column, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group``, without one task per group.

    ``slice_of`` is an integer that does not fall along ``order``; rows are
    summed per (group, slice), the slices of a group are added up in order, and
    only the rows of one slice are sorted together. Adds ``out`` and ``<out>_total``.
    """
    d = df.withColumn("_slice", slice_of).withColumn("_value", value)
    sums = d.groupBy(*group, "_slice").agg(F.sum("_value").alias("_sum"))
    w = Window.partitionBy(*group)
    before = F.sum("_sum").over(w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*group, "_slice", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_sum").over(w).alias(f"{out}_total"))
    inner = F.sum("_value").over(Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_inner", F.coalesce(inner, F.lit(0)))
    same = [d[c].eqNullSafe(sums[c]) for c in [*group, "_slice"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    keep = [d[c] for c in d.columns if c not in ("_slice", "_value", "_inner")]
    return d.join(sums, on).select(*keep, (F.col("_before") + F.col("_inner")).alias(out), sums[f"{out}_total"])
