"""Session helpers: one place for the settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # broadcast only on sizes measured at run time, never on estimates
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def calendar_sized(df: DataFrame) -> DataFrame:
    """Broadcast a table that holds at most a few rows per calendar day.

    Its size is bounded by the calendar (a century is 36,525 days), not by the data.
    """
    return F.broadcast(df)


def fan_join(fanned: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join whose left side was multiplied by an explode.

    Static size estimates do not see the multiplication and would broadcast the
    fanned side; the hint keeps it a shuffled join whatever the estimate says.
    """
    return fanned.join(other.hint("merge"), keys, how)


def spread(df: DataFrame, *cols) -> DataFrame:
    """Repartition small rows that carry heavy work.

    A fixed partition count keeps AQE from merging them by size: the bytes are
    few, the computation per row is not.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *cols)
