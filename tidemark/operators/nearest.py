"""Exact nearest join on several features.

Points are listed under the nearest of a few pivots, in rings of the distance to it. The distances from a query to
all pivots, with the smallest ring distances of every pivot's own points, bound how far its k-th neighbour can be.
By the triangle inequality that bound leaves a range of rings of each cell, and rows meet in those only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import fan_join

#: Rounding of distances that the bounds allow for
SLACK = 1e-9


def squared_distance(a: Column, b: Column) -> Column:
    """Sum over features, in their order, of squared differences."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def _pivots(points: DataFrame, by: list[str], n: int) -> DataFrame:
    """Per key up to ``n`` points by hash, as one array."""
    first = Window.partitionBy(*by).orderBy(F.xxhash64("__v"), "__v")
    p = points.select(*by, "__v").distinct().withColumn("__i", F.row_number().over(first)).where(F.col("__i") <= n)
    return p.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda x: x["__v"]).alias("__pivots"))


def _to_pivots(df: DataFrame, pivots: DataFrame, by: list[str]) -> DataFrame:
    d = df.join(pivots, by)
    return d.withColumn("__d", F.transform("__pivots", lambda p: F.sqrt(squared_distance(p, F.col("__v"))))).drop("__pivots")


def nearest_join(queries: DataFrame, points: DataFrame, xs: list[str], k: int, by: list[str], id_col: str = "pos", carry: tuple[str, ...] = (), pivots: int = 24, rings: int = 64) -> DataFrame:
    """(by, id, rank, neighbour, d2, carry): the ``k`` points of a query's key nearest in Euclidean distance.

    d2 is the squared distance; ties go to the smaller point id. Rows with a null feature take no part, a key with fewer
    points gives all of them. Of points with equal features only the ``k`` smallest ids can be neighbours, so
    a crowd of equal points is k rows. Cells hold rings of equal width up to the farthest point of the key.
    """
    vector = F.array(*[F.col(x).cast("double") for x in xs])
    full = lambda d: d.na.drop("any", subset=xs).withColumn("__v", vector)
    p = full(points).select(*by, F.col(id_col).alias("__p"), "__v", *[F.col(c).alias(f"__c_{c}") for c in carry])
    p = p.withColumn("__i", F.row_number().over(Window.partitionBy(*by, "__v").orderBy("__p"))).where(F.col("__i") <= k).drop("__i")
    piv = _pivots(p, by, pivots)
    p = _to_pivots(p, piv, by).withColumn("__r", F.array_min("__d"))
    p = p.withColumn("__cell", F.array_position("__d", F.col("__r")).cast("int") - 1).drop("__d")

    in_cell = Window.partitionBy(*by, "__cell")
    near = p.select(*by, "__cell", "__r", "__p").withColumn("__i", F.row_number().over(in_cell.orderBy("__r", "__p"))).where(F.col("__i") <= k)
    near = near.groupBy(*by, "__cell").agg(F.array_sort(F.collect_list("__r")).alias("near"))
    span = p.groupBy(*by, "__cell").agg(F.min("__r").alias("low"), F.max("__r").alias("high"))
    cells = span.join(near, [*by, "__cell"]).groupBy(*by).agg(F.collect_list(F.struct(F.col("__cell").alias("cell"), "low", "high", "near")).alias("__cells"))
    cells = cells.withColumn("__width", F.greatest(F.array_max(F.transform("__cells", lambda c: c["high"])) / rings, F.lit(SLACK)))
    p = p.join(cells.select(*by, "__width"), by).withColumn("__ring", F.floor(F.col("__r") / F.col("__width"))).drop("__width", "__r")

    q = full(queries).select(*by, F.col(id_col), "__v")
    q = _to_pivots(q, piv, by).join(cells, by)
    reach = F.array_sort(F.flatten(F.transform("__cells", lambda c: F.transform(c["near"], lambda r: r + F.get(F.col("__d"), c["cell"])))))
    bound = F.coalesce(F.get(reach, F.lit(k - 1)), F.lit(float("inf"))) * (1 + SLACK) + SLACK
    q = q.withColumn("__bound", bound)
    can = F.filter("__cells", lambda c: (F.get(F.col("__d"), c["cell"]) - c["high"] <= F.col("__bound")) & (c["low"] - F.get(F.col("__d"), c["cell"]) <= F.col("__bound")))
    q = q.withColumn("__c", F.explode(can)).withColumn("__dc", F.get("__d", F.col("__c.cell"))).drop("__cells", "__d")
    low = F.floor(F.greatest(F.col("__c.low"), F.col("__dc") - F.col("__bound")) / F.col("__width"))
    high = F.floor(F.least(F.col("__c.high"), F.col("__dc") + F.col("__bound")) / F.col("__width"))
    q = q.select(*by, id_col, "__v", "__bound", F.col("__c.cell").alias("__cell"), F.explode(F.sequence(low, F.greatest(low, high))).alias("__ring"))
    met = fan_join(q, p.withColumnRenamed("__v", "__w"), [*by, "__cell", "__ring"])
    met = met.withColumn("d2", squared_distance(F.col("__v"), F.col("__w"))).where(F.sqrt("d2") <= F.col("__bound"))
    rank = F.row_number().over(Window.partitionBy(*by, id_col).orderBy("d2", "__p"))
    met = met.withColumn("rank", rank).where(F.col("rank") <= k)
    return met.select(*by, id_col, "rank", F.col("__p").alias("neighbour"), "d2", *[F.col(f"__c_{c}").alias(c) for c in carry])
