"""Nearest neighbours by inverted lists and an adaptive dimension scan.

Vectors are dealt to the lists of the nearest of some centroids. A query probes
its nearest lists. Inside a list, vectors are rotated at random and read in
blocks of columns; after each block a hypothesis test compares the scaled
partial distance with the query's bound and abandons candidates that are
too far in all likelihood. What is left is ranked by exact cosines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.capfilters import cosines, matrix, unit, valid_vectors
from tidemark.llm.common import SEED, durable, partitions

#: Rows that centroids and probes are fitted on
SAMPLE_ROWS = 16384
#: Part of the sample's true neighbours that lie in the probed lists
TARGET_RECALL = 0.985
#: Columns of a block, and the looseness of the test: a candidate is abandoned when its scaled distance is over (1 + LOOSE / sqrt(columns)) times the bound
COLUMNS, LOOSE = 16, 2.1
#: Candidates and queries of one list that meet in one task
LIST_BLOCK, QUERY_BLOCK = 4096, 1024
MAX_LISTS = 4096


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), c)
    return c


def _fit(sample: np.ndarray, rows: int, k: int, recall: float, seed: int) -> tuple[np.ndarray, int]:
    """Centroids, and how many lists must be probed to hold ``recall`` of the sample's true neighbours."""
    lists = int(min(MAX_LISTS, max(1, math.isqrt(rows)), len(sample)))
    c = _kmeans(sample, lists, seed)
    rng = np.random.default_rng(seed + 1)
    q = rng.choice(len(sample), size=min(256, len(sample)), replace=False)
    near = sample[q] @ sample.T
    near[np.arange(len(q)), q] = -np.inf
    top = np.argsort(-near, axis=1)[:, : min(k, max(len(sample) - 1, 1))]
    home = (sample @ c.T).argmax(axis=1)
    rank = np.argsort(np.argsort(-(sample[q] @ c.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, home[top], axis=1).ravel())
    return c, int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1


def scan(q: np.ndarray, x: np.ndarray, bound: np.ndarray, k: int, columns: int = COLUMNS, loose: float = LOOSE, own: np.ndarray | None = None) -> list[np.ndarray]:
    """Rows of ``x`` that each query keeps; all vectors rotated, of length one.

    ``bound`` is a squared distance that the k-th neighbour is known not to exceed;
    it falls as the scan goes on. ``own`` holds for each query the rows to leave out.
    """
    dim, kept = q.shape[1], []
    for i in range(len(q)):
        live, at = np.arange(len(x)), float(bound[i])
        if own is not None and len(own[i]):
            live = np.setdiff1d(live, own[i])
        part = np.zeros(len(live), dtype=x.dtype)
        for a in range(0, dim, columns):
            b = min(a + columns, dim)
            diff = x[live, a:b] - q[i, a:b]
            part = part + np.einsum("ij,ij->i", diff, diff)
            room = 1.0 if b == dim else (b / dim) * (1 + loose / math.sqrt(b)) ** 2
            stay = part <= at * room * (1 + 1e-5) + 1e-9
            live, part = live[stay], part[stay]
        if len(live) > k:
            near = np.partition(part, k - 1)[k - 1]
            live = live[part <= near * (1 + 1e-5) + 1e-6]
        kept.append(live)
    return kept


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = TARGET_RECALL, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found for each query.

    Score is the cosine in double precision on the vectors as given; ties go to the smaller id. Rows that
    share a query's id are its own and left out, rows with null ids are no queries and rank last in ties. Vectors that are
    null, empty, zero, or hold null or non-finite components take no part; queries see vectors of their
    own length only. A repeated row is one candidate. A query id given with several vectors asks with the smallest.
    Empty tables give empty results. Centroids and the number of probes come from a sample of ``sample_rows``
    rows by hash; every row is indexed, and only the lists that a query probes give its answers.
    """
    base = durable(valid_vectors(rows, id_col, vec_col).select("id", "vec"))
    asked = durable(valid_vectors(queries.where(F.col(id_col).isNotNull()), id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec")))
    out = None
    for dim in [r["n"] for r in asked.groupBy(F.size("vec").alias("n")).count().select("n").collect()]:
        one = _search(base.where(F.size("vec") == dim), asked.where(F.size("vec") == dim), k, dim, recall, sample_rows, seed)
        out = one if out is None else out.union(one)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out


def _search(base: DataFrame, asked: DataFrame, k: int, dim: int, recall: float, sample_rows: int, seed: int) -> DataFrame:
    spark = base.sparkSession
    n = base.count()
    first = base.select("id", "vec", F.xxhash64(F.lit(seed), "id", "vec").alias("h")).orderBy("h", "id").limit(sample_rows).toArrow()
    if not first.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]
    sample = (unit(matrix(first["vec"].combine_chunks())) @ rotation).astype(np.float32)
    centroids, probes = _fit(sample, n, k, recall, seed)
    fitted = spark.sparkContext.broadcast((rotation, centroids, probes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, c, _ = fitted.value
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                near = ((unit(matrix(b.column("vec"))) @ rotation).astype(np.float32) @ c.T).argmax(axis=1)
                yield pa.record_batch([*b.columns, pa.array(near.astype(np.int32))], names=["id", "vec", "list"])

    listed = durable(base.mapInArrow(deal, "id long, vec array<double>, list int"))
    # at most MAX_LISTS rows
    held = np.zeros(len(centroids), dtype=np.int64)
    for r in listed.groupBy("list").count().collect():
        held[r["list"]] = r["count"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest ``probes`` lists of each query that hold rows, and more where those hold no ``k`` rows besides its own."""
        rotation, c, probes = fitted.value
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                near = (unit(matrix(b.column("vec"))) @ rotation).astype(np.float32) @ c.T
                near[:, held == 0] = -np.inf
                lists = np.argsort(-near, axis=1, kind="stable")[:, : int((held > 0).sum())]
                before = np.cumsum(held[lists], axis=1) - held[lists]
                use = (np.arange(lists.shape[1])[None, :] < probes) | (before <= k)
                row, nth = np.nonzero(use)
                yield pa.record_batch([*(x.take(pa.array(row)) for x in b.columns), pa.array(lists[use].astype(np.int32)), pa.array(nth.astype(np.int32))], names=["id", "vec", "list", "nth"])

    probed = durable(asked.mapInArrow(probe, "id long, vec array<double>, list int, nth int"))

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(q) and len(x):
            rotation = fitted.value[0]
            qv, xv = np.stack(q["vec"].to_numpy()), np.stack(x["vec"].to_numpy())
            ids = x["id"].to_numpy(dtype=np.float64, na_value=np.nan) if x["id"].isna().any() else x["id"].to_numpy()
            mine = [np.flatnonzero(ids == i) for i in q["id"]]
            rq, rx = (unit(qv) @ rotation).astype(np.float32), (unit(xv) @ rotation).astype(np.float32)
            for i, rows in enumerate(scan(rq, rx, q["bound"].to_numpy(), k, own=mine)):
                if not len(rows):
                    continue
                score = cosines(xv[rows], np.broadcast_to(qv[i], (len(rows), dim)))
                known = x["id"].to_numpy()[rows]
                o = np.lexsort((np.where(pd.isna(known), np.inf, known).astype(np.float64) if pd.isna(known).any() else known, -score))[:k]
                out.append(pd.DataFrame({"query_id": q["id"].iloc[i], "vec_id": pd.array(known[o], dtype="Int64"), "score": score[o]}))
        if out:
            return pd.concat(out, ignore_index=True)
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="Int64"), "score": pd.Series(dtype="float64")})

    def met(probed: DataFrame) -> DataFrame:
        # blocks of hot lists: sizes come by list, at most MAX_LISTS rows
        sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / LIST_BLOCK).alias("cn"))
        wanted = probed.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("qn"))
        blocks = sizes.join(wanted, "list")
        every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        own = lambda c: F.pmod(F.xxhash64("id", "vec"), F.col(c))
        x = listed.join(F.broadcast(blocks), "list").select("list", own("cn").alias("cb"), every("qn").alias("qb"), "id", "vec")
        q = probed.join(F.broadcast(blocks), "list").select("list", every("cn").alias("cb"), own("qn").alias("qb"), "id", "vec", "bound")
        keys = ["list", "cb", "qb"]
        parts = partitions(spark)
        left, right = q.repartition(parts, *keys), x.repartition(parts, *keys)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    best = lambda rows: rows.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # the first bound is the k-th row met in the nearest list: that row is in the result itself
    first_met = durable(best(met(probed.where("nth = 0").withColumn("bound", F.lit(4.1)))).drop("rank"))
    bounds = first_met.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, 2 - 2 * F.min("score") + 1e-4).alias("kth"))
    rest = durable(probed.where("nth > 0").join(bounds, "id", "left").select("id", "vec", "list", F.coalesce("kth", F.lit(4.1)).alias("bound")))
    found = durable(best(first_met.union(met(rest))))
    # rows that repeat a query's id fill its lists but are no answers: such a query asks all lists
    short = asked.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
    lists = F.explode(F.array(*[F.lit(int(i)) for i in np.flatnonzero(held)]))
    again = durable(short.select("id", "vec", lists.alias("list"), F.lit(4.1).alias("bound")))
    if not again.isEmpty():
        found = best(found.drop("rank").union(met(again)))
    return found.select("query_id", "rank", "vec_id", "score")
