"""Embedding near-duplicates by spherical-cap filters.

Vectors are rotated and split into blocks. Each block has a random code of
unit vectors; a filter is one code word from every block, and its direction
their sum. A vector is listed under every filter whose direction it exceeds
the cap's height at: a list decoding over sorted block products
finds those filters without trying all. Close vectors share filters, are met there by
sketches, and verified in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SEED, durable, partitions
from tidemark.llm.components import connected_components

THRESHOLD = 0.9
#: Filters that two vectors at the threshold share on average: a pair is lost when it shares none
SHARED_FILTERS = 22.0
#: Independent product codes that the filters are dealt over
CODES = 4
#: Random neighbours that a vector may meet over all its filters
RANDOM_MEETINGS = 512.0
#: Vectors within this part of the threshold's angle from their leader, and with its nearest code words, form a class; all of a class link
CLASS_PART = 0.4
#: Entries of one filter, or members of one class, that meet in one task
BLOCK = 2048
SKETCH_WORDS = 4


def _beyond(heights: np.ndarray, dim: int) -> np.ndarray:
    """P(a coordinate of a random point of the unit sphere exceeds each height)."""
    x = np.linspace(-1, 1, 20001)
    y = np.maximum(1 - x * x, 0) ** max((dim - 3) / 2, 0)
    up = np.concatenate([[0], np.cumsum((y[1:] + y[:-1]) / 2)])
    return np.interp(heights, x, 1 - up / up[-1])


def _both(height: float, rho: float, dim: int) -> float:
    """P(both of two vectors with cosine ``rho`` exceed the height of a cap)."""
    u = np.linspace(height, 1, 2001)[:-1]
    x = np.linspace(-1, 1, 20001)
    norm = (np.maximum(1 - x * x, 0) ** max((dim - 3) / 2, 0)).sum() * (x[1] - x[0])
    density = (1 - u * u) ** max((dim - 3) / 2, 0) / norm
    other = _beyond((height - rho * u) / np.sqrt((1 - rho * rho) * (1 - u * u)), max(dim - 1, 2))
    return float((density * other).sum() * (u[1] - u[0]))


@dataclass
class CapFilters:
    """Random product codes: ``books[c][b]`` is the code book of block b in code c, under a rotation of its own."""

    height: float
    rotations: list[np.ndarray]
    books: list[list[np.ndarray]]
    planes: np.ndarray

    @classmethod
    def plan(cls, dim: int, rows: int, rho: float = THRESHOLD, shared: float = SHARED_FILTERS, random_meetings: float = RANDOM_MEETINGS, codes: int = CODES, seed: int = SEED) -> CapFilters:
        """The lowest caps, and as many filters, that keep random meetings per vector near the bound at ``rows`` rows."""
        for t in np.arange(2.0, 7.01, 0.125):
            height = float(t) / math.sqrt(dim)
            if height >= rho:
                break
            count = shared / _both(height, rho, dim)
            if rows * count * float(_beyond(np.array(height), dim)) ** 2 <= random_meetings:
                break
        else:
            height = float(t) / math.sqrt(dim)
        height = min(height, 0.9 * rho)
        count = min(shared / max(_both(height, rho, dim), 1e-12), 1e12) / codes
        blocks = next((m for m in range(2, dim + 1) if count ** (1 / m) <= 1024), dim) if dim > 1 else 1
        words = max(2, math.ceil(count ** (1 / blocks)))
        rng = np.random.default_rng(seed)
        edges = np.linspace(0, dim, blocks + 1).astype(int)
        rotations, books = [], []
        for _ in range(codes):
            rotations.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0])
            code = []
            for a, b in zip(edges[:-1], edges[1:]):
                c = rng.standard_normal((words, b - a))
                # all directions of full filters have length one
                code.append(c / np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt((b - a) / dim))
            books.append(code)
        return cls(height, rotations, books, rng.standard_normal((dim, SKETCH_WORDS * 64)))

    def products(self, x: np.ndarray, c: int) -> list[np.ndarray]:
        r = x @ self.rotations[c]
        edges = np.cumsum([0, *(b.shape[1] for b in self.books[c])])
        return [r[:, i:j] @ b.T for i, j, b in zip(edges[:-1], edges[1:], self.books[c])]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The nearest code word of every block of the first code as one number."""
        key = np.zeros(len(x), dtype=np.int64)
        for p in self.products(x, 0):
            key = (key * 1_000_003 + p.argmax(axis=1)) & ((1 << 62) - 1)
        return key

    def filters_of(self, x: np.ndarray) -> list[np.ndarray]:
        """All filters of each vector, over all codes."""
        out: list[list[np.ndarray]] = [[] for _ in range(len(x))]
        for c, books in enumerate(self.books):
            size = math.prod(len(b) for b in books)
            products = self.products(x, c)
            for i, found in enumerate(out):
                found.append(self.decode(products, i) + c * size)
        return [np.concatenate(f) for f in out]

    def decode(self, products: list[np.ndarray], i: int) -> np.ndarray:
        """All filters whose direction exceeds the height at vector ``i``."""
        best_after = np.concatenate([np.cumsum([p[i].max() for p in products][::-1])[::-1][1:], [0.0]])
        sums, ids = np.zeros(1), np.zeros(1, dtype=np.int64)
        for p, rest in zip(products, best_after):
            v = p[i]
            # code words in falling order: a partial sum takes a prefix of them
            order = np.argsort(-v)
            need = self.height - rest - sums
            take = np.searchsorted(-v[order], -need, side="right")
            live = take > 0
            sums, ids, take = sums[live], ids[live], take[live]
            rep = np.repeat(np.arange(len(sums)), take)
            inner = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)
            sums, ids = sums[rep] + v[order][inner], ids[rep] * len(v) + order[inner]
        return ids

    def sketch(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.planes > 0, axis=1).view(np.uint64)


def sketch_limit(rho: float) -> int:
    """Differing sketch bits that a pair at the threshold, its class radii included, stays under but for one in millions."""
    p = math.degrees(math.acos(rho)) / 180
    n = SKETCH_WORDS * 64
    return math.ceil(n * p + 6 * math.sqrt(n * p * (1 - p)))


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct (id, vec) with their count ``n``; null, empty, zero and non-finite vectors and null components are left out."""
    v = F.col("vec")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    d = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return d.where(v.isNotNull() & fine).groupBy("id", "vec").agg(F.count("*").alias("n"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row in double precision; the value depends on the two rows alone."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _by_dim(d: DataFrame):
    return [r["k"] for r in d.groupBy(F.size("vec").alias("k")).count().select("k").collect()]


def _classes(d: DataFrame, filters: CapFilters, rho: float) -> DataFrame:
    """(uid, id, vec, n, leader, leader_vec, angle): vectors within a few degrees of the leader of their code words join it, others lead themselves."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([*b.columns, pa.array(filters.nearest(unit(matrix(b.column("vec")))))], names=[*b.schema.names, "code"])

    coded = d.mapInArrow(code, "uid long, id long, vec array<double>, n long, code long")
    lead = coded.groupBy("code").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "uid", "vec")).alias("l"))
    lead = lead.select("code", F.col("l.uid").alias("lu"), F.col("l.vec").alias("lv"))
    dot = F.aggregate(F.zip_with("vec", "lv", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, b: a + b * b))
    cos = dot / (norm("vec") * norm("lv"))
    angle = F.when(F.col("lu") == F.col("uid"), 0.0).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))
    j = coded.join(lead, "code").withColumn("angle", angle)
    near = F.col("angle") <= CLASS_PART * math.degrees(math.acos(rho))
    return j.select("uid", "id", "vec", "n", F.when(near, F.col("lu")).otherwise(F.col("uid")).alias("leader"), F.when(near, F.col("lv")).otherwise(F.col("vec")).alias("leader_vec"), F.when(near, F.col("angle")).otherwise(0.0).alias("angle"))


def _listed(filters: CapFilters):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                x = unit(matrix(b.column("vec")))
                ids, sketch = filters.filters_of(x), filters.sketch(unit(matrix(b.column("leader_vec"))))
                n = [len(k) for k in ids]
                rep = np.repeat(np.arange(len(x)), n)
                uid = b.column("leader").to_numpy(zero_copy_only=False)[rep]
                blob = pa.array([s.tobytes() for s in sketch], type=pa.binary()).take(pa.array(rep))
                yield pa.record_batch([pa.array(np.concatenate(ids)), pa.array(uid), blob], names=["filter", "uid", "sketch"])

    return listed


def _meet(limit: int):
    """Pairs of one filter, or of two blocks of it, whose sketches are close."""

    def pairs(uid: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        out = []
        for k in range(len(uid) - 1):
            near = np.bitwise_count(sketch[k + 1 :] ^ sketch[k]).sum(axis=1, dtype=np.int64) <= limit
            if near.any():
                v = uid[k + 1 :][near]
                out.append(np.stack([np.full(len(v), uid[k]), v], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)

    def settle(cols: list[np.ndarray], sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(sketch), dtype=bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols[:-1]], axis=0)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(new)))
        uid, found = cols[-1], []
        small = sizes <= 32
        # small filters all at once, by distance in the list
        size_of = np.repeat(np.where(small, sizes, 0), sizes)
        at = np.arange(len(new)) - np.repeat(starts, sizes)
        for step in range(1, 32):
            i = np.flatnonzero(at + step < size_of)
            if not len(i):
                break
            near = np.bitwise_count(sketch[i] ^ sketch[i + step]).sum(axis=1, dtype=np.int64) <= limit
            found.append(np.stack([uid[i[near]], uid[i[near] + step]], axis=1))
        for s, n in zip(starts[~small], sizes[~small]):
            found.append(pairs(uid[s : s + n], sketch[s : s + n]))
        p = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
        p = np.unique(np.sort(p, axis=1), axis=0)
        yield pa.record_batch([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["filter", "i", "j", "uid"]
        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]
            sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), dtype=np.uint64).reshape(-1, SKETCH_WORDS)
            if kept:
                cols, sketch = [np.concatenate([k, c]) for k, c in zip(kept[0], cols)], np.concatenate([kept[1], sketch])
            open_ = np.all([c == c[-1] for c in cols[:-1]], axis=0)
            done = int(np.flatnonzero(~open_)[-1]) + 1 if not open_.all() else 0
            if done:
                yield from settle([c[:done] for c in cols], sketch[:done])
            kept = ([c[done:] for c in cols], sketch[done:])
        if kept:
            yield from settle(*kept)

    return meet


def _candidates(members: DataFrame, filters: CapFilters, rho: float, block: int) -> DataFrame:
    """Distinct (a, b) of leaders whose classes share a filter and whose own sketches are close.

    A class is listed once under every filter of any of its members, so it meets what its members would meet.
    """
    n = partitions(members.sparkSession)
    reach = math.degrees(math.acos(rho)) * (1 + 2 * CLASS_PART)
    listed = members.mapInArrow(_listed(filters), "filter long, uid long, sketch binary")
    listed = durable(listed.groupBy("filter", "uid").agg(F.min("sketch").alias("sketch")))
    large = listed.groupBy("filter").agg(F.count("*").alias("m")).where("m > 1")
    met = listed.join(large, "filter")
    blocks = F.ceil(F.col("m") / block)
    met = met.select("filter", "uid", "sketch", F.pmod(F.xxhash64("uid"), blocks).alias("o"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("p"))
    met = met.select("filter", F.least("o", "p").alias("i"), F.greatest("o", "p").alias("j"), "uid", "sketch")
    group = ["filter", "i", "j"]
    met = met.repartition(n, *group).sortWithinPartitions(*group)
    return met.mapInArrow(_meet(sketch_limit(math.cos(math.radians(reach)))), "a long, b long").distinct()


def _pair_cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b) -> adds cos."""

    def cos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = cosines(matrix(b.column("va")), matrix(b.column("vb")))
                yield pa.record_batch([*b.columns[:-2], pa.array(c)], names=[*b.schema.names[:-2], "cos"])

    v = vectors.select(F.col("uid"), "vec")
    j = pairs.join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b")
    keep = [c for c in pairs.columns if c not in ("va", "vb")]
    schema = ", ".join(f"{c} {t}" for c, t in pairs.dtypes)
    return j.select(*keep, "va", "vb").mapInArrow(cos, f"{schema}, cos double")


def near_duplicate_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", rho: float = THRESHOLD, shared: float = SHARED_FILTERS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    n_links counts the other rows at a cosine of ``rho`` or more that the
    filters find; none below is counted. Null, empty, zero and non-finite vectors and those with null
    components link with nothing, and vectors of different lengths don't either. A repeated row links with its
    copies. component_id is the smallest id reachable; null ids come last. An empty table gives an empty result.

    A hot group of nearly equal vectors is one class with a leader. If the
    angle of two leaders, with the radii of their classes added or taken off, lies clear of the
    threshold, all or none of their members link; only classes in between are compared
    member by member.
    """
    base = durable(valid_vectors(rows, id_col, vec_col).withColumn("uid", F.monotonically_increasing_id()))
    dims = _by_dim(base)
    total = None
    for k in dims:
        one = _one_dim(base.where(F.size("vec") == k), k, rho, shared, block, seed)
        total = one if total is None else total.union(one)
    if total is None:
        total = rows.sparkSession.createDataFrame([], "id long, vec array<double>, n_links long, component_id long")
    d = rows.withColumn("_id", F.col(id_col)).withColumn("_vec", F.col(vec_col).cast("array<double>"))
    out = total.withColumnRenamed("component_id", "_component")
    j = d.join(out, d["_id"].eqNullSafe(out["id"]) & (d["_vec"] == out["vec"]), "left")
    component = F.coalesce("_component", "_id")
    return j.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def _one_dim(base: DataFrame, dim: int, rho: float, shared: float, block: int, seed: int) -> DataFrame:
    filters = CapFilters.plan(dim, base.count(), rho, shared, RANDOM_MEETINGS, CODES, seed)
    members = durable(_classes(base.select("uid", F.col("id").cast("long").alias("id"), "vec", "n"), filters, rho))
    classes = members.groupBy("leader").agg(F.max("angle").alias("radius"), F.sum("n").alias("size"), F.min("id").alias("least"))
    leaders = members.where("uid = leader").select("uid", "leader", "vec").join(classes, "leader")
    leaders = durable(leaders)
    pairs = _pair_cosines(_candidates(members.select("leader", "vec", "leader_vec"), filters, rho, block), leaders)
    side = leaders.select("uid", "radius", "size")
    pairs = pairs.join(side.toDF("a", "ra", "na"), "a").join(side.toDF("b", "rb", "nb"), "b")
    limit = math.degrees(math.acos(rho))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cos")))))
    slack = F.col("ra") + F.col("rb") + F.when((F.col("ra") > 0) | (F.col("rb") > 0), 1e-6).otherwise(0.0)
    alone = (F.col("na") == 1) & (F.col("nb") == 1) | (F.col("ra") + F.col("rb") == 0)
    verdict = F.when(alone, F.when(F.col("cos") >= rho, "all").otherwise("none")).when(angle + slack < limit, "all").when(angle - slack > limit, "none").otherwise("some")
    pairs = durable(pairs.withColumn("verdict", verdict).where("verdict <> 'none'"))
    whole = pairs.where("verdict = 'all'")
    degrees = whole.select(F.col("a").alias("leader"), F.col("nb").alias("k")).union(whole.select("b", "na")).groupBy("leader").agg(F.sum("k").alias("k"))
    # classes in between: members of both in blocks
    some = pairs.where("verdict = 'some'").select("a", "b")
    m = members.select("leader", "uid", "n")
    cross = some.join(m.toDF("a", "ua", "wa"), "a").join(m.toDF("b", "ub", "wb"), "b")
    cross = cross.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("ua").alias("a"), F.col("ub").alias("b"), "wa", "wb")
    linked = durable(_pair_cosines(cross, members.select("uid", "vec")).where(F.col("cos") >= rho))
    more = linked.select(F.col("a").alias("uid"), F.col("wb").alias("k2")).union(linked.select("b", "wa")).groupBy("uid").agg(F.sum("k2").alias("k2"))
    edges = whole.select("a", "b").union(linked.select("ca", "cb").distinct())
    found = connected_components(edges).withColumnRenamed("id", "leader")
    named = classes.join(found, "leader", "left").withColumn("label", F.coalesce("component", "leader"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").join(degrees, "leader", "left").select("leader", "size", "component_id", "k")
    out = members.join(named, "leader").join(more, "uid", "left")
    n_links = F.col("size") - 1 + F.coalesce("k", F.lit(0)) + F.coalesce("k2", F.lit(0))
    return out.select("id", "vec", n_links.cast("long").alias("n_links"), "component_id")
