"""Whitening of embeddings by principal components: block Jacobi-Davidson with products made by Spark.

The covariance is never formed. A product with it is one job: every block of vectors is centred, projected and summed, and
the sums of tasks are added up. Ritz vectors come from a small subspace; each that has not converged is improved by its
correction equation, projected off all current Ritz vectors and solved by an inner MINRES, for all of them at once, so an
inner step is one job too. Converged vectors are locked; the search ends when all residuals are at the rounding of doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SEED, forget_other_stages, written

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Entries from here on are not usable: their scaled value would leave 64 bits
HUGE = float(1 << 42)
#: Vectors in a stored block
BLOCK = 1024
#: Ritz vectors kept beside the wanted ones, largest subspace in wanted vectors, inner steps of MINRES, rounds
GUARD, SUBSPACE, INNER, ROUNDS = 4, 5, 10, 60
#: Partial sums that the driver adds up itself; more are first added up in Spark
DRIVER_PARTIALS = 256
RESULTS = ("n", "deviation", "whitened", "explained", "identity_error")


def usable(vec) -> object:
    """Whether a vector takes part: not null or empty, and no entry null, non-finite or huge."""
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < HUGE))


def scaled(column: pa.ListArray, dim: int) -> np.ndarray:
    """floor(1024 c) + 100000 of each entry."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of scaled vectors of one length, with their exact sums."""
    forget_other_stages()
    for batch in batches:
        column = batch.column(0)
        lens = np.diff(column.offsets.to_numpy())
        for dim in np.unique(lens):
            some = column.take(pa.array(np.flatnonzero(lens == dim)))
            for a in range(0, len(some), BLOCK):
                x = scaled(some.slice(a, BLOCK), int(dim))
                yield pa.record_batch([pa.array([int(dim)], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], names=["dim", "n", "sums", "body"])


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n with one rounding."""
    return (n * x - sums) / n


@dataclass
class FitList:
    """Stored vectors of one length: blocks, count and exact sums."""

    blocks: DataFrame
    dim: int
    n: int
    sums: np.ndarray

    def total(self, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """Sum over all vectors of what ``of`` gives for the centred vectors of a block."""
        dim, n, all_ = self.dim, self.n, self.sums

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget_other_stages()
            out = np.zeros(shape)
            for batch in batches:
                for body in batch.column(0):
                    out += of(centred(np.frombuffer(body.as_buffer(), dtype=np.int64).reshape(-1, dim), n, all_))
            yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], names=["sum"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape)
            for batch in batches:
                for body in batch.column(0):
                    out += np.frombuffer(body.as_buffer()).reshape(shape)
            yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], names=["sum"])

        sums = self.blocks.select("body").mapInArrow(add, "sum binary")
        tasks = self.blocks.rdd.getNumPartitions()
        if tasks > DRIVER_PARTIALS:
            sums = sums.repartition(int(tasks**0.5)).mapInArrow(merge, "sum binary")
        found = [np.frombuffer(r["sum"]).reshape(shape) for r in sums.collect()]
        return np.sum(found, axis=0) if found else np.zeros(shape)

    def times(self, u: np.ndarray) -> np.ndarray:
        """The covariance times the columns of u."""
        return self.total(lambda c: c.T @ (c @ u), u.shape) / self.n

    def trace(self) -> float:
        return float(self.total(lambda c: (c * c).sum(axis=0), (self.dim,)).sum()) / self.n


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The part of the new columns outside the basis, orthonormal; columns without one are left out."""
    out = basis
    for v in new.T:
        size = np.linalg.norm(v)
        if not np.isfinite(size) or size == 0:
            continue
        v = v / size
        for _ in range(3):
            v = v - out @ (out.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-12 and out.shape[1] < len(v):
            v = v / left
            v = v - out @ (out.T @ v)
            out = np.column_stack([out, v / np.linalg.norm(v)])
    return out[:, basis.shape[1] :]


def minres(apply: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Solves one symmetric system for each column, all columns in step: Lanczos, and Givens rotations of its tridiagonal."""
    m = rhs.shape[1]
    x, v_old, d_old, d_older = (np.zeros_like(rhs) for _ in range(4))
    beta = np.linalg.norm(rhs, axis=0)
    start, live = beta.copy(), beta > 0
    v = rhs / np.where(live, beta, 1)
    c, s, c_old, s_old = np.ones(m), np.zeros(m), np.ones(m), np.zeros(m)
    eta, beta = beta.copy(), np.zeros(m)
    for _ in range(steps):
        if not live.any():
            break
        w = apply(v) - beta * v_old
        alpha = (v * w).sum(axis=0)
        w = w - alpha * v
        beta_new = np.linalg.norm(w, axis=0)
        # two rotations of before act on the new column, then one of its own
        over = s_old * beta
        upper = s * alpha + c * c_old * beta
        diagonal = c * alpha - s * c_old * beta
        size = np.hypot(diagonal, beta_new)
        ok = live & (size > 0)
        safe = np.where(ok, size, 1)
        c_new, s_new = np.where(ok, diagonal / safe, 1), np.where(ok, beta_new / safe, 0)
        d = (v - over * d_older - upper * d_old) / safe
        x = x + np.where(ok, c_new * eta, 0) * d
        eta = np.where(ok, -s_new * eta, eta)
        d_older, d_old, v_old = d_old, d, v
        live = ok & (np.abs(eta) > enough * start) & (beta_new > 1e-14 * np.abs(safe))
        v = np.where(live, w / np.where(beta_new > 0, beta_new, 1), 0)
        beta, c_old, s_old, c, s = beta_new, c, s, c_new, s_new
    return x


def leading_pairs(times: Callable[[np.ndarray], np.ndarray], dim: int, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors of a symmetric operator given by its products."""
    k = min(k, dim)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((dim, min(k + GUARD, dim))), np.zeros((dim, 0)))
    image = times(basis)
    locked = 0
    for turn in range(ROUNDS):
        small = basis.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        # the whole subspace is turned, so locked vectors stay in it and later ones stay orthogonal to them
        basis, image = basis @ s, image @ s
        u, values = basis[:, :k], theta[:k]
        residual = image[:, :k] - u * values
        size = np.linalg.norm(residual, axis=0)
        done = size <= 4 * np.finfo(float).eps * dim**0.5 * max(abs(theta[0]), np.finfo(float).tiny)
        locked = k if done.all() else int(np.argmin(done))
        if locked == k or basis.shape[1] == dim:
            return values, u
        if basis.shape[1] > SUBSPACE * k:
            keep = min(k + GUARD, dim)
            basis, image = basis[:, :keep], image[:, :keep]
        # leading converged vectors are locked: they have no equation, but all equations are kept off them
        open_ = np.flatnonzero(~done & (np.arange(k) >= locked))
        off = lambda y: y - u @ (u.T @ y)
        shift = values[open_]

        def corrected(y: np.ndarray) -> np.ndarray:
            y = off(y)
            return off(times(y) - y * shift)

        step = minres(corrected, -off(residual[:, open_]), INNER, max(0.5 ** (turn + 2), 1e-6))
        fresh = _orthonormal(off(step), basis)
        if not fresh.shape[1]:
            fresh = _orthonormal(np.random.default_rng(seed + turn + 1).standard_normal((dim, 1)), basis)
        basis, image = np.column_stack([basis, fresh]), np.column_stack([image, times(fresh)])
    raise RuntimeError(f"residuals {size} after {ROUNDS} rounds")


@dataclass
class Whitening:
    """What a fit gives: eigenvalues, eigenvectors, shares of the trace and how far the result is from white."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(data: FitList, components: int = COMPONENTS, seed: int = SEED) -> Whitening:
    """Components with an eigenvalue at the rounding of the largest one have no direction and are left out."""
    trace = data.trace()
    values, u = leading_pairs(data.times, data.dim, components, seed) if trace > 0 else (np.zeros(0), np.zeros((data.dim, 0)))
    real = values > 64 * np.finfo(float).eps * data.dim * max(trace, np.finfo(float).tiny)
    values, u = values[real], u[:, real]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0) if u.size else u
    to_white, error = u / np.sqrt(values), 0.0
    if len(values):
        mean = data.total(lambda c: (c @ to_white).sum(axis=0), (len(values),)) / data.n

        def square(c: np.ndarray) -> np.ndarray:
            w = c @ to_white - mean
            return w.T @ w

        error = float(np.abs(data.total(square, (len(values), len(values))) / data.n - np.eye(len(values))).max())
    return Whitening(data.n, data.sums, values, u, values / trace if trace > 0 else values, error)


def squared_deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[Decimal]:
    """Exact sum over dimensions of (n x - S)^2: parts of 26 bits are squared and summed apart."""
    q = n * x - sums
    high, low = q >> 26, q & ((1 << 26) - 1)
    parts = [(v.sum(axis=1)).tolist() for v in (high * high, high * low, low * low)]
    return [Decimal((a << 52) + (b << 27) + c) for a, b, c in zip(*parts)]


def whiten(rows: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS, seed: int = SEED) -> DataFrame:
    """Usable rows with n, deviation, and the arrays whitened and explained, an entry for each component, and identity_error.

    Entries c become x = floor(1024 c) + 100000; the fit list is all usable vectors of one length, vectors of another length have a
    list of their own. deviation is exact, a decimal(38, 0). whitened is x - S/n projected on the unit eigenvectors
    by falling eigenvalue, over its root, explained is the share of the trace, identity_error the largest
    entry of the covariance of whitened minus the identity. Vectors that are null or empty or hold a null, non-finite or huge
    (2^42 and above) entry are left out, repeated rows count each. Directions without variance have no component, so a single vector has
    empty arrays. All other columns stay, those with the names of results are replaced. An empty table gives an empty result.
    """
    rows = rows.drop(*RESULTS)
    good = rows.where(usable(F.col(vec_col)))
    blocks = written(good.select(F.col(vec_col).cast("array<double>").alias("vec")).mapInArrow(_store, "dim int, n long, sums array<bigint>, body binary"), "blocks")
    per_dim = blocks.groupBy("dim").agg(F.sum("n").alias("n")).orderBy("dim").collect()
    kind = T.StructType().add("row", T.StructType(rows.schema.fields)).add("n", "long").add("deviation", "decimal(38,0)")
    kind = kind.add("whitened", T.ArrayType(T.DoubleType())).add("explained", T.ArrayType(T.DoubleType())).add("identity_error", "double")
    out = None
    for dim, n in per_dim:
        mine = blocks.where(F.col("dim") == dim)
        sums = mine.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
        found = fit(FitList(mine, dim, n, np.array([r["s"] for r in sums], dtype=np.int64)), components, seed)
        part = good.where(F.size(vec_col) == dim).select(F.col(vec_col).cast("array<double>").alias("vec"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
        one = part.mapInArrow(_project(found, dim), kind)
        out = one if out is None else out.union(one)
    if out is None:
        return rows.sparkSession.createDataFrame([], kind).select("row.*", *RESULTS)
    return out.select("row.*", *RESULTS)


def _project(found: Whitening, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_other_stages()
        to_white, k = found.vectors / np.sqrt(found.values), len(found.values)
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                b = whole.slice(a, 4096)
                x = scaled(b.column(0), dim)
                m = len(x)
                w = centred(x, found.n, found.sums) @ to_white
                ends = pa.array(np.arange(m + 1, dtype=np.int32) * k)
                arrays = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in (w, np.tile(found.explained, (m, 1)))]
                deviation = pa.array(squared_deviation(x, found.n, found.sums), pa.decimal128(38, 0))
                yield pa.record_batch([b.column(1), pa.array([found.n] * m, pa.int64()), deviation, *arrays, pa.array([found.identity_error] * m)], names=["row", *RESULTS])

    return run
