"""Whitening against a dense eigenproblem, and the solver on its own."""

import math

import numpy as np
import pytest

from tidemark.llm import whitening as W


@pytest.mark.parametrize("dim,k", [(64, 8), (150, 8), (5, 8), (1, 8), (30, 3)])
def test_solver_reaches_double_precision(dim, k):
    rng = np.random.default_rng(dim)
    a = rng.standard_normal((dim, dim))
    a = a @ a.T
    e, u = W.leading_pairs(lambda v: a @ v, dim, k)
    want = np.linalg.eigvalsh(a)[::-1][:k]
    assert np.abs(e - want).max() <= 1e-13 * want[0]
    assert np.linalg.norm(a @ u - u * e, axis=0).max() <= 1e-13 * want[0]
    assert np.abs(u.T @ u - np.eye(len(e))).max() <= 1e-12


def test_solver_with_equal_eigenvalues():
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((40, 40)))[0]
    a = q * np.array([5.0] * 6 + [1.0] * 34) @ q.T
    e, u = W.leading_pairs(lambda v: a @ v, 40, 8)
    assert np.abs(e - np.array([5.0] * 6 + [1.0] * 2)).max() < 1e-12 and np.linalg.norm(a @ u - u * e, axis=0).max() < 1e-12


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(8)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    a = q * np.concatenate([np.linspace(-3, -1, 10), np.linspace(1, 4, 20)]) @ q.T
    b = rng.standard_normal((30, 4))
    b[:, 2] = 0
    x = W.minres(lambda v: a @ v, b, 60, 1e-13)
    assert np.abs(a @ x - b).max() < 1e-9 and not x[:, 2].any()


def dense(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, dtype=float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    deviation = [sum(int(v) ** 2 for v in r) for r in n * x - s]
    return c @ q[:, :k] / np.sqrt(np.maximum(e[:k], 1e-300)), e[:k] / e.sum(), deviation


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, whitened int, label int")


def test_against_dense(spark):
    rng = np.random.default_rng(5)
    v = (rng.standard_normal((400, 12)) * np.linspace(0.3, 0.05, 12)).astype(np.float32)
    odd = [None, [], [None] * 12, [math.nan] + [0.0] * 11, [math.inf] + [0.0] * 11, [1e30] + [0.0] * 11]
    rows = [(i, [float(c) for c in x], "a", 1, i % 3) for i, x in enumerate(v)] + [(1000 + i, x, "b", 2, 0) for i, x in enumerate(odd)]
    rows += [(None, [float(c) for c in v[0]], "c", 3, 0), rows[1]]
    d = W.whiten(table(spark, rows).repartition(5))
    assert d.columns == ["vec_id", "embedding", "label", *W.RESULTS]
    got = d.collect()
    whitened, explained, deviation = dense([r[1] for r in rows if r[0] is None or r[0] < 1000])
    assert len(got) == 402 and {r.n for r in got} == {402}
    by_id = {i: k for k, i in enumerate([*range(400), None])}
    mine = np.array([r.whitened for r in got])
    want = whitened[[by_id[r.vec_id] for r in got]]
    sign = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine * sign - want).max() < 1e-9
    assert all(np.abs(np.array(r.explained) / explained - 1).max() < 1e-10 and r.identity_error < 1e-9 for r in got)
    assert [int(r.deviation) for r in got] == [deviation[by_id[r.vec_id]] for r in got]


def test_few_constant_and_unequal_vectors(spark):
    rows = [(1, [0.5, 0.25], "", 0, 0), (2, [0.25, 0.25], "", 0, 0), (3, [0.75, 0.25], "", 0, 0), (4, [1.0, 2.0, 3.0], "", 0, 0)]
    got = {r.vec_id: r for r in W.whiten(table(spark, rows)).collect()}
    # the second dimension never varies: one component; a list of one vector has none
    assert [len(got[i].whitened) for i in (1, 2, 3, 4)] == [1, 1, 1, 0] and got[4].n == 1 and int(got[4].deviation) == 0
    assert sorted(round(got[i].whitened[0], 9) for i in (1, 2, 3)) == [-1.224744871, 0.0, 1.224744871]
    assert W.whiten(table(spark, [])).count() == 0


def test_exact_deviation_beyond_64_bits():
    x = np.array([[1 << 30, 5], [0, 7]], dtype=np.int64)
    n, s = 1 << 20, np.array([3, 11], dtype=np.int64)
    assert [int(v) for v in W.squared_deviation(x, n, s)] == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]


def test_sums_over_many_tasks_are_added_in_spark(spark, monkeypatch):
    monkeypatch.setattr(W, "DRIVER_PARTIALS", 2)
    v = np.random.default_rng(1).standard_normal((60, 4)).round(3)
    rows = [(i, [float(c) for c in x], "", 0, 0) for i, x in enumerate(v)]
    got = W.whiten(table(spark, rows).repartition(6)).collect()
    assert max(r.identity_error for r in got) < 1e-9
