"""Whitening against numpy's solver and sums of Python integers."""

import math

import numpy as np
import pytest

from plain import write
from rinseframe.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, N int, Component string"


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.array(values, dtype=float)) @ q.T


MATRICES = {
    "random": symmetric(np.random.default_rng(1).uniform(0, 1, 40)),
    "falling": symmetric(2.0 ** -np.arange(30)),
    "equal": symmetric([3.0] * 5 + [1.0] * 7 + [0.5, 0.2, 0.0, 0.0]),
    "close": symmetric([1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.5 - 1e-13, 0.1]),
    "diagonal": np.diag([1.0, 5.0, 5.0, 0.0, 2.0]),
    "blocks": np.kron(np.eye(6), np.array([[2.0, 1.0], [1.0, 2.0]])),
    "one": np.array([[4.0]]),
    "two": np.array([[1.0, 2.0], [2.0, 1.0]]),
    "tiny": symmetric([3e-200, 2e-200, 1e-200]),
    "huge": symmetric([3e200, 2e200, 1e200]),
    "indefinite": symmetric([5, 1, 0, -2, -7]),
    "wilkinson": np.diag(np.abs(np.arange(-10, 11.0))) + np.eye(21, k=1) + np.eye(21, k=-1),
}


@pytest.mark.parametrize("name", MATRICES)
def test_eigenpairs(name):
    a = (MATRICES[name] + MATRICES[name].T) / 2
    values, vectors = whitening.leading_eigenpairs(a, 16)
    norm = np.abs(a).max()
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:16]).max() <= 1e-14 * norm * len(a)
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-13 * norm * len(a)


def test_zero_matrix():
    values, vectors = whitening.leading_eigenpairs(np.zeros((3, 3)), 2)
    assert values.tolist() == [0, 0] and vectors.shape == (2, 3)


def expected(rows, components=16):
    kept = [(i, v) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all()]
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in kept}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    result = {}
    for i, row in x.items():
        z = [n * c - s for c, s in zip(row, sums)]
        white = np.array([c / n for c in z]) @ vectors / np.sqrt(values)
        result[i] = (n, sum(c * c for c in z), white, values / np.trace(v))
    return result


def check(frame, rows):
    assert frame.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    want, found = expected(rows), {}
    for r in frame.collect():
        found.setdefault(r.vec_id, []).append(r)
    assert set(found) == set(want)
    first = np.array([found[i][0].whitened and [r.whitened for r in sorted(found[i], key=lambda r: r.component)] for i in sorted(found)])
    other = np.array([want[i][2] for i in sorted(found)])
    signs = np.sign((first * other).sum(axis=0))
    assert np.abs(first * signs - other).max() < 1e-8
    for i, got in found.items():
        n, deviation, _, explained = want[i]
        assert sorted(r.component for r in got) == list(range(1, len(explained) + 1))
        assert {(r.n, int(r.deviation)) for r in got} == {(n, deviation)}
        assert all(abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in got)


def test_all_vectors(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(queries.op13_whitened_embeddings(spark, sf), rows)


def test_copies_and_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=20) * np.arange(1, 21)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of copies, fitted once
    nan = [float("nan")] + [0.0] * 19
    odd = [(2000, None), (2001, []), (2002, [None] + [1.0] * 19), (2003, nan), (2004, [float("-inf")] * 20), (2005, [1.0] * 19), (2006, [3e38] * 20)]
    write(spark, [(i, v, 5, "x") for i, v in rows + odd], tmp_path, SCHEMA, "embeddings")
    check(queries.op13_whitened_embeddings(spark, str(tmp_path)), rows)


def test_without_spread(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, None)], "vec_id long, embedding array<double>")
    assert whitening.whitened(frame).collect() == []
    assert whitening.whitened(frame.where("vec_id > 5")).collect() == []
    line = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (None, [3.0, 2.0])], "vec_id long, embedding array<double>")
    found = whitening.whitened(line).orderBy("vec_id").collect()
    assert [(r.component, r.n, int(r.deviation), r.explained) for r in found] == [(1, 2, 128 * 128, 1.0)] * 3
    assert [abs(r.whitened) for r in found] == [1.0] * 3 and found[0].whitened == found[2].whitened


def test_exact_beyond_64_bits():
    fit = whitening.Fit(10**9, [3 * 10**9 + 1, -(10**9)], np.ones(0), np.zeros((0, 2)), 0.0)
    x = np.array([[5, 7], [1 << 52, -(1 << 52)]])
    assert fit.deviations(x) == [sum((10**9 * int(c) - s) ** 2 for c, s in zip(row, fit.sums)) for row in x]


def test_sums_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 32)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(400)]
    many = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(70)
    one = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    a, b = (whitening.whitened(f).orderBy("vec_id", "component").collect() for f in (many, one))
    assert all(x.deviation == y.deviation and abs(x.whitened - y.whitened) < 1e-9 for x, y in zip(a, b)) and len(a) == 2000
