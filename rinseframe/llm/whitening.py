"""Whitening of embeddings: a distributed covariance, its leading eigenvectors, a broadcast projection.

Entries are quantised to whole numbers, so means are exact. The covariance is the mean of
products of centred entries over the distinct vectors; each task multiplies its own rows
and adds up one d x d matrix, and the matrices are added ``FAN_IN`` at a time until one is
left. That matrix, whose size is that of the vectors and not of the table,
is brought to tridiagonal form by Householder reflections. Its leading eigenvalues are
bisected by Sturm counts, their vectors found by inverse iteration, within clusters of
eigenvalues made orthogonal to those before, and reflected back.

Defined results: vectors that are null, or hold null or non-finite entries, or entries
whose quantised value is 2^53 or more, are dropped; so are those whose length is not the
most frequent one (the larger one of two equally frequent); repeated rows are fitted once
and all returned; components without spread (an eigenvalue not above rounding) are left
out, so equal vectors or an empty table give no rows; input columns named like an added
column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseframe.llm.frames import Scratch, fresh, without

#: quantised entries: floor(SCALE * entry) + SHIFT
SCALE, SHIFT = 64, 1_000_000
EPS = np.finfo(np.float64).eps
#: eigenvalues closer than this part of the matrix norm are a cluster
CLUSTER = 1e-3
#: rows multiplied at once
STRIP = 4096
#: matrices of tasks added up in one task
FAN_IN = 32


# ---- eigenvectors of a symmetric matrix


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflections) of Householder's reduction; a reflection leaves the rows above alone."""
    a = np.array(matrix, dtype=np.float64)
    n, reflections = len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.abs(x).max(initial=0.0)
        v = np.zeros(len(x))
        if size > 0 and np.abs(x[1:]).max(initial=0.0) > 0:
            v = x / size
            v[0] += math.copysign(math.sqrt(float(v @ v)), v[0])
            v /= math.sqrt(float(v @ v))
            part = a[k + 1 :, k + 1 :]
            p = part @ v
            w = p - (v @ p) * v
            part -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1 :, k] = a[k, k + 1 :] = x - 2 * v * (v @ x)
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def reflect_back(vector: np.ndarray, reflections: list[np.ndarray]) -> np.ndarray:
    """An eigenvector of the tridiagonal matrix as one of the whole matrix."""
    y = vector.copy()
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        y[k + 1 :] -= 2 * v * (v @ y[k + 1 :])
    return y


def count_below(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Eigenvalues below each point: negative pivots of the Sturm sequence."""
    least = np.finfo(np.float64).tiny * max(1.0, float(np.max(off * off, initial=0.0)))
    count = np.zeros(len(points), dtype=np.int64)
    pivot = np.ones(len(points))
    for i, d in enumerate(diagonal):
        pivot = d - points - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The largest eigenvalues, falling, all bisected at once until no double lies between the bounds."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[: n - 1] += np.abs(off)
    reach[1:] += np.abs(off)
    low, high = float(np.min(diagonal - reach)), float(np.max(diagonal + reach))
    room = EPS * max(abs(low), abs(high)) + np.finfo(np.float64).tiny
    lows, highs = np.full(count, low - room), np.full(count, high + room)
    wanted = n - np.arange(count)  # eigenvalue k from the top has this many at or below it
    while True:
        middle = lows + (highs - lows) / 2
        moving = (middle > lows) & (middle < highs)
        if not moving.any():
            return middle
        above = count_below(diagonal, off, middle) >= wanted
        highs = np.where(moving & above, middle, highs)
        lows = np.where(moving & ~above, middle, lows)


class Shifted:
    """T - value I as a product of a unit lower and a three-band upper matrix, rows exchanged for the larger pivot."""

    def __init__(self, diagonal: np.ndarray, off: np.ndarray, value: float, least: float):
        n = len(diagonal)
        self.main, self.up, self.up2 = (diagonal - value).tolist(), [*off.tolist(), 0.0], [0.0] * n
        self.factor, self.exchanged = [0.0] * n, [False] * n
        for i in range(n - 1):
            lower, here = float(off[i]), self.main[i]
            if abs(lower) > abs(here):
                self.exchanged[i] = True
                self.factor[i] = here / lower
                self.main[i], self.up[i], self.main[i + 1], self.up2[i], self.up[i + 1] = (
                    lower,
                    self.main[i + 1],
                    self.up[i] - self.factor[i] * self.main[i + 1],
                    self.up[i + 1],
                    -self.factor[i] * self.up[i + 1],
                )
            else:
                if abs(here) < least:
                    self.main[i] = here = least
                self.factor[i] = lower / here
                self.main[i + 1] -= self.factor[i] * self.up[i]
        if abs(self.main[-1]) < least:
            self.main[-1] = least

    def solve(self, right: np.ndarray) -> np.ndarray:
        y, n = right.tolist(), len(right)
        for i in range(n - 1):
            if self.exchanged[i]:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= self.factor[i] * y[i]
        for i in range(n - 1, -1, -1):
            if i + 1 < n:
                y[i] -= self.up[i] * y[i + 1]
            if i + 2 < n:
                y[i] -= self.up2[i] * y[i + 2]
            y[i] /= self.main[i]
        return np.array(y)


def leading_eigenpairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as rows); the largest entry of each is positive."""
    scale = float(np.abs(matrix).max(initial=0.0))
    n, count = len(matrix), min(count, len(matrix))
    if not scale or not count:
        return np.zeros(count), np.eye(count, n)
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, count)
    norm = float(max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0)))
    vectors, cluster, shift = [], [], math.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            cluster = []
        # equal eigenvalues are shifted apart, so that each gets a direction of its own
        shift = min(float(value), shift - 10 * EPS * norm) if cluster else float(value)
        solver = Shifted(diagonal, off, shift, EPS * norm)
        y = np.random.default_rng(k).uniform(-1, 1, n)
        for _ in range(8):
            before = y
            y = solver.solve(y / np.abs(y).max())
            for _ in range(2):
                for other in cluster:
                    y -= (other @ y) * other
            y /= math.sqrt(float(y @ y))
            if 1 - abs(float(y @ before)) / math.sqrt(float(before @ before)) < 4 * EPS:
                break
        cluster.append(y)
        vectors.append(y)
    whole = np.array([reflect_back(y, reflections) for y in vectors])
    whole /= np.sqrt((whole * whole).sum(axis=1, keepdims=True))
    signs = np.sign(whole[np.arange(count), np.abs(whole).argmax(axis=1)])
    return values * scale, whole * signs[:, None]


# ---- tables


def quantised(df: DataFrame, vector: str, name: str) -> DataFrame:
    """Replace the vector by its quantised entries, a little-endian int64 blob; null where it does not count."""
    kept = [c for c in df.columns if c != vector]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{vector}`"))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + [f"`{name}` binary"])

    def blob(entries: np.ndarray | None) -> bytes | None:
        if entries is None or not len(entries):
            return None
        x = np.floor(SCALE * entries) + SHIFT
        return x.astype("<i8").tobytes() if np.isfinite(entries).all() and (np.abs(x) < 1 << 53).all() else None

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for value in batch.column(len(kept)):
                entries = value.values.to_numpy(zero_copy_only=False).astype(np.float64) if value.is_valid else None  # null is NaN
                blobs.append(blob(entries))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(blobs, pa.binary())], names=[*kept, name])

    return source.mapInArrow(convert, fields)


def rows_of(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def added_up(partials: DataFrame, scratch: Scratch) -> np.ndarray | None:
    """The sum of the ``total`` blobs of doubles that tasks made, one each, ``FAN_IN`` of them at a time."""
    table = scratch.stored(partials, "partials")
    last = table.agg(F.max("part")).first()[0]
    if last is None:
        return None

    def add(rows: pa.Table) -> pa.Table:
        total = None
        for blob in rows.column("total").to_pylist():
            part = np.frombuffer(blob, dtype="<f8")
            total = part if total is None else total + part
        part = rows.column("part")[0].as_py() // FAN_IN
        return pa.table({"part": pa.array([part], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})

    summed = table
    while True:
        summed = summed.groupBy(F.expr(f"part div {FAN_IN}").alias("some")).applyInArrow(add, "part long, total binary")
        last //= FAN_IN
        if not last:
            break
    result = summed.first()["total"]
    scratch.drop(table)
    return np.frombuffer(result, dtype="<f8")


def task_sums(table: DataFrame, of_rows) -> DataFrame:
    """(part, total): the sum over a task's rows of an array of doubles computed from each strip of them."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP):
                part = of_rows(batch.slice(at, STRIP).column(0))
                total = part if total is None else total + part
        if total is not None:
            columns = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.astype("<f8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "total"])

    return table.mapInArrow(sums, "part long, total binary")


def exact_sums(table: DataFrame, dim: int) -> list[int]:
    """Sums of each entry, in whole numbers: high and low halves are added apart, so no sum is rounded."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, names = np.zeros(2 * dim, dtype=np.int64), ["entry", "high", "low"]
        for batch in batches:
            x = rows_of(batch.column(0), "<i8")
            total += np.concatenate([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(total[:dim]), pa.array(total[dim:])], names=names)

    summed = table.mapInArrow(halves, "entry long, high long, low long").groupBy("entry")
    summed = summed.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    sums = [0] * dim
    for entry, high, low in summed.collect():  # a row for each entry
        sums[entry] = (int(high) << 32) + int(low)
    return sums


class Fit:
    """What whitening needs of the distinct vectors: their number, sums, components and spread."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums = n, sums
        self.values, self.vectors, self.explained = values, vectors, values / trace if trace else values
        self.projection = (vectors / np.sqrt(values)[:, None]).T
        self.fits = n * max(map(abs, sums), default=0) < 1 << 61 and n < 1 << 31

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: whole numbers of 64 bits where they fit, else of any size."""
        if self.fits and int(np.abs(x).max(initial=0)) * self.n < 1 << 61:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        y = self.scaled(x)
        if y.dtype == object:
            return np.array([[v / self.n for v in row] for row in y.tolist()], dtype=np.float64).reshape(y.shape)
        return y / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        y = self.scaled(x)
        if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * max(1, y.shape[1]) < 1 << 63:
            return (y * y).sum(axis=1).tolist()
        return [sum(int(v) * int(v) for v in row) for row in y.tolist()]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.projection


def covariance(table: DataFrame, n: int, centred, scratch: Scratch) -> np.ndarray:
    """The mean of products of what ``centred`` makes of each row."""

    def products(column: pa.Array) -> np.ndarray:
        y = centred(rows_of(column, "<i8"))
        return (y.T @ y).ravel()

    total = added_up(task_sums(table, products), scratch)
    side = math.isqrt(len(total))
    matrix = total.reshape(side, side) / n
    return (matrix + matrix.T) / 2


def whitened(df: DataFrame, vector: str = "embedding", components: int = 16) -> DataFrame:
    """One row for each vector and component: the other columns and ``component``, ``n``, ``deviation``
    (decimal), ``whitened``, ``explained``, ``identity_error``."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    added = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    df = without(df, *[a for a in added if a != vector.lower()])
    kept = [f for f in df.schema.fields if f.name.lower() != vector.lower()]
    name = fresh(df, "quantised")
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{vector}`"))
    rows = scratch.stored(quantised(source, vector, name).where(F.col(name).isNotNull()), "quantised")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept])
    schema += ("," if kept else "") + "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    size = F.octet_length(name)
    often = rows.groupBy(size.alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).first()
    if often is None:
        scratch.drop(rows)
        return spark.createDataFrame([], schema)
    rows_in = rows.where(size == often["bytes"])
    distinct = scratch.stored(rows_in.select(name).distinct(), "distinct")
    n, dim = distinct.count(), often["bytes"] // 8
    sums = exact_sums(distinct, dim)
    only_means = Fit(n, sums, np.ones(0), np.zeros((0, dim)), 0.0)
    matrix = covariance(distinct, n, only_means.centred, scratch)
    values, vectors = leading_eigenpairs(matrix, components)
    spread = values > EPS * dim * max(float(values.max(initial=0.0)), 0.0)
    fit = Fit(n, sums, values[spread], vectors[spread], float(np.trace(matrix)))
    if not spread.any():
        scratch.drop(rows, distinct)
        return spark.createDataFrame([], schema)
    means = added_up(task_sums(distinct, lambda column: fit.whitened(rows_of(column, "<i8")).sum(axis=0)), scratch) / n
    own = covariance(distinct, n, lambda x: fit.whitened(x) - means, scratch)
    error = float(np.abs(own - np.eye(len(own))).max())
    scratch.drop(distinct)
    return project(rows_in, [f.name for f in kept], name, fit, error, schema)


def project(rows: DataFrame, kept: list[str], name: str, fit: Fit, error: float, schema: str) -> DataFrame:
    """Every row on every component; the fit, a few vectors, goes to the tasks with their code."""
    k = len(fit.values)

    def rows_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STRIP):
                batch = whole.slice(at, STRIP)
                x = rows_of(batch.column(len(kept)), "<i8")
                each = pa.array(np.repeat(np.arange(len(x)), k))
                count = len(x) * k
                columns = [c.take(each) for c in batch.columns[: len(kept)]]
                deviations = pa.array([Decimal(d) for d in fit.deviations(x)], pa.decimal128(38, 0)).take(each)
                columns += [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(count, fit.n)),
                    deviations,
                    pa.array(fit.whitened(x).ravel()),
                    pa.array(np.tile(fit.explained, len(x))),
                    pa.array(np.full(count, error)),
                ]
                names = [*kept, "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select(*[F.col(f"`{c}`") for c in [*kept, name]]).mapInArrow(rows_out, schema)
